import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[k]) for k in (0, 1, 2)]
