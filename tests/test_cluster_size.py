"""The fitted models do not depend on the cores they were fitted on."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import functions as F
from paragem.models import remaining_life, risk
from paragem.operators import rul
from paragem.session import build_session
from paragem.sources import plant

spark = build_session("cores", **{"spark.master": sys.argv[1], "spark.sql.shuffle.partitions": "4",
                                  "spark.ui.enabled": "false"})
stops = plant.stops(spark, "/root/testdata/sf0.001")
fitted = risk.train(stops, trees=4, depth=6)
rows = risk.score_components(fitted.model, stops).select("StationDesc", "ElementDesc", risk.RISK).collect()
print("SCORES", sorted(map(repr, rows)))
features = rul.rul_features(stops)
fitted = remaining_life.train(features.persist(), trees=4, depth=5)
print("DAYS", sorted(map(repr, remaining_life.predict(fitted.model, features).collect())), fitted.metrics.collect())
"""


def test_equal_models_on_one_and_eight_cores():
    root = str(Path(__file__).resolve().parents[1])
    scores = []
    for master in ("local[1]", "local[8]"):
        ran = subprocess.run(
            [sys.executable, "-c", SCRIPT, master], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True
        )
        assert ran.returncode == 0, ran.stderr[-2000:]
        scores.append([line for line in ran.stdout.splitlines() if line.startswith(("SCORES", "DAYS"))])
    assert scores[0] == scores[1] and len(scores[0]) == 2
