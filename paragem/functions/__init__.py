"""Column expressions: time arithmetic, labels and shift minutes."""
