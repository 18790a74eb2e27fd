"""Reading of the text tables and small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows no model may learn from: crc32 of the id as text divides by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def lowest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of each ``key`` with the least ``order``, a 64-bit hash.

    Counts of the hash's first 12 bits tell which ranges the rows lie in, so a task
    ranks little more than ``n`` rows, however many a key has. ``rows`` is read twice.
    """
    ranges = rows.select(key, F.shiftright(order, 52).alias("_range"))
    counts = ranges.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < n)
    near = rows.withColumn("_range", F.shiftright(order, 52)).join(counts.select(key, "_range"), [key, "_range"])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(rows.columns)
