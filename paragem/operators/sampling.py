"""Exact and repeatable train/test splits, and balanced class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragem.session import stage

#: Entries of the quantile summary: a cut is first known to about 1 / ACCURACY of a stratum's rows.
ACCURACY = 20_000
#: Neighbouring hashes by which the bracket around a cut is widened, for rounding in small strata.
NEIGHBOURS = 8


def train_sizes(counts: DataFrame, test_fraction: float, keep: list[str] = ()) -> DataFrame:
    """(level, size, columns to keep): training rows per stratum of ``counts`` (level, n).

    The test share is rounded up over all rows, then handed out in proportion, the largest
    remainders first. One row per stratum.
    """
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    train = total - F.ceil(total * F.lit(test_fraction))
    share = counts.withColumn("train", train).withColumn("share", F.col("n") * F.col("train") / total)
    whole = share.withColumn("whole", F.floor("share"))
    name = F.coalesce(F.col("level").cast("string"), F.lit("None"))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("whole")), name))
    missing = F.col("train") - F.sum("whole").over(every)
    return whole.select("level", (F.col("whole") + (place <= missing).cast("long")).alias("size"), *keep)


def exact_split(
    df: DataFrame, id_columns: list[str], stratum: str | None = None, test_fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split into training and test rows of exact sizes, the same on every run.

    Rows are ordered by a hash of their id and the first ones of each stratum train. A
    summary of the hash's quantiles brackets the cut in a first pass; a second one counts the
    rows before the bracket and ranks the few inside it. Each side is then one filter on the
    rows. ``id_columns`` tell rows apart; rows that repeat an id stay together, on the
    training side if the cut falls among them. The cuts, one row per stratum, are found on call.
    """
    level = F.col(stratum) if stratum else F.lit(0)
    hashed = df.withColumn("_level", level).withColumn("_hash", F.xxhash64(F.lit(seed), *id_columns))
    cuts = _cuts(hashed.select(F.col("_level").alias("level"), F.col("_hash").alias("hash")), test_fraction)
    cuts = cuts.select(F.col("level").alias("_cut_level"), "cut")
    marked = hashed.join(cuts, F.col("_level").eqNullSafe(F.col("_cut_level")), "left")
    trains = F.coalesce(F.col("_hash") <= F.col("cut"), F.lit(False))
    helpers = ["_level", "_hash", "_cut_level", "cut"]
    return marked.filter(trains).drop(*helpers), marked.filter(~trains).drop(*helpers)


def _cuts(rows: DataFrame, test_fraction: float, accuracy: int = ACCURACY) -> DataFrame:
    """(level, cut): the hash of the last training id of each stratum; strata without training rows are left out.

    A bracket that misses its cut shows in the second pass, which is then repeated without brackets.
    """
    # All that follows of the summary is one row per stratum.
    brackets = stage(_brackets(rows, test_fraction, accuracy), "split-brackets")
    cuts = stage(_inside(rows, brackets), "split-cuts")
    missed = brackets.filter("size > 0").join(cuts, brackets["level"].eqNullSafe(cuts["level"]), "left_anti")
    if missed.isEmpty():
        return cuts
    everything = missed.withColumns({"low": F.lit(-(2.0**63)), "high": F.lit(2.0**63)})
    return cuts.union(stage(_inside(rows, everything), "split-cuts"))


def _brackets(rows: DataFrame, test_fraction: float, accuracy: int) -> DataFrame:
    """(level, size, low, high): training rows of each stratum, and doubles that the cut should lie between."""
    margin = 3.0 / accuracy
    at = [max(0.0, 1 - test_fraction - margin), min(1.0, 1 - test_fraction + margin)]
    summary = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("hash", at, accuracy).alias("ends")
    )
    sizes = train_sizes(summary.select("level", "n", "ends"), test_fraction, ["n", "ends"])
    spread = F.lit(NEIGHBOURS * 2.0**64) / F.col("n")
    low, high = F.col("ends")[0].cast("double") - spread, F.col("ends")[1].cast("double") + spread
    return sizes.select("level", "size", low.alias("low"), high.alias("high"))


def _inside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """(level, cut) of the strata of ``brackets`` whose cut lies inside; one pass over ``rows``.

    Rows before the bracket are counted as one key, so only those inside are told apart.
    Rounding a hash to a double keeps its order.
    """
    ends = brackets.filter("size > 0").select(F.col("level").alias("_level"), "size", "low", "high")
    near = rows.join(ends, rows["level"].eqNullSafe(ends["_level"]))
    place = F.col("hash").cast("double")
    key = F.when(place >= F.col("low"), F.col("hash")).alias("hash")  # null, which comes first, before the bracket
    counts = near.filter(place <= F.col("high")).groupBy("level", "size", key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("level").orderBy(F.asc_nulls_first("hash")).rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = running.filter((F.col("before") < F.col("size")) & (F.col("size") <= F.col("before") + F.col("n")))
    return found.filter("hash is not null").select("level", F.col("hash").alias("cut"))


def class_weights(df: DataFrame, label: str, rows: str | None = None) -> DataFrame:
    """Balanced weight of each class: rows / (classes x rows of the class).

    ``rows`` names a column that counts how many rows a row stands for.
    """
    count = F.sum(rows) if rows else F.count(F.lit(1))
    counts = df.groupBy(label).agg(count.alias("linhas"))
    # One row per class.
    every = Window.partitionBy()
    balanced = F.sum("linhas").over(every) / (F.count(F.lit(1)).over(every) * F.col("linhas"))
    return counts.select(label, "linhas", balanced.alias("peso"))
