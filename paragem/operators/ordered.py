"""Look back along an ordered group without ever gathering the whole group.

A key may own a large share of all rows, so a plain window over the key would put
that share into one task. Groups are cut into time buckets instead: neighbours are
found inside each bucket, and only bucket edges meet in a second, small window.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], columns: dict[str, str]
) -> DataFrame:
    """Add, for each ``source: target`` in ``columns``, the preceding row's value.

    "Preceding" is by ``order`` among rows of equal ``keys``; ``bucket`` must never
    decrease along ``order`` and ``order`` must leave no ties. Equals ``lag`` over
    the whole key, including null keys and null values.
    """
    value = F.struct(*[F.col(c) for c in columns])
    # Sorting compares a number first and texts only where the numbers agree.
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    in_bucket = Window.partitionBy("_hash", bucket, *keys).orderBy(*order)
    across_buckets = Window.partitionBy("_hash", *keys).orderBy(bucket, *order)

    # A lagged struct is null only where no row precedes, even if its fields are null.
    marked = hashed.withColumn("_previous", F.lag(value).over(in_bucket)).withColumn(
        "_last", F.lead(F.lit(True)).over(in_bucket).isNull()
    )
    inside = marked.filter(F.col("_previous").isNotNull())
    edges = marked.filter(F.col("_previous").isNull() | F.col("_last"))
    first_rows = edges.select(
        *df.columns,
        F.col("_previous").isNull().alias("_first"),
        F.lag(value).over(across_buckets).alias("_previous"),
    ).filter("_first")
    joined = inside.select(*df.columns, "_previous").unionByName(first_rows.drop("_first"))
    added = [F.col("_previous").getField(c).alias(name) for c, name in columns.items()]
    return joined.select(*df.columns, *added)


def join_same(left: DataFrame, right: DataFrame, columns: list[str], condition: Column | None = None) -> DataFrame:
    """Inner join of ``l`` and ``r`` on equal values, nulls equal to each other.

    Shuffle and sort go by one hash; the values themselves are compared afterwards.
    """
    same = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])
    # As one conditional the comparison stays out of the shuffle keys.
    checked = F.when(same if condition is None else same & condition, True).otherwise(False)
    hashes = F.xxhash64(*columns).alias("_hash")
    sides = left.select("*", hashes).alias("l"), right.select("*", hashes).alias("r")
    return sides[0].join(sides[1], (F.col("l._hash") == F.col("r._hash")) & checked)
