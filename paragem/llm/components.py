"""Connected components by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragem.session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b", about: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges``; two nodes have one root when a path joins them.

    Each round points every node at its neighbour of least hash if that is less than
    its own, replaces the ends of all edges by what they point at and drops loops and
    repeats. Since hashes are a random order, the nodes left shrink by a factor each
    round. Aggregates combine before the shuffle and joins are left to adaptive skew
    handling, so a node with very many edges is no bottleneck. Every round is written
    to the shared folder, in files by the number of edges left; ``about`` is that of the
    first round if the caller can tell, and bounds nothing.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges", about)
    roots = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while many := left.count():
        both = left.union(left.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(order("b")).alias("least"))
        points = stage(
            nearest.select(F.col("a").alias("node"), F.least(order("a"), F.col("least"))["n"].alias("to")),
            "points",
            2 * many,
        )
        as_a, as_b = points.toDF("a", "to_a"), points.toDF("b", "to_b")
        moved = left.join(as_a, "a").join(as_b, "b").filter("to_a <> to_b")
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        left = stage(moved, "edges", many)
        onward = points.toDF("root", "to")
        roots = roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots
