"""Approximate nearest neighbours through a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is filed under its leaf. A query
visits the leaves that best-bin-first traversal brings up, as many as a sample of queries
needed to reach the target recall. Queries and vectors meet in buckets of leaves, one task
for each, where the queries wait and the vectors pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragem.llm.kmeans_tree import build, calibrated_leaves
from paragem.llm.vector_sweep import ASKED, buckets, called, filed, first_ids, matrix, sweep
from paragem.session import stage

NEIGHBOURS = 10
#: Bounds of the fit: vectors in the sample, and numbers in all of them.
SAMPLE, SAMPLE_NUMBERS = 16_384, 2_000_000
#: Recall that the visited leaves must reach on the sampled queries, and the number of these.
RECALL, CALIBRATION = 0.95, 256
#: Fewest buckets, and bytes of vectors in one of more.
BUCKETS, BUCKET_BYTES = 48, 128 << 20
#: Bytes of the queries that wait in a task, and what each takes beside its vector.
WAITING_BYTES, WAITING = 128 << 20, 400


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null, NaN or infinite components."""
    least, most = F.array_min(vector), F.array_max(vector)  # NaN is above infinity
    finite = (least > float("-inf")) & (most < float("inf")) & F.forall(vector, lambda x: x.isNotNull())
    return F.coalesce(finite & ((least != 0) | (most != 0)), F.lit(False))


def smallest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key; cut before the shuffle too, so a frequent key stays small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def sampled(distinct: DataFrame, rows: int, length: int) -> np.ndarray:
    """About ``rows`` of the distinct vectors ``v``, or all if they are fewer, in a fixed order.

    The hash of a vector tells whether it is drawn, so tasks send nothing else to the driver.
    """
    total = distinct.count()
    drawn = distinct
    if total > rows:
        drawn = distinct.filter(F.xxhash64("v") < F.lit(int(rows / total * 2**64) - 2**63))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"data": [np.stack(batch["v"].to_numpy()).astype("<f8").tobytes()]})

    data = b"".join(bytes(r[0]) for r in drawn.select("v").mapInPandas(pack, "data binary").collect())
    found = np.frombuffer(data, "<f8").reshape(-1, length)
    return found[np.lexsort(found.T[::-1])]


def nearest(
    vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``neighbours`` rows found nearest to each query row.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on these. Score is the
    Euclidean distance in double precision, smaller is nearer, and ties go to the smaller
    vec_id. A row is no neighbour of its own id; equal vectors of other ids are, at distance
    0. Rows with an unusable vector, a null id or a length other than the commonest take no
    part, neither do repeats of a row. Of two vectors with one id both can be found, and
    as a query their neighbours are merged. All rows come back where there are fewer. An
    empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = lengths["n"]
    rows = rows.filter(F.size("v") == length)
    # of rows with equal vectors only the first can be among the nearest, one more than asked for as one may be the query
    needed = neighbours + 1
    named = rows.select(F.xxhash64("v").alias("h"), "v", "vec_id")
    kept = named.mapInArrow(lambda batches: (first_ids(b, length, needed) for b in batches), named.schema)
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, needed).alias("ids")
    distinct = stage(kept.groupBy("h", "v").agg(ids), "vectors")

    sample_rows = min(SAMPLE, SAMPLE_NUMBERS // length)
    sample = sampled(distinct.select("v"), sample_rows, length)
    tree = build(sample)
    leaves = calibrated_leaves(tree, sample, neighbours, recall, CALIBRATION)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf_of(matrix(batch["v"], length).astype(np.float64))
            found, n = np.unique(leaf, return_counts=True)
            held = np.bincount(leaf, batch["ids"].value_lengths().to_numpy())[found].astype(np.int64)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (found, n, held))), names=["leaf", "n", "held"])

    counts = distinct.select("v", "ids").mapInArrow(counted, "leaf long, n long, held long")
    sizes, held = np.zeros((2, len(tree.count)), np.int64)  # numbers per leaf
    for row in counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).collect():
        sizes[row["leaf"]], held[row["leaf"]] = row["n"], row["held"]

    queries = stage(
        rows.filter(is_query).select("vec_id", "v").distinct().withColumn("asked", F.xxhash64("v")), "queries"
    )
    asked = queries.select("asked").distinct().count()
    kind = rows.schema["v"].dataType
    width = length * (8 if kind.elementType == T.DoubleType() else 4)
    number = max(BUCKETS, -(-int(sizes.sum()) * width // BUCKET_BYTES))
    where = buckets(sizes, number, max(1, -(-asked * (width + WAITING) // WAITING_BYTES)))

    schema = f"bucket int, leaf int, asked long, v {kind.simpleString()}, ids array<long>"
    members = distinct.select("h", "v", "ids").mapInArrow(
        lambda batches: (out for b in batches for out in filed(b, length, shared.value, where)), schema
    )
    each = queries.select("asked", "v").distinct().repartition(max(1, -(-asked // ASKED)))
    calls = each.mapInArrow(
        lambda batches: (out for b in batches for out in called(b, length, shared.value, where, leaves, held, needed)),
        schema,
    )
    # no join, which Spark may broadcast through the driver: it counts a query once, however many leaves it visits
    met = calls.union(members).repartition(where.number(), "bucket").sortWithinPartitions("bucket", "leaf")
    found = met.mapInArrow(lambda batches: sweep(batches, length, needed), "asked long, score double, vec_id long")
    found = smallest(found, ["asked"], ["score", "vec_id"], needed).drop("rank")
    owned = queries.select(F.col("vec_id").alias("query_id"), "asked").hint("merge").join(found, "asked")
    owned = owned.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return smallest(owned, ["query_id"], ["score", "vec_id"], neighbours).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
