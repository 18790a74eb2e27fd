"""SimHash near-duplicates by exact comparison of tiles.

Equal fingerprints collapse first. The distinct ones lie in tiles by population
count; a pair of tiles is compared only if the counts differ by the radius at most,
since each differing bit changes the count by one. Inside a pair the same bound
holds for the lower halves. A compared pair hands on a spanning forest of its links,
never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paragem.llm.components import components
from paragem.llm.tables import LOWER_BYTES
from paragem.session import stage

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints in a tile: 64 KB of them.
TILE = 8192
#: Rows of a tile compared at once; with a full tile opposite, 2 million bit counts.
STRIP = 256
BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of each run of ``shingle`` words, lower-cased in A-Z; of all words if they are fewer, none without words."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width].tolist(), ends[width:].tolist(), strict=True)
    return np.array([digest(joined[i:j], SEED) for i, j in spans], dtype="<u8")


def fingerprint(text: str | None) -> int:
    """Bit i is set when over half the hashes of the text's shingles have it, repeats counted; 0 without words."""
    hashes = shingle_hashes(text, SHINGLE)
    if not len(hashes):
        return 0
    places = hashes.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BITS_OF_BYTE
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of each i and j; ``parent`` holds every node's root before and after."""
    while True:
        a, b = parent[i], parent[j]
        if np.array_equal(a, b):
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of unsigned fingerprints, each of one population count."""
    low = np.uint64(0xFFFFFFFF)
    count_left, count_right = np.bitwise_count(left & low), np.bitwise_count(right & low)
    by_left, by_right = np.argsort(count_left, kind="stable"), np.argsort(count_right, kind="stable")
    left, right, count_left = left[by_left], right[by_right], count_left[by_left].astype(np.int64)
    count_right = count_right[by_right].astype(np.int64)
    nodes = np.concatenate((left, right))
    parent = np.arange(len(nodes))
    more = int(np.bitwise_count(right[0])) - int(np.bitwise_count(left[0]))
    # |d| + |more - d| <= radius, d being the difference of the lower halves' counts
    least, most = -((radius - more) // 2), (radius + more) // 2
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        counts = count_left[at : at + STRIP]
        first = np.searchsorted(count_right, counts[0] + least)
        last = np.searchsorted(count_right, counts[-1] + most, side="right")
        i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ right[None, first:last]) <= radius)
        parent = merge(parent, i + at, j + first + len(left))
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect what links of ``radius`` connect, from a table of distinct ``fingerprint``."""
    counted = fingerprints.select("fingerprint", F.bit_count("fingerprint").alias("ones"))
    sizes = dict(counted.groupBy("ones").count().collect())  # 65 rows at most
    parts = F.array(*[F.lit(max(1, -(-sizes.get(n, 0) // tile))) for n in range(65)])
    tiles = stage(
        counted.withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts[F.col("ones")]).cast("int"))
        .groupBy("ones", "part")
        .agg(F.collect_list("fingerprint").alias("bits"))  # about ``tile`` of them, by the hash
        .select("ones", "part", "bits"),
        "tiles",
    )
    names = tiles.select("ones", "part")
    near = names.select("*", F.explode(F.sequence("ones", F.col("ones") + radius)).alias("ones_b"))
    pairs = near.join(names.toDF("ones_b", "part_b"), "ones_b").filter("ones < ones_b or part <= part_b")
    facing = pairs.join(tiles, ["ones", "part"]).join(tiles.toDF("ones_b", "part_b", "bits_b"), ["ones_b", "part_b"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y in zip(batch["bits"], batch["bits_b"], strict=True):
                a, b = tile_links(np.asarray(x).astype(np.uint64), np.asarray(y).astype(np.uint64), radius)
                # a forest over both tiles: where one fingerprint stands in both, its two nodes are linked
                yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return facing.select("bits", "bits_b").mapInPandas(compare, "a long, b long")


def named_components(distinct: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, component_id): the smallest ``first`` of the nodes of ``distinct`` that have one root; others stand alone."""
    rooted = distinct.join(roots, node, "left").withColumn("root", F.coalesce("root", node))
    rooted = stage(rooted, "roots", distinct.count())
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select(node, "component_id")


def near_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in ``radius`` bits or fewer are linked; a component is
    what links reach, and component_id its smallest doc_id. Texts without words,
    null ones included, have fingerprint zero and are linked like any other. Null
    ids are ignored for component_id, which is null only if all ids of the component
    are. Repeated rows come back once each. An empty table gives an empty result.
    """
    marked = stage(docs.select("doc_id", fingerprint_column("text").alias("fingerprint")), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    distinct = stage(distinct, "distinct-fingerprints", marked.count())
    roots = components(fingerprint_links(distinct, radius, tile), about=distinct.count()).toDF("fingerprint", "root")
    named = named_components(distinct, roots, "fingerprint")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of ``near_groups``, with its columns: that of the smallest id.

    Rows without id stay only where none of their component has one. Of rows that share the
    smallest id, or have none, that of the least digest of its text stays; rows equal in id
    and text are one. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.sha2(text, 256).alias("digest"))
    marked = stage(docs.select(own.alias("own"), fingerprint_column("text").alias("fingerprint")), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min("own").alias("first"))
    distinct = stage(distinct, "distinct-fingerprints", marked.count())
    roots = components(fingerprint_links(distinct), about=distinct.count()).toDF("fingerprint", "root")
    kept = named_components(distinct, roots, "fingerprint").select("component_id.*").distinct().toDF("nameless", "kept_id", "digest")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("kept_id"), F.sha2(text, 256).alias("digest"))
    same = named["kept_id"].eqNullSafe(kept["kept_id"]) & (named["digest"] == kept["digest"])
    return named.join(kept, same, "left_semi").dropDuplicates(["kept_id", "digest"]).select("row.*")
