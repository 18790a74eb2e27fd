"""Packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragem.llm.packing_plan import plan
from paragem.llm.tokens import encoder
from paragem.session import stage

CAPACITY, END = 1024, 2
#: Texts tokenised together in a task.
TEXTS = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences, the rest in front."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is the end token alone.
    """

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part, rows = batch.iloc[at : at + TEXTS], []
                for doc_id, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]]), strict=True):
                    all_ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, (start, length) in enumerate(cuts(len(all_ids), capacity)):
                        own = all_ids[start : start + length]
                        row = (None if pd.isna(doc_id) else int(doc_id), k, start, length, zlib.crc32(own.tobytes()))
                        rows.append((*row, own.astype(np.int32)) if with_ids else row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        tokenised, PIECES + ", ids array<int>" * with_ids
    )


def ranked(cut: DataFrame, most: int) -> DataFrame:
    """``cut`` with the 0-based ``rank`` of each piece among those of its length.

    ``most`` is the largest number of pieces of one length. Each length is dealt to about
    the root of it in buckets by hash; pieces are numbered inside a bucket and
    buckets summed up, so a length that many pieces share meets in no task.
    """
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, round(most**0.5)))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    numbered = dealt.withColumn("inside", inside)
    return numbered.join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))


def places(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Per length rows (first rank, first sequence, times per sequence, offset), by rank.

    A few thousand kinds of sequences with a few lengths each, whatever the number of pieces.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    placed, sequence = dict.fromkeys(histogram, 0), 0
    for contents, count in plan(histogram, capacity):
        offset = 0
        for length, times in contents:
            rows[length].append((placed[length], sequence, times, offset))
            placed[length] += times * count
            offset += length * times
        sequence += count
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each piece of ``docs`` with its ``sequence_id`` and ``offset``.

    A document is its ids and the end token; one of over ``capacity`` tokens is cut into
    pieces of ``capacity``, the first taking what is over. Repeated rows are packed once
    each, null ids too, a null text as an empty one. Which of several pieces of one length
    goes where follows id, piece and content. An empty table gives an empty result.
    """
    cut = stage(pieces(docs, tokenizer, capacity, end), "pieces")
    histogram = dict(cut.groupBy("length").count().collect())  # ``capacity`` rows at most
    table = cut.sparkSession.sparkContext.broadcast(places(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(length), 2), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            rows = table.value[int(n)]
            row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
            step = rank[own] - row[:, 0]
            out[own] = np.column_stack((row[:, 1] + step // row[:, 2], row[:, 3] + step % row[:, 2] * n))
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    numbered = ranked(cut, max(histogram.values(), default=1)).withColumn("place", place("length", "rank"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
