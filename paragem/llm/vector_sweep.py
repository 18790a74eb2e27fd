"""The search inside one task: queries of a bucket of leaves wait, its vectors pass by leaf by leaf.

Tables come as Arrow batches; ``v`` has lists of one length without nulls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from paragem.llm.kmeans_tree import Tree

#: Vectors and queries compared at once, and queries whose leaves are looked up at once.
BLOCK, ASKED = 1024, 256
#: Queries whose rows are handed on at once.
RESULT = 4096
#: Leaf of the rows that are queries; these sort before the vectors of their bucket.
QUERY = -1


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def first_ids(batch: pa.RecordBatch, length: int, n: int) -> pa.RecordBatch:
    """Of the rows (h, v, vec_id) those with the ``n`` least ids of each vector ``v``; ``h`` is a hash of ``v``.

    Cuts what a frequent vector sends on. Vectors that share a hash may keep more.
    """
    h, ids, v = batch["h"].to_numpy(), batch["vec_id"].to_numpy(), matrix(batch["v"], length)
    order = np.lexsort((ids, h))
    alike = np.zeros(len(order), bool)
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    alike[near + 1] = (v[order[near]] == v[order[near + 1]]).all(axis=1)
    repeats = alike.copy()
    repeats[1:] &= ids[order[1:]] == ids[order[:-1]]
    order, alike = order[~repeats], alike[~repeats]
    place = np.arange(len(order))
    rank = place - np.maximum.accumulate(np.where(alike, 0, place))
    return batch.take(pa.array(np.sort(order[rank < n])))


@dataclass(frozen=True)
class Buckets:
    """A leaf's vectors lie in ``spread`` buckets from ``first`` on; queries are dealt to ``parts`` of each bucket."""

    first: np.ndarray
    spread: np.ndarray
    parts: int

    def number(self) -> int:
        return int((self.first + self.spread).max(initial=1)) * self.parts


def buckets(sizes: np.ndarray, number: int, parts: int) -> Buckets:
    """About ``number`` buckets: runs of leaves with as many vectors, a leaf with more has several of its own."""
    full = max(1, -(-int(sizes.sum()) // number))
    first, spread = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, filled = 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if not n:
            continue
        if filled and filled + n > full:
            at, filled = at + 1, 0
        first[leaf], spread[leaf] = at, -(-n // full)
        if n >= full:
            at, filled = at + int(spread[leaf]), 0
        else:
            filled += n
    return Buckets(first, spread, parts)


def filed(batch: pa.RecordBatch, length: int, tree: Tree, where: Buckets) -> Iterator[pa.RecordBatch]:
    """Rows (h, v, ids) as (bucket, leaf, asked, v, ids), once for each part."""
    leaf = tree.leaf_of(matrix(batch["v"], length).astype(np.float64))
    bucket = where.first[leaf] + batch["h"].to_numpy() % where.spread[leaf]
    for part in range(where.parts):
        yield row_batch(bucket * where.parts + part, leaf, batch["h"], batch["v"], batch["ids"])


def called(
    batch: pa.RecordBatch, length: int, tree: Tree, where: Buckets, leaves: int, held: np.ndarray, needed: int
) -> Iterator[pa.RecordBatch]:
    """Queries (asked, v) as (bucket, QUERY, asked, v, ids) for each bucket they visit; ``ids`` has its leaves."""
    for at in range(0, len(batch), ASKED):
        some = batch.slice(at, ASKED)
        asked = some["asked"].to_numpy()
        to, own, wanted, counts = [], [], [], []
        for k, seen in enumerate(tree.visits(matrix(some["v"], length).astype(np.float64), leaves, held, needed)):
            spread = where.spread[seen]
            step = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
            bucket = np.repeat(where.first[seen], spread) + step
            order = np.argsort(bucket, kind="stable")
            visited, n = np.unique(bucket, return_counts=True)
            to.append(visited * where.parts + asked[k] % where.parts)
            own.append(np.full(len(visited), k))
            wanted.append(np.repeat(seen, spread)[order])
            counts.append(n)
        rows = pa.array(np.concatenate(own))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        seen = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wanted)))
        yield row_batch(np.concatenate(to), np.full(len(rows), QUERY), some["asked"].take(rows), some["v"].take(rows), seen)


def row_batch(bucket: np.ndarray, leaf: np.ndarray, asked: pa.Array, v: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(bucket.astype(np.int32)), pa.array(leaf.astype(np.int32)), asked, v, ids]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "leaf", "asked", "v", "ids"])


class Waiting:
    """Some queries of a bucket with the rows nearest to each so far, at most ``n`` by distance and id."""

    def __init__(self, asked: np.ndarray, vectors: np.ndarray, rows: np.ndarray, leaves: np.ndarray, n: int) -> None:
        """Query ``rows[k]`` visits ``leaves[k]``."""
        self.asked, self.vectors, self.n = asked, vectors, n
        order = np.lexsort((rows, leaves))
        self.rows, self.leaves = rows[order], leaves[order]
        self.score = np.full((len(asked), n), np.inf)
        self.found = np.zeros((len(asked), n), np.int64)
        self.count = np.zeros(len(asked), np.int32)

    def meet(self, leaf: int, vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Vectors of a leaf pass by; vector k has ``counts[k]`` of the ``ids``."""
        own = self.rows[slice(*np.searchsorted(self.leaves, [leaf, leaf + 1]))]
        starts = np.cumsum(counts) - counts
        for at in range(0, len(vectors) if len(own) else 0, BLOCK):
            base = vectors[at : at + BLOCK].astype(np.float64)
            squares = np.column_stack([base, (base * base).sum(axis=1)])
            for k in range(0, len(own), ASKED):
                row, member, score = self.near(own[k : k + ASKED], base, squares)
                n = counts[at + member]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self.keep(np.repeat(row, n), np.repeat(score, n), ids[np.repeat(starts[at + member], n) + step])

    def near(
        self, rows: np.ndarray, base: np.ndarray, squares: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of query and vector that can be among the nearest, with their distances.

        A matrix product tells them up to rounding, which the bound allows for; distances are then taken one by one.
        ``squares`` are the vectors of ``base`` with their squared lengths as one number more.
        """
        asked = self.vectors[rows].astype(np.float64)
        own = (asked * asked).sum(axis=1)
        slack = 8 * (base.shape[1] + 4) * np.finfo(np.float64).eps * (own + squares[:, -1].max())
        far = np.column_stack([-2 * asked, np.ones(len(asked))]) @ squares.T
        bound = self.score[rows, -1] ** 2 - own + slack
        if (few := np.flatnonzero(self.count[rows] < self.n)).size:
            last = min(self.n, len(base)) - 1
            bound[few] = np.partition(far[few], last, axis=1)[:, last] + 2 * slack[few]
        row, member = np.divmod(np.flatnonzero(~(far > bound[:, None])), len(base))
        return rows[row], member, np.sqrt(((base[member] - asked[row]) ** 2).sum(axis=1))

    def keep(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(rows)
        old, place = self.held(touched)
        rows, score = np.concatenate([old, rows]), np.concatenate([self.score[old, place], score])
        ids = np.concatenate([self.found[old, place], ids])
        order = np.lexsort((ids, score, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = rank < self.n
        rows, rank, order = rows[kept], rank[kept], order[kept]
        self.score[rows, rank], self.found[rows, rank] = score[order], ids[order]
        np.maximum.at(self.count, rows, (rank + 1).astype(np.int32))

    def held(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of each row found for the ``queries``."""
        own, place = np.nonzero(np.arange(self.n) < self.count[queries][:, None])
        return queries[own], place

    def result(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.asked), RESULT):
            own, place = self.held(np.arange(at, min(at + RESULT, len(self.asked))))
            columns = [self.asked[own], self.score[own, place], self.found[own, place]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["asked", "score", "vec_id"])


def sweep(batches: Iterator[pa.RecordBatch], length: int, n: int) -> Iterator[pa.RecordBatch]:
    """(asked, score, vec_id) of the ``n`` nearest rows of each query in each bucket.

    Rows (bucket, leaf, asked, v, ids) come sorted by bucket and leaf, so a bucket's queries come first.
    """
    at, waiting = None, []
    for batch in batches:
        bucket, leaf = batch["bucket"].to_numpy(), batch["leaf"].to_numpy()
        asked, vectors, ids = batch["asked"].to_numpy(), matrix(batch["v"], length), batch["ids"].flatten().to_numpy()
        ends = np.cumsum(batch["ids"].value_lengths().to_numpy())
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(leaf) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if low == high:
                continue
            if at != bucket[low]:
                for queries in waiting:
                    yield from queries.result()
                at, waiting = bucket[low], []
            counts = np.diff(ends[low:high], prepend=ends[low - 1] if low else 0)
            held = ids[ends[low] - counts[0] : ends[high - 1]]
            if leaf[low] == QUERY:
                rows = np.repeat(np.arange(high - low, dtype=np.int32), counts)
                # copies, as views would hold the whole batch
                waiting.append(Waiting(asked[low:high].copy(), vectors[low:high].copy(), rows, held.astype(np.int32), n))
            else:
                for queries in waiting:
                    queries.meet(int(leaf[low]), vectors[low:high], held, counts)
    for queries in waiting:
        yield from queries.result()
