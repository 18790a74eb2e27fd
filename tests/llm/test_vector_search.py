import heapq
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paragem.llm import vector_search as V
from paragem.llm import vector_sweep as S
from paragem.llm.kmeans_tree import build, calibrated_leaves, squared

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute(rows, is_query, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(map(_finite, v)) and any(v)}
    out = {}
    for i in {i for i, _ in usable if is_query(i)}:
        best = {}
        for q in (v for j, v in usable if j == i):
            for j, v in usable:
                if j != i:
                    far = math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v, strict=True)))
                    best[j] = min(far, best.get(j, math.inf))
        out[i] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def _finite(x):
    return x is not None and math.isfinite(x)


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100 + i, [float(i), -1.0]) for i in range(12)]
    rows += [(0, [1.0, 2.0]), (200, None), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [math.nan, 1.0])]
    rows += [(600, [math.inf, 1.0]), (None, [1.0, 2.0]), (700, []), (800, [5.0, 5.0]), (800, [1.0, 2.5])]
    got = V.nearest(table(spark, [(*r, 1) for r in rows]), F.col("vec_id") % 100 == 0).collect()
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 2], lambda i: i % 100 == 0, 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_and_scores_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    base = np.array([v for _, v in rows], np.float64)
    got = V.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 10 == 0).collect()
    found, place = {}, {i: k for k, i in enumerate(ids.tolist())}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(np.linalg.norm(base[place[r.query_id]] - base[place[r.vec_id]]), abs=1e-12)
    hits = total = 0
    for q in ids[ids % 10 == 0].tolist():
        far = np.linalg.norm(base - base[place[q]], axis=1)
        far[place[q]] = np.inf
        true = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits, total = hits + len(true & found[q]), total + 10
    assert hits / total >= 0.9


def test_few_rows_and_none(spark):
    pair = table(spark, [(100, [1.0], 1), (7, [2.0], 1)])
    assert [tuple(r) for r in V.nearest(pair, F.col("vec_id") == 100).collect()] == [(100, 1, 7, 1.0)]
    assert V.nearest(pair.filter("vec_id = 100"), F.lit(True)).collect() == []
    assert V.nearest(pair.filter("vec_id < 0"), F.lit(True)).collect() == []


def test_traversal_visits_every_leaf_once_and_nearest_first():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(3000, 8))
    tree = build(sample)
    held = np.bincount(tree.leaf_of(sample), minlength=len(tree.count))
    assert held[tree.leaves].sum() == 3000
    seen = tree.best_bins(sample[5], len(tree.count), held, 0)
    assert sorted(seen) == sorted(np.flatnonzero(held).tolist())
    assert len(tree.best_bins(sample[5], 1, held, 200)) > 1
    leaves = calibrated_leaves(tree, sample, 10, 0.95, 64)
    leaf, far = tree.leaf_of(sample), squared(sample[:40], sample)
    found = 0
    for q in range(40):
        near = np.argsort(far[q])[1:11]
        found += np.isin(leaf[near], tree.best_bins(sample[q], leaves, held, 0)).sum()
    assert found / 400 >= 0.9


def test_queries_meet_their_leaves_without_a_broadcast(spark):
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist(), 1) for i in range(2000)]
    found = V.nearest(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert len(found.collect()) == 2000
    # the plan as made and as run; a broadcast would bring each query to the driver once for each leaf it visits
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_parts_and_spread_leaves_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v, 1) for i, v in enumerate(np.round(rng.normal(size=(900, 3)), 1).tolist())]
    rows += [(2000 + i, [0.5, 0.5, 0.5], 1) for i in range(60)]
    want = sorted(map(tuple, V.nearest(table(spark, rows), F.col("vec_id") % 5 == 0).collect()))
    monkeypatch.setattr(V, "BUCKETS", 100)
    monkeypatch.setattr(V, "WAITING_BYTES", 30_000)
    assert sorted(map(tuple, V.nearest(table(spark, rows), F.col("vec_id") % 5 == 0).collect())) == want
    assert V.nearest(table(spark, rows), F.lit(False)).collect() == []


def test_sweep_finds_the_nearest_rows_of_the_visited_leaves():
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(size=(5000, 4)), 1).astype(np.float32)  # with ties
    leaf, counts = np.sort(rng.integers(0, 3, 5000)), rng.integers(1, 4, 5000)
    ids = rng.permutation(int(counts.sum()))
    own = np.split(ids, np.cumsum(counts)[:-1])
    asked = base[:300] + np.float32(0.25)
    visited = [np.flatnonzero(rng.random(3) < 0.7) for _ in asked]
    lists = pa.array([x.tolist() for x in visited] + [x.tolist() for x in own], pa.list_(pa.int64()))
    vectors = pa.array([*asked.tolist(), *base.tolist()], pa.list_(pa.float32()))
    key = np.concatenate([np.arange(300) + 7000, np.zeros(5000, np.int64)])
    where = np.concatenate([np.full(300, S.QUERY), leaf])
    batch = S.row_batch(np.ones(5300), where, pa.array(key), vectors, lists)
    other = S.row_batch(np.zeros(5), np.zeros(5), pa.array(key[-5:]), vectors[-5:], lists[-5:])
    got = {}
    for b in S.sweep(iter([other, *(batch.slice(k, 777) for k in range(0, 5300, 777))]), 4, 11):
        for q, s, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(q - 7000, []).append((s, i))
    for q in range(300):
        rows = [k for k in range(5000) if leaf[k] in visited[q]]
        far = np.sqrt(((base[rows].astype(float) - asked[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((float(d), int(i)) for d, k in zip(far, rows, strict=True) for i in own[k])[:11]
        assert got.get(q, []) == want


def test_first_ids_of_repeated_vectors():
    rows = [(1, [0.0, 1.0], i % 40) for i in range(100)] + [(1, [2.0, 1.0], 3), (2, [-0.0, 1.0], 9), (2, [0.0, 1.0], 9)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows])],
        names=["h", "v", "vec_id"],
    )
    kept = [(r["h"], r["vec_id"]) for r in S.first_ids(batch, 2, 3).to_pylist() if r["v"][0] != 2]
    assert {(1, 0), (1, 1), (1, 2)} <= set(kept) and kept.count((2, 9)) == 1 and len(kept) <= 7
    assert [2.0, 1.0] in S.first_ids(batch, 2, 3)["v"].to_pylist()


def test_buckets_hold_each_leaf_and_share_the_vectors():
    sizes = np.array([0, 5, 900, 7, 0, 40, 60, 3])
    where = S.buckets(sizes, 10, 2)
    used = [set(range(f, f + s)) for f, s, n in zip(where.first, where.spread, sizes, strict=True) if n]
    assert where.spread.tolist() == [1, 1, 9, 1, 1, 1, 1, 1] and where.number() == 2 * len(set.union(*used))
    assert all(not used[1] & other for k, other in enumerate(used) if k != 1)


def test_visits_follow_a_queue():
    rng = np.random.default_rng(6)
    tree = build(rng.normal(size=(4000, 5)))
    held = rng.integers(0, 3, len(tree.count))

    def queue(query, leaves, needed):
        waiting, found, rows = [(0.0, 0)], [], 0
        while waiting and (len(found) < leaves or rows < needed):
            node = heapq.heappop(waiting)[1]
            for child in range(tree.first[node], tree.first[node] + tree.count[node]):
                heapq.heappush(waiting, (float(((query - tree.centres[child]) ** 2).sum()), child))
            if not tree.count[node] and held[node]:
                found, rows = [*found, node], rows + held[node]
        return found

    queries = rng.normal(size=(30, 5))
    for leaves, needed in ((1, 0), (1, 11), (20, 11), (1000, 5), (2, 10**6)):
        want = [queue(q, leaves, needed) for q in queries]
        assert [v.tolist() for v in tree.visits(queries, leaves, held, needed)] == want
