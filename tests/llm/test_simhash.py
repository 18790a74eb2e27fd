import random
import re

import numpy as np
import xxhash
from corpus import documents, with_clashing_columns

from paragem.llm import components as C
from paragem.llm import simhash as S
from paragem.llm.components import components
from paragem.session import stage


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts(n):
    rng = random.Random(5)
    base = [" ".join(rng.choices("ab cd éf gh ij".split(), k=rng.randrange(1, 400))) for _ in range(n)]
    near = []
    for text in base:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "new"
        near.append("  ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return [None, "", " \t\n", "one", "One", "one two", *base, *near, *near[:3]]


def test_against_all_pairs(spark):
    rows = texts(60)
    prints = {i: fingerprint(t) for i, t in enumerate(rows)}
    want = roots(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = S.near_groups(with_clashing_columns(documents(spark, *rows)), tile=8).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{prints[i]:016x}", want[i]) for i in prints)


def test_tiles_link_what_all_pairs_link():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 2), dtype=np.uint64)
    all_ = np.unique((seeds[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel())
    ones = np.bitwise_count(all_)
    for p in np.unique(ones):
        for q in range(p, min(p + 4, 64)):
            a, b = all_[ones == p], all_[ones == q]
            if not len(a) or not len(b):
                continue
            x, y = S.tile_links(a, b, 3)
            assert np.all(np.bitwise_count(x) >= 0) and len(x) <= len(a) + len(b)
            nodes = sorted({*a.tolist(), *b.tolist()})
            edges = set(zip(x.tolist(), y.tolist(), strict=True))
            apart = roots(nodes, lambda m, n, e=edges: (m, n) in e or (n, m) in e)
            side = set(a.tolist()), set(b.tolist())
            facing = lambda m, n, s=side: (m in s[0] and n in s[1]) or (n in s[0] and m in s[1])
            assert apart == roots(nodes, lambda m, n, f=facing: f(m, n) and (m ^ n).bit_count() <= 3)


def test_ties_of_ids_nulls_and_dropping(spark):
    docs = documents(spark, (None, "a b c d"), (4, "a b c d"), (4, "A b c d"), (None, "z y x w"), (9, "q"))
    got = sorted(((r.doc_id, r.component_id) for r in S.near_groups(docs).collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=repr)
    kept = S.drop_near_copies(documents(spark, "a b c d", "a b c D", "other words", None, ""))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == docs.columns


def test_empty_table(spark):
    docs = documents(spark, "a").filter("doc_id > 0")
    assert S.near_groups(docs).collect() == [] and S.drop_near_copies(docs).collect() == []


def test_components_of_a_chain_a_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (1, 0)]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    by_root = {}
    for r in found:
        by_root.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, by_root.values())) == [list(range(51)), list(range(100, 140))]


def test_rounds_write_files_by_their_rows(spark, monkeypatch):
    files = {}

    def counted(df, label, *rows):
        out = stage(df, label, *rows)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    for module in (C, S):
        monkeypatch.setattr(module, "stage", counted)
    docs = documents(spark, *((i, f"a{i} b{i % 40} c{i % 9}") for i in range(200)))
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = {r.component_id for r in S.near_groups(docs, radius=20).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    prints = {r: fingerprint(f"a{r} b{r % 40} c{r % 9}") for r in range(200)}
    assert found == set(roots(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 20).values())
    assert len(files["points"]) > 1
    small = [n for label in ("distinct-fingerprints", "edges", "points", "roots") for n in files[label]]
    assert max(small) == 1


def test_one_row_of_each_component_stays(spark):
    rows = [(5, "one two three four"), (3, "One two three four"), (3, "one TWO three four"), (None, "one two three four"),
            (None, "alone in the world"), (None, "alone in the World"), (9, None), (8, ""), (8, "")]
    docs = with_clashing_columns(documents(spark, *rows))
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [i for i, _ in found] == [3, 8, None]
    assert S.drop_near_copies(docs.filter("doc_id > 99")).count() == 0
