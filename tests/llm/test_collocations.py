"""Collocations against plain counting and against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect, rows_of
from corpus import documents, with_clashing_columns

from paragem.llm import collocations as C
from paragem.llm.queries import op11_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000):
    """``rows``: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(words[i : i + size] for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(100 * b >= 50 * a and (q[:2] == p or q[1:] == p) for q, b in candidates.items() if len(q) == 3 > len(p)):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, texts, words=25):
    rng = random.Random(seed)
    vocabulary = [f"{c}{k}" for c in "aéB中" for k in range(words // 4)] + ["of", "the", "New", "york", "city"]
    out = []
    for _ in range(texts):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["New York City", "of the", *rng.choices(vocabulary, k=8)])
            text += rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ",", "\x0b", " "])
        out.append((rng.choice(["en", "en", "de", None]), text))
    return out


def docs_of(spark, rows):
    return documents(spark, *[(i, text, lang, "s") for i, (lang, text) in enumerate(rows)])


def test_equal_to_plain_counting(spark):
    rows = corpus(1, 400, 12)
    want = plain(rows)
    assert len(want) > 60
    assert got(C.collocations(docs_of(spark, rows))) == want


@pytest.mark.parametrize("block, size, parts", [(40, 30, 5), (3, 1, 11), (200, 1 << 20, 200)])
def test_blocks_slices_and_ranges_change_nothing(spark, monkeypatch, block, size, parts):
    rows = corpus(block, 60)
    monkeypatch.setattr(C, "SLICE", size)
    monkeypatch.setattr(C, "OPEN", 1)
    real = C.blocks
    monkeypatch.setattr(C, "blocks", lambda docs: real(docs, block))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(C.collocations(docs_of(spark, rows), 3)) == plain(rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_first_phrases_in_byte_order_of_ties(spark):
    text = ". ".join(f"{c}x {c}y" for c in ["b", "é", "a", "中", "\x01", "😀", "￮"])
    rows = [("en", text)] * 12
    want = plain(rows, top=4)
    assert len(want) == 4 and got(C.collocations(docs_of(spark, rows), top=4)) == want


def test_products_beyond_64_bits(spark):
    big = 3 * 10**9
    rows = [(1, 2, -1, big, big + 5, 0, big + 7, 0), (1, 2, 3, big, big + 5, big + 1, big + 2, big + 3)]
    phrases = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, n long, l1 long, l2 long, r1 long, r2 long")
    out = {r["w3"]: tuple(r)[3:] for r in C.scored(phrases).collect()}
    million = 1_000_000 * big * big
    early, late = million // ((big + 5) * (big + 3)), million // ((big + 1) * (big + 2))
    assert out[-1] == (big, big + 5, big + 7, million // ((big + 5) * (big + 7)))
    assert out[3] == ((big, big + 1, big + 2, late) if late < early else (big, big + 5, big + 3, early))


def test_largest_keys_of_a_block_fit():
    base = 1 << 21
    places = np.array([1, base, base, base], np.int32)
    frames = list(C.block_phrases(0, places, np.arange(base), np.arange(1, base + 1)))
    assert frames[1].values.tolist() == [[0, base - 1, base - 1, 1], [base - 1] * 3 + [1]]


def test_nulls_empty_and_long_texts_repeats_and_clashing_columns(spark):
    rows = [("en", None), (None, None), ("de", ""), ("de", " .,\n"), (None, "one two " * 12), ("und", "one two. " * 3)]
    rows += [("en", "Hot words here. ")] * 15
    rows += [("fr", "mot " * 200_000 + "x" * 2_000_000 + " fin de mot" * 50_000)]
    docs = with_clashing_columns(docs_of(spark, rows)).selectExpr("*", "'x' AS block", "'x' AS w1", "'x' AS part", "'x' AS n")
    assert got(C.collocations(docs)) == plain(rows)


def test_empty_tables(spark):
    assert got(C.collocations(documents(spark))) == []
    assert got(C.collocations(documents(spark, "once only"))) == []


def test_query_equals_its_sql(spark, tmp_path):
    assert compare(spark, op11_collocations, C.collocations_sql(), "/root/testdata/sf0.001") == ""
    docs_of(spark, corpus(9, 80)).write.parquet(str(tmp_path / "documents.parquet"))
    con = connect("/none")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = con.execute(C.collocations_sql())
    want = rows_of([d[0] for d in result.description], result.fetchall())
    df = op11_collocations(spark, str(tmp_path))
    assert want[1] and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
