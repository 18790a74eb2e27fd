import hashlib

from corpus import documents, with_clashing_columns
from pyspark.sql import functions as F

from paragem.llm import exact_dedup as D

LONG = "One sentence here. " * 900
TEXTS = [
    None, "", "Abc", "aBC", "abd", "É", "é", LONG, LONG.upper(), LONG + "x", "x" + LONG, "b" * 9000, "b" * 9000,
    "b" * 9001, "a.\n" * 4000, "a.\n" * 4000, " ",
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lowered(text), []).append(i)
    out = []
    for i, text in rows:
        ids = groups[lowered(text)]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_groups(spark):
    rows = [*enumerate(TEXTS), (None, "Abc"), (None, "only null ids"), (None, "only null ids"), (3, "aBC")]
    docs = documents(spark, *rows)
    assert rows_of(D.exact_groups(with_clashing_columns(docs))) == brute(rows)


def test_weak_identifiers_cost_no_group(spark):
    rows = list(enumerate(TEXTS))
    weak = D.exact_groups(documents(spark, *rows), lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert rows_of(weak) == brute(rows)


def test_chunks_join_to_the_text(spark):
    docs = documents(spark, *TEXTS).select(F.coalesce("text", F.lit("")).alias("text"))
    assert docs.filter(F.concat_ws("", D.chunks(F.col("text"))) != F.col("text")).count() == 0
    cut = docs.select(F.explode(D.chunks(F.col("text"))).alias("c"))
    assert cut.agg(F.max(F.length("c"))).first()[0] <= D.LONGEST


def test_dropping_keeps_one_of_each_and_all_columns(spark):
    rows = [(1, "A"), (2, "a"), (2, "a"), (5, "b"), (None, "c"), (None, "c"), (7, None), (6, "")]
    docs = documents(spark, *rows)
    kept = D.drop_copies(docs)
    assert kept.schema.names == docs.schema.names
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(2, "a"), (5, "b"), (None, "c"), (7, None)], key=repr
    )
    more = D.drop_copies(with_clashing_columns(docs))
    assert more.count() == 4 and more.columns == with_clashing_columns(docs).columns


def test_empty_table_and_no_python(spark):
    docs = documents(spark, "a").filter("doc_id > 0")
    assert D.exact_groups(docs).collect() == [] and D.drop_copies(docs).collect() == []
    plan = D.exact_groups(documents(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
