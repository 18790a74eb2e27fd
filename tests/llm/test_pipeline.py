"""The whole pipeline against a plain rendering of its stages on small tables."""

import re

import corpus_pipeline
import pytest
from compare import compare

import __spark_entry__ as contract
from paragem.llm import exact_dedup, mixing, simhash
from paragem.llm.queries import queries
from paragem.llm.tables import read

SF = "/root/testdata/sf0.001"
SQL = {name: sql for name, (_, sql) in queries().items() if sql is not None}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, contract.queries()[name], SQL[name], SF) == ""


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in contract.queries() if re.match(r"op\d", n)]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in contract.queries()


def test_stages_take_effect_in_order(spark, tmp_path):
    from corpus import documents

    near = " ".join(f"word{i}" for i in range(300))
    clean = [f"plain text number {i} about topic {i * 7} and {i * 13}" for i in range(30)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(clean)]
    rows += [(100, near, "en", "s0"), (101, near + " more", "en", "s0"), (102, near.upper(), "en", "s0")]
    rows += [(200, "123 456", "en", "s1"), (201, None, "en", "s1")]
    documents(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = read(spark, str(tmp_path), "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert kept["language_id"] == [*range(30), 100, 101, 102]
    assert kept["exact_dedup"] == [*range(30), 101, 102]
    assert 101 in kept["simhash_near_dedup"] and 102 not in kept["simhash_near_dedup"]
    assert set(kept["source_mixing"]) <= set(kept["simhash_near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(set(kept["source_mixing"]))
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    from corpus import documents

    documents(spark, "a").filter("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:2] == ["doc_id", "piece"] and out.collect() == []


def test_pipeline_of_null_ids_and_clashing_columns(spark, tmp_path):
    from corpus import documents, with_clashing_columns

    rows = [(i, f"plain text number {i} about topic {i * 7}", "en" if i % 2 else "de", f"s{i % 3}") for i in range(30)]
    rows += [(None, "a text that has no number of its own", None, None), (None, "1 2 3", "en", "s0")]
    with_clashing_columns(documents(spark, *rows)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} <= {None, *range(30)} and packed
    assert all(r.offset + r.length <= 1024 for r in packed)


def test_stage_results_follow_from_the_operators(spark):
    docs = read(spark, SF, "documents")
    unique = {r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == unique
    first = {r.component_id for r in simhash.near_groups(docs).collect()}
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == first
    times: dict[int, int] = {}
    for r in mixing.draws(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    rows: dict[int, int] = {}
    for r in mixing.mixed(docs).collect():
        rows[r.doc_id] = rows.get(r.doc_id, 0) + 1
    assert rows == times
