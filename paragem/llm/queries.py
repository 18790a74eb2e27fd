"""The operators as named queries over whole tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragem.llm import (
    collocations,
    exact_dedup,
    language,
    license_scan,
    mixing,
    packing,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    unigram,
    url_filter,
    vector_search,
)
from paragem.llm.tables import LOWER, UPPER, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(read(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read(spark, sf_dir, "documents"), passage=substring_dedup.PASSAGE)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(read(spark, sf_dir, "documents"), PIECES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Name, callable and SQL (None where SQL cannot state the result)."""
    return {
        "op1_language_id": (op1_language_id, None),
        "op2_nearest_neighbours": (op2_nearest_neighbours, None),
        "op3_substring_dedup": (op3_substring_dedup, None),
        "op4_token_counts": (op4_token_counts, None),
        "op5_license_scan": (op5_license_scan, license_scan.scan_sql()),
        "op6_toxicity": (op6_toxicity, None),
        "op7_best_fit_packing": (op7_best_fit_packing, None),
        "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
        "op9_source_mixing": (op9_source_mixing, None),
        "op10_simhash_near_dedup": (op10_simhash_near_dedup, None),
        "op11_collocations": (op11_collocations, collocations.collocations_sql()),
        "op12_url_filter": (op12_url_filter, url_filter.judge_sql()),
        "op13_spelling_variants": (op13_spelling_variants, None),
    }
