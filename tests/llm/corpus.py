"""Small tables for the text operators."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *texts, lang="en", source="s"):
    """One row per text, ids from 0; a row may also be (id, text) or (id, text, lang, source)."""
    rows = []
    for i, row in enumerate(texts):
        row = (i, row) if isinstance(row, str) or row is None else row
        row = (*row, lang, source)[:4] if len(row) == 2 else row
        rows.append((*row, len(row[1] or "")))
    return spark.createDataFrame(rows, SCHEMA)


def with_clashing_columns(docs):
    """``docs`` with more columns that bear the names of results and helpers."""
    names = (
        "keep_id kept key mark row score grade toxic length rank piece offset component_id fingerprint epoch tokens "
        "copies hash drawn_id own_hash kept_id text_sha256 lang_pred guess"
    )
    return docs.withColumns({n: F.lit("x") for n in names.split()})
