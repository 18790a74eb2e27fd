"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (at a sentence end or line break once
a chunk has ``SHORTEST`` characters), and becomes the ordered list of its chunks'
identifiers. Long texts move once, as distinct chunks, to verify that every
identifier stands for one content; after that only the lists are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragem.llm.tables import lower_ascii
from paragem.session import stage

SHORTEST, LONGEST = 512, 4096
#: A chunk ends at the first sentence end or line break after SHORTEST characters, at LONGEST or with the text.
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST - 1}}}?[.\n]|.{{1,{LONGEST}}}"


def chunks(text: Column) -> Column:
    """The chunks of ``text`` in order; joined together they are the text, an empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def shared_identifiers(cut: DataFrame, chunk_id: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for more than one content, from the distinct chunks of column ``chunks``."""
    distinct = cut.select(F.explode("chunks").alias("chunk")).select(chunk_id(F.col("chunk")).alias("id"), "chunk")
    return distinct.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("id")


def exact_groups(docs: DataFrame, chunk_id: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty
    one, and empty texts are equal. The largest doc_id of a group stays. A null
    doc_id never stays beside another id; a group of null ids has keep_id null and
    stays. Rows repeating the id that stays are all marked as kept. Other columns
    of ``docs`` are not read. An empty table gives an empty result.

    ``chunk_id`` names a chunk in a long. Where it gives two contents one name, the
    texts holding such a chunk are told apart by the digest of the whole text, so a
    weak name costs time and never a wrong group.
    """
    text = docs.select("doc_id", lower_ascii(F.col("text")).alias("text"))
    cut = text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    recipes = stage(
        cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: chunk_id(c)).alias("recipe")), "recipes"
    )
    shared = stage(shared_identifiers(text.select(chunks(F.col("text")).alias("chunks")), chunk_id), "shared-ids")
    if shared.isEmpty():
        keyed = recipes.withColumn("unsure", F.lit(""))
    else:
        unsure = recipes.select("text_sha256", F.explode("recipe").alias("id")).join(shared, "id", "left_semi")
        unsure = unsure.select("text_sha256", F.col("text_sha256").alias("unsure")).distinct()
        keyed = recipes.join(unsure, "text_sha256", "left").withColumn("unsure", F.coalesce("unsure", F.lit("")))
    groups = keyed.groupBy("recipe", "unsure").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return keyed.join(groups, ["recipe", "unsure"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows repeating id and text one stays."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    named = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("kept_id"),
        F.sha2(lower_ascii(F.col("text")), 256).alias("text_sha256"),
    )
    same = named["kept_id"].eqNullSafe(kept["kept_id"]) & (named["text_sha256"] == kept["text_sha256"])
    return (
        named.join(kept, same, "left_semi")
        .dropDuplicates(["kept_id", "text_sha256"])
        .select("row.*")
    )
