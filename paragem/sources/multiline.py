"""CSV records whose texts hold line breaks, read by many tasks from one file.

A line break ends a record where an even number of quotes stands before it. Files are read
by lines, in as many byte ranges as Spark cuts them into. The quotes of each range are
counted first, which tells for every range whether it begins inside a text; then each
range puts its own records together, and only what reaches over an edge meets again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragem.session import stage

QUOTE = '"'
BYTE_ORDER_MARK = "\ufeff"


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(QUOTE), F.lit("")))


def _joined(order: str) -> Column:
    """The texts of a group, one per line, in the order of a column."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n")


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): the text of each record of the CSV files at ``path``; with ``header`` without each file's first.

    Two scans. A range is shuffled to one task by its name, so no task holds more than
    Spark's size of a file partition; of every range at most its first and last fragment
    meet those of its neighbours, in one small window per file.
    """
    place = ["file", "range"]
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
    )
    counted = lines.groupBy(*place).agg(F.sum(_quotes(F.col("text"))).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opened = counted.select(*place, F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))

    before = Window.partitionBy(*place).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(*place).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ahead = lines.repartition(*place).withColumn("ahead", F.coalesce(F.sum(_quotes(F.col("text"))).over(before), F.lit(0)))
    begins = ((F.col("before") + F.col("ahead")) % 2 == 0).cast("int")
    # ranges are few: their join side is small
    marked = ahead.join(F.broadcast(opened), place).withColumn("record", F.sum(begins).over(up_to))
    whole = marked.groupBy(*place, "record").agg(_joined("line").alias("text"))
    last = Window.partitionBy(*place)
    fragments = stage(whole.withColumn("last", F.max("record").over(last)), "csv-records")

    inner = fragments.filter("0 < record and record < last").select(*place, "record", "text")
    # A record that begins in a range goes on through the beginnings (record 0) of the next ones.
    edges = fragments.filter("record = 0 or record = last")
    in_order = Window.partitionBy("file").orderBy("range", "record")
    owned = edges.withColumn("owner", F.sum((F.col("record") > 0).cast("int")).over(in_order))
    owned = owned.withColumn("at", F.row_number().over(in_order))
    first = F.min(F.struct("at", "range", "record")).alias("first")
    stitched = owned.groupBy("file", "owner").agg(first, _joined("at").alias("text"))
    stitched = stitched.select("file", "first.range", "first.record", "text")
    records = inner.unionByName(stitched)
    if header:
        records = records.filter("range > 0 or record > 1")
    text = F.regexp_replace("text", "\r$", "")
    return records.select(F.regexp_replace(text, f"^{BYTE_ORDER_MARK}", "").alias("record")).filter("record <> ''")


def read_multiline_csv(
    spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, str], header: bool = True
) -> DataFrame:
    """The records of ``read_records`` in the columns of ``schema``, which holds texts and numbers as written."""
    parsed = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), dict(options))
    return read_records(spark, path, header).select(parsed.alias("row")).select("row.*")
