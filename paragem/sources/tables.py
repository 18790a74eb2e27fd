"""Readers and writers of the plant tables.

Schemas of text files are given, never inferred; blanks are read as nulls. A quote
inside a text is doubled, in all files read and written here.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragem import schemas as S
from paragem.sources.files import Files
from paragem.sources.multiline import BYTE_ORDER_MARK, read_multiline_csv

TIMESTAMPS = ["StartTime", "EndTime"]
MONTH_PARTITION = "EffectiveMonth"


def _texts(schema: T.StructType, columns: list[str]) -> T.StructType:
    """The schema with some columns read as text, to be converted afterwards."""
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in columns else f for f in schema])


# --- Stops --------------------------------------------------------------------


QUOTES = {"quote": '"', "escape": '"'}


def _number(text: Column, decimal: str = ".") -> Column:
    """A number written as text; blanks are null, anything else that is no number raises."""
    plain = F.replace(text, F.lit(decimal), F.lit(".")) if decimal != "." else text
    value = plain.try_cast("double")
    bad = text.isNotNull() & (F.trim(text) != "") & value.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(value)


def read_stops_csv(
    spark: SparkSession, path: str, schema: T.StructType = S.STOPS, multi_line: bool = False
) -> DataFrame:
    """Stops from CSV; pass a schema with more columns to keep those too.

    ``multi_line`` is for texts that hold line breaks; such a file is read in ranges all the same.
    """
    dates = [*TIMESTAMPS, "EffectiveDay"]
    # Shift and duration may carry a decimal point when blanks occur among them.
    numbers = ["Duration", "ShiftId"]
    texts = _texts(schema, dates + numbers)
    if multi_line:
        df = read_multiline_csv(spark, path, texts, QUOTES)
    else:
        df = spark.read.schema(texts).options(**QUOTES).csv(path, header=True)
    casts = {c: F.col(c).cast("timestamp_ntz") for c in TIMESTAMPS}
    casts["EffectiveDay"] = F.to_date(F.col("EffectiveDay").cast("timestamp_ntz"))
    casts |= {c: _number(F.col(c)).cast(schema[c].dataType) for c in numbers}
    return df.withColumns(casts)


# Plain CSV output would cut timestamps off at the millisecond.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_stops_csv(stops: DataFrame, path: str, mode: str = "error") -> None:
    stops.write.mode(mode).options(timestampNTZFormat=CSV_TIMESTAMP, **QUOTES).csv(path, header=True)


SCHEMA_FOLDER = "_schema"


def write_stops(stops: DataFrame, path: str, mode: str = "error") -> None:
    """Store stops as Parquet, one folder per month of the effective day."""
    _write_by_month(stops, "EffectiveDay", path, mode)


def write_production(production: DataFrame, path: str, mode: str = "error") -> None:
    """Store production records as Parquet, one folder per month of their date."""
    _write_by_month(production, "EffectiveDate", path, mode)


def month_of(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def _write_by_month(rows: DataFrame, day: str, path: str, mode: str) -> None:
    """The rebalance hint gathers each month into few files; adaptive execution splits a
    month that is too large for one task. The schema is stored last, in a folder that
    readers of the table pass over: it makes an empty table readable and marks the table as whole.
    """
    by_month = rows.withColumn(MONTH_PARTITION, month_of(F.col(day))).hint("rebalance", F.col(MONTH_PARTITION))
    by_month.write.mode(mode).partitionBy(MONTH_PARTITION).parquet(path)
    schema = rows.sparkSession.createDataFrame([(by_month.schema.json(),)], "value string")
    schema.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{SCHEMA_FOLDER}")


def _stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of a table that ``write_stops`` finished; None of any other."""
    try:
        row = spark.read.text(f"{path.rstrip('/')}/{SCHEMA_FOLDER}").head()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return T.StructType.fromJson(json.loads(row[0])) if row else None


def read_stops(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, months: bool = False
) -> DataFrame:
    """Stored stops, optionally of a date range; folders of other months are skipped.

    ``months`` keeps the column of the folders, through which a join on days can skip more.
    """
    return _read_by_month(spark, path, F.col("EffectiveDay"), start, end, months)


def read_production(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None, months: bool = False
) -> DataFrame:
    """Stored production records, as ``read_stops``."""
    return _read_by_month(spark, path, F.to_date("EffectiveDate"), start, end, months)


def _read_by_month(
    spark: SparkSession, path: str, day: Column, start: dt.date | None, end: dt.date | None, months: bool
) -> DataFrame:
    schema = _stored_schema(spark, path)
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    month = F.col(MONTH_PARTITION)
    if start is not None:
        df = df.filter((month >= start.year * 100 + start.month) & (day >= F.lit(start)))
    if end is not None:
        df = df.filter((month <= end.year * 100 + end.month) & (day <= F.lit(end)))
    return df if months else df.drop(MONTH_PARTITION)


def jdbc_stops_options(
    options: Mapping[str, str], table: str, first_day: str, last_day: str, partitions: int
) -> dict[str, str]:
    """Options of a JDBC read cut into ``partitions`` day ranges; connection options are the caller's and go before."""
    return {
        # Times of the plant have no zone.
        "preferTimestampNTZ": "true",
        "fetchsize": "10000",
        **options,
        "dbtable": table,
        "partitionColumn": "EffectiveDay",
        "lowerBound": first_day,
        "upperBound": last_day,
        "numPartitions": str(partitions),
    }


def as_stops(df: DataFrame) -> DataFrame:
    """The stop columns of ``df`` in the types of the stops table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.STOPS.fields])


def read_stops_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Stop columns of a database table; filters put on the result run in the database."""
    return as_stops(spark.read.format("jdbc").options(**options).load())


# --- Production and calendar --------------------------------------------------


def read_production_csv(
    spark: SparkSession, path: str, date_format: str | None = None, decimal: str = "."
) -> DataFrame:
    """Production records, semicolon-separated; unreadable dates become null, unreadable numbers raise.

    Dates are ISO texts unless a ``date_format`` such as ``dd/MM/yyyy`` is given.
    """
    numbers = ["ShiftId", "EffectiveProd", "TargProd"]
    reader = spark.read.schema(_texts(S.PRODUCTION, ["EffectiveDate", *numbers])).options(**QUOTES)
    date = F.col("EffectiveDate")
    read = F.try_to_timestamp(date, F.lit(date_format)).cast("timestamp_ntz") if date_format else None
    casts = {c: _number(F.col(c), decimal).cast(S.PRODUCTION[c].dataType) for c in numbers}
    casts["EffectiveDate"] = date.try_cast("timestamp_ntz") if read is None else read
    return reader.csv(path, header=True, sep=";").withColumns(casts)


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(_texts(S.CALENDAR, ["Data"])).csv(path, header=True)
    return df.withColumn("Data", F.to_date("Data"))


def write_calendar_csv(calendar: DataFrame, path: str, mode: str = "error") -> None:
    calendar.select("Data", "Tipo").write.mode(mode).csv(path, header=True)


#: A pair in braces, spaced in any way.
DATE_AND_TYPE = r'\{\s*"(\d+-\d+-\d+)"\s*,\s*"([^"]*)"\s*\}'


def calendar_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """``{ "date", "type" }`` pairs of text lines, in any number per line."""
    pairs = lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(DATE_AND_TYPE), F.lit(0))).alias("pair"))
    return pairs.select(
        F.to_date(F.regexp_extract("pair", DATE_AND_TYPE, 1)).alias("Data"),
        F.regexp_extract("pair", DATE_AND_TYPE, 2).alias("Tipo"),
    )


def require_rows(df: DataFrame, message: str = "no data in the expected format") -> DataFrame:
    """``df`` itself, or an error if it has no row; looks for one row on call."""
    if df.isEmpty():
        raise ValueError(message)
    return df


# --- Feature table and exports ------------------------------------------------


def write_features(features: DataFrame, path: str, mode: str = "error", format: str = "parquet") -> None:
    writer = features.write.mode(mode).options(**QUOTES)
    writer.csv(path, header=True) if format == "csv" else writer.format(format).save(path)


def read_features(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(S.RUL_FEATURES).options(**QUOTES)
    return reader.csv(path, header=True) if format == "csv" else reader.format(format).load(path)


def export_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Semicolon-separated UTF-8 files, each opening with a byte-order mark."""
    first = df.columns[0]
    marked = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    marked.write.mode(mode).options(timestampNTZFormat=CSV_TIMESTAMP, **QUOTES).csv(
        path, header=True, sep=";", encoding="UTF-8"
    )


def _csv_field(column: Column, separator: str, only: bool = False) -> Column:
    """A value as written by a plain writer: quoted if it holds a separator, quote or line break; blank for a null.

    In a table of one column a blank is written as two quotes, since an empty line is no row.
    """
    text = F.coalesce(column, F.lit(""))
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    needed = text.rlike(f'[{separator}"\r\n]')
    return F.when(needed | (text == "") if only else needed, doubled).otherwise(text)


def csv_lines(df: DataFrame, separator: str = ";") -> DataFrame:
    """(value): the rows of ``df`` as separated lines, in their order."""
    only = len(df.columns) == 1
    stamp = {"timestamp_ntz", "timestamp"}
    texts = [
        F.date_format(F.col(f"`{c}`"), CSV_TIMESTAMP) if kind in stamp else F.col(f"`{c}`").cast("string")
        for c, kind in df.dtypes
    ]
    return df.select(F.concat_ws(separator, *[_csv_field(t, separator, only) for t in texts]).alias("value"))


def export_csv_file(df: DataFrame, path: str, separator: str = ";") -> None:
    """One separated UTF-8 file at ``path`` under one byte-order mark and one header.

    Tasks write the lines of their rows; the parts are joined in the order of the rows. The
    file appears once it is whole. An existing file is refused.
    """
    spark = df.sparkSession
    target = Files(spark, path)
    if target.exists(path):
        raise FileExistsError(path)
    parent, name = path.rsplit("/", 1)
    folder = f"{parent}/.{name}.lines"
    csv_lines(df, separator).write.mode("overwrite").text(folder)
    names = [spark.range(1).select(_csv_field(F.lit(c), separator)).head()[0] for c in df.columns]
    parts = [e.path for e in target.entries(folder) if e.name.startswith("part-")]
    target.join(path, (BYTE_ORDER_MARK + separator.join(names) + "\n").encode(), parts)
    target.delete(folder)
