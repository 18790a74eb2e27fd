"""Row filters over stops and production, and the options they choose from."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paragem import schemas as S
from paragem.functions.time import day_of
from paragem.sources.tables import MONTH_PARTITION, month_of, read_production, read_stops

STOP_IN_GO_COLUMNS = ["LineDesc", "StationDesc", "ElementDesc"]


def extract_failures(stops: DataFrame, since: str = S.EXTRACTED_SINCE) -> DataFrame:
    """Failures of the extracted line groups from a day on, with the stop columns only."""
    columns = [c for c in S.STOP_COLUMNS + [S.STOP_ID.name] if c in stops.columns]
    return stops.filter(
        F.col("LineGroupDesc").isin(S.EXTRACTED_LINE_GROUPS)
        & (F.col("EffectiveDay") >= F.lit(since).cast("date"))
        & (F.col("StatusDesc") == S.FAILURE_STATUS)
    ).select(*columns)


def in_date_range(df: DataFrame, column: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Both bounds included; rows without a date drop out."""
    day = day_of(F.col(column))
    return df.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def with_line_group(df: DataFrame, line_group: str) -> DataFrame:
    return df if line_group == S.ALL_LINES else df.filter(F.col("LineGroupDesc") == line_group)


def with_line(df: DataFrame, line: str) -> DataFrame:
    return df if line == S.ALL_LINES else df.filter(F.col("LineDesc") == line)


def with_shift(df: DataFrame, shift: int | str) -> DataFrame:
    return df if shift == S.ALL_ROWS else df.filter(F.col("ShiftId") == shift)


def with_day_type(df: DataFrame, column: str, calendar: DataFrame, day_type: str) -> DataFrame:
    """Keep rows whose date is a calendar day of the given type.

    The calendar side carries no broadcast hint: it is broadcast only while its
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``. Then, if ``df`` is a
    stored table with the column of its folders, only the months of the chosen days are read.
    """
    if day_type == S.ALL_ROWS:
        return df
    days = calendar.filter(F.col("Tipo") == day_type).select(F.to_date("Data").alias("_calendar_day"))
    same = day_of(F.col(column)) == F.col("_calendar_day")
    if MONTH_PARTITION in df.columns:
        days = days.withColumn("_calendar_month", month_of(F.col("_calendar_day")))
        same &= F.col(MONTH_PARTITION) == F.col("_calendar_month")
    return df.join(days, same, "left_semi")


def with_stop_type(df: DataFrame, stop_type: str) -> DataFrame:
    """Breakdowns or micro-stops; a missing duration belongs to neither."""
    if stop_type == S.STOP_TYPE_BREAKDOWN:
        return df.filter(F.col("Duration") >= S.BREAKDOWN_SECONDS)
    if stop_type == S.STOP_TYPE_MICRO:
        return df.filter(F.col("Duration") < S.BREAKDOWN_SECONDS)
    return df


def stop_in_go_rule(line_part: str, station_part: str, elements: list[str]) -> Column:
    tests = []
    if line_part:
        tests.append(F.upper("LineDesc").contains(line_part))
    if station_part:
        tests.append(F.upper("StationDesc").contains(station_part))
    if elements:
        tests.append(F.col("ElementDesc").isin(elements))
    return reduce(and_, tests)


def with_stop_in_go(df: DataFrame, mode: str = S.STOP_IN_GO_NONE) -> DataFrame:
    """Keep, drop or ignore stop-in-go rows.

    Keeping or dropping also turns missing line, station and element texts into
    empty ones, so later groupings show them as a group.
    """
    if mode == S.ALL_ROWS:
        return df
    # Missing texts match no rule, like the empty ones that replace them.
    placed = [rule for rule in S.STOP_IN_GO_RULES if rule[0] or rule[1]]
    anywhere = [e for line, station, elements in S.STOP_IN_GO_RULES if not line and not station for e in elements]
    hit = F.coalesce(reduce(or_, [stop_in_go_rule(*r) for r in [*placed, ("", "", anywhere)]]), F.lit(False))
    if mode == S.STOP_IN_GO_ONLY:
        df = df.filter(hit)
    elif mode == S.STOP_IN_GO_NONE:
        df = df.filter(~hit)
    return df.na.fill("", STOP_IN_GO_COLUMNS)


@dataclass(frozen=True)
class FilterSpec:
    """One selection, applied to stops and to production."""

    start: dt.date | str
    end: dt.date | str
    line_group: str = S.ALL_LINES
    line: str = S.ALL_LINES
    shift: int | str = S.ALL_ROWS
    day_type: str = S.ALL_ROWS
    stop_type: str = S.ALL_LINES
    stop_in_go: str = S.STOP_IN_GO_NONE

    def stops(self, stops: DataFrame, calendar: DataFrame) -> DataFrame:
        df = in_date_range(stops, "EffectiveDay", self.start, self.end)
        df = with_shift(with_line(with_line_group(df, self.line_group), self.line), self.shift)
        df = with_stop_type(with_day_type(df, "EffectiveDay", calendar, self.day_type), self.stop_type)
        return with_stop_in_go(df, self.stop_in_go)

    def _days(self) -> tuple[dt.date, dt.date]:
        return dt.date.fromisoformat(str(self.start)[:10]), dt.date.fromisoformat(str(self.end)[:10])

    def stored_stops(self, spark: SparkSession, path: str, calendar: DataFrame) -> DataFrame:
        """The selection from stored stops; folders without a chosen day are skipped."""
        return self.stops(read_stops(spark, path, *self._days(), months=True), calendar).drop(MONTH_PARTITION)

    def stored_production(self, spark: SparkSession, path: str, calendar: DataFrame) -> DataFrame:
        """The selection from stored production records, likewise."""
        records = read_production(spark, path, *self._days(), months=True)
        return self.production(records, calendar).drop(MONTH_PARTITION)

    def production(self, production: DataFrame, calendar: DataFrame) -> DataFrame:
        df = in_date_range(production, "EffectiveDate", self.start, self.end)
        df = with_shift(with_line(df, self.line), self.shift)
        return with_day_type(df, "EffectiveDate", calendar, self.day_type)

    def apply(
        self, stops: DataFrame, production: DataFrame, calendar: DataFrame
    ) -> tuple[DataFrame, DataFrame]:
        return self.stops(stops, calendar), self.production(production, calendar)


# --- Choices offered to the user ---------------------------------------------


def line_options(stops: DataFrame, production: DataFrame) -> DataFrame:
    lines = stops.select("LineDesc").distinct().union(production.select("LineDesc").distinct())
    return lines.filter(F.col("LineDesc").isNotNull()).distinct().orderBy("LineDesc")


def line_group_options(stops: DataFrame) -> DataFrame:
    return stops.select("LineGroupDesc").filter(F.col("LineGroupDesc").isNotNull()).distinct().orderBy("LineGroupDesc")


def shift_options(stops: DataFrame) -> DataFrame:
    return (
        stops.select(F.col("ShiftId").cast("int").alias("ShiftId"))
        .filter(F.col("ShiftId").isNotNull())
        .distinct()
        .orderBy("ShiftId")
    )


def date_bounds(stops: DataFrame) -> DataFrame:
    return stops.agg(
        F.to_date(F.min("EffectiveDay")).alias("min_date"), F.to_date(F.max("EffectiveDay")).alias("max_date")
    )


def distinct_components(stops: DataFrame) -> DataFrame:
    return stops.select("LineGroupDesc", "LineDesc", "StationDesc", "ElementDesc").distinct()
