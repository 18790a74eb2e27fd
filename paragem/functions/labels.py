"""Labels, flags and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paragem import schemas as S


def lookup(key: Column, table: dict[int, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def month_label(month: Column) -> Column:
    return lookup(month, S.MONTH_LABELS)


def shift_label(shift: Column) -> Column:
    return lookup(shift, S.SHIFT_LABELS, S.ALL_ROWS)


def week_label(week: Column) -> Column:
    return F.concat(F.lit("WK-"), week.cast("string"))


def short_text(text: Column) -> Column:
    """First 50 characters, always followed by an ellipsis."""
    return F.concat(F.substring(text, 1, 50), F.lit("..."))


def is_breakdown(duration: Column) -> Column:
    """True from 600 seconds on; a missing duration is no breakdown."""
    return F.coalesce(duration >= S.BREAKDOWN_SECONDS, F.lit(False))


def is_failure(status: Column) -> Column:
    return F.coalesce(status == S.FAILURE_STATUS, F.lit(False))


def shift_minutes(day: Column, shift: Column) -> Column:
    """Planned minutes of a day-shift; Sundays are short whatever the shift."""
    minutes = F.when(F.weekday(day) == 6, S.SUNDAY_MINUTES)
    for shift_id, value in S.SHIFT_MINUTES.items():
        minutes = minutes.when(shift == shift_id, value)
    return minutes.otherwise(0)


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def percent_text(fraction: Column) -> Column:
    return F.format_string("%.2f%%", fraction.cast("double") * 100)


def thousands(value: Column) -> Column:
    """Fraction cut off, thousands separated by commas."""
    return F.format_number(value.cast("long"), 0)


def day_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")
