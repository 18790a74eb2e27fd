"""Time arithmetic on zone-less timestamps.

Everything is built from date, hour, minute and second parts, so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def minute_number(ts: Column) -> Column:
    """Minutes since 1970-01-01, seconds dropped."""
    return day_number(ts).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def microsecond_number(ts: Column) -> Column:
    """Microseconds since 1970-01-01."""
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return minute_number(ts) * 60_000_000 + micros


def minutes_crossed(start: Column, end: Column) -> Column:
    """Minute boundaries between two instants: 10:00:59 to 10:01:00 counts as 1."""
    return minute_number(end) - minute_number(start)


def fractional_days(micros: Column) -> Column:
    """Microseconds to days, through seconds."""
    return micros / F.lit(1e6) / F.lit(86400.0)


def add_whole_days(day: Column, days: Column) -> Column:
    """Date plus a day count whose fraction is cut off (3.9 adds 3)."""
    return F.date_add(day, days.cast("int"))


def days_until(day: Column, as_of: Column) -> Column:
    return F.datediff(day, as_of)
