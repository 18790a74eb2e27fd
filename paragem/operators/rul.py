"""Remaining-useful-life features: one row per component and observed day.

The target of a stop is the time to a later breakdown of its component, and stops
that share component and start with several breakdowns count once per breakdown.
Both follow from three reductions, each far smaller than the one before:

* *instants*: one row per component and start, combined before the shuffle;
* *component days*: windows look ahead inside one component day. What lies beyond
  the day is kept as pending sums that wait for at most two dates;
* *components*: the days of one component, bounded by the calendar, settle the
  pending sums and carry the rolling windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragem import schemas as S
from paragem.functions import time
from paragem.functions.labels import is_breakdown

TARGETS = ("after_next", "next")
FRAMES = ("rows", "days")

# Sums kept per component day: resolved ("now"), waiting for the start of the first
# later breakdown ("next") and waiting for that breakdown's own target ("after").
MEASURES = ("stops", "breakdowns", "duration")


def component_days(stops: DataFrame, target: str = "after_next") -> DataFrame:
    """Stops, breakdowns, seconds and least RUL per component and observed day.

    ``after_next``: a breakdown aims at the component's next breakdown; any other
    stop takes over the aim of the next breakdown, hence the one after it. ``next``:
    every stop aims at the next breakdown that starts later, and nothing repeats.
    Days none of whose stops has an aim are absent.
    """
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}")
    days = _days(_aims(_instants(stops), target))
    return _settle(days)


def rul_features(stops: DataFrame, target: str = "after_next", frame: str = "rows") -> DataFrame:
    """Rolling stop counts and seconds, days since the previous observed day, and RUL.

    ``rows`` rolls over the last 7, 14 and 30 observed days, ``days`` over that many
    calendar days. Rows whose RUL is not positive go after the rolling sums are taken.
    """
    if frame not in FRAMES:
        raise ValueError(f"frame must be one of {FRAMES}")
    days = component_days(stops, target)
    # Latest day first, as in ``_settle``: one sort serves both.
    latest_first = Window.partitionBy("ElementDesc").orderBy(F.desc("day_number"))
    columns = []
    for n in S.ROLLING_WINDOWS:
        bounds = (Window.currentRow, n - 1)
        rolling = latest_first.rowsBetween(*bounds) if frame == "rows" else latest_first.rangeBetween(*bounds)
        columns.append(F.sum("num_paradas").over(rolling).cast("double").alias(f"paradas_ultimos_{n}d"))
        columns.append(
            F.sum("total_duration_parada").over(rolling).cast("double").alias(f"duracao_total_ultimos_{n}d")
        )
    since_previous = F.col("day_number") - F.lead("day_number").over(latest_first)
    columns.append(F.coalesce(since_previous, F.lit(0)).cast("double").alias("tempo_desde_ultima_parada"))
    out = days.select("ElementDesc", F.col("Dia").alias("StartTime"), *columns, "RUL")
    return out.filter(F.col("RUL") > 0)


def _instants(stops: DataFrame) -> DataFrame:
    """Stops of one component and start, and the length of the last of them.

    The last is that of the highest ``StopId``, or of the remaining columns without one.
    """
    ids = S.STOP_ID.name in stops.columns
    order = F.col(S.STOP_ID.name) if ids else F.struct("LineDesc", "StationDesc", "EndTime", "AlarmDesc", "Duration")
    known = stops.filter(F.col("ElementDesc").isNotNull() & F.col("StartTime").isNotNull())
    per_instant = known.groupBy("ElementDesc", "StartTime").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_breakdown(F.col("Duration"))).alias("b"),
        F.coalesce(F.sum("Duration"), F.lit(0)).alias("seconds"),
        F.max_by("Duration", order).alias("last"),
    )
    return per_instant.select(
        "ElementDesc",
        F.to_date("StartTime").alias("Dia"),
        time.microsecond_number(F.col("StartTime")).alias("t"),
        "n",
        "b",
        "seconds",
        F.coalesce("last", F.lit(0)).alias("last_seconds"),
        is_breakdown(F.col("last")).cast("long").alias("last_breakdown"),
    )


def _aims(instants: DataFrame, target: str) -> DataFrame:
    """Split each instant's stops by where their aim lies.

    Adds ``now_*``, ``next_*`` and ``after_*`` measures, ``now_rul`` (microseconds)
    and the instant's own next breakdown inside the day, ``next_in_day``.
    """
    later = (
        Window.partitionBy("ElementDesc", "Dia").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    )
    broke = F.col("b") > 0
    df = instants.withColumn("next_in_day", F.min(F.when(broke, F.col("t"))).over(later))
    plain = {"stops": F.col("n"), "breakdowns": F.col("b"), "duration": F.col("seconds")}
    if target == "next":
        resolved = F.col("next_in_day").isNotNull()
        return df.select(
            "*",
            *_when(resolved, "now", plain),
            *_when(~resolved, "next", plain),
            *_when(F.lit(False), "after", plain),
            F.when(resolved, F.col("next_in_day") - F.col("t")).alias("now_rul"),
        )

    # Own aim of a breakdown instant: itself when it holds several breakdowns.
    several = F.col("b") > 1
    own_aim = F.when(several, F.col("t")).otherwise(F.col("next_in_day"))
    df = df.withColumn("own_aim", own_aim).withColumn(
        "taken", F.last(F.when(broke, F.struct("own_aim")), ignorenulls=True).over(later)
    )
    aim = F.when(broke, F.col("own_aim")).otherwise(F.col("taken.own_aim"))
    # Each stop repeats once per breakdown of its instant.
    times = F.greatest(F.col("b"), F.lit(1))
    repeated = {k: v * times for k, v in plain.items()}
    last = {"stops": F.lit(1), "breakdowns": F.col("last_breakdown"), "duration": F.col("last_seconds")}
    # The last repeat of the last of several breakdowns has an aim only if a later
    # breakdown exists; all other repeats of that instant aim at the instant itself.
    open_end = broke & several & F.col("next_in_day").isNull()
    without_last = {k: repeated[k] - last[k] for k in repeated}
    resolved = aim.isNotNull() & ~open_end
    waits_next = aim.isNull() & (broke | F.col("taken").isNotNull())
    waits_after = aim.isNull() & ~broke & F.col("taken").isNull()

    now = {k: F.when(open_end, without_last[k]).when(resolved, repeated[k]) for k in repeated}
    nxt = {k: F.when(open_end, last[k]).when(waits_next, repeated[k]) for k in repeated}
    return df.select(
        "*",
        *[v.alias(f"now_{k}") for k, v in now.items()],
        *[v.alias(f"next_{k}") for k, v in nxt.items()],
        *_when(waits_after, "after", repeated),
        F.when(aim.isNotNull(), aim - F.col("t")).alias("now_rul"),
    )


def _when(condition: Column, prefix: str, measures: dict[str, Column]) -> list[Column]:
    return [F.when(condition, v).alias(f"{prefix}_{k}") for k, v in measures.items()]


def _days(aims: DataFrame) -> DataFrame:
    """Sum up each component day and keep its first breakdown and that one's aim."""
    kinds = ("now", "next", "after")
    sums = [
        F.coalesce(F.sum(f"{kind}_{m}"), F.lit(0)).alias(f"{kind}_{m}") for kind in kinds for m in MEASURES
    ]
    waiting = [F.max(F.when(F.col(f"{k}_stops").isNotNull(), F.col("t"))).alias(f"{k}_t") for k in kinds[1:]]
    broke_at = F.when(F.col("b") > 0, F.col("t"))
    return aims.groupBy("ElementDesc", "Dia").agg(
        *sums,
        *waiting,
        F.min("now_rul").alias("now_rul"),
        F.min(broke_at).alias("first_t"),
        F.min_by("b", broke_at).alias("first_b"),
        F.min_by("next_in_day", broke_at).alias("first_next"),
    )


def _settle(days: DataFrame) -> DataFrame:
    """Resolve what waited for later days."""
    later = Window.partitionBy("ElementDesc").orderBy(F.desc("day_number")).rowsBetween(Window.unboundedPreceding, -1)
    df = days.withColumn("day_number", F.unix_date("Dia"))
    df = df.withColumn("next_aim", F.min("first_t").over(later))
    first_aim = F.when(F.col("first_b") > 1, F.col("first_t")).otherwise(F.coalesce("first_next", "next_aim"))
    df = df.withColumn(
        "after_aim",
        F.last(F.when(F.col("first_t").isNotNull(), F.struct(first_aim.alias("t"))), ignorenulls=True).over(later),
    ).withColumn("after_aim", F.col("after_aim.t"))

    def total(measure: str) -> Column:
        pending = [
            F.when(F.col(f"{k}_aim").isNotNull(), F.col(f"{k}_{measure}")).otherwise(0) for k in ("next", "after")
        ]
        return F.col(f"now_{measure}") + pending[0] + pending[1]

    rul = F.least("now_rul", F.col("next_aim") - F.col("next_t"), F.col("after_aim") - F.col("after_t"))
    return df.select(
        "ElementDesc",
        "Dia",
        "day_number",
        total("stops").alias("num_paradas"),
        total("breakdowns").alias("num_breakdowns"),
        total("duration").alias("total_duration_parada"),
        time.fractional_days(rul).alias("RUL"),
    ).filter(F.col("num_paradas") > 0)


def latest_per_component(features: DataFrame) -> DataFrame:
    """The most recent feature row of each component."""
    row = F.struct(*features.columns)
    return features.groupBy("ElementDesc").agg(F.max_by(row, "StartTime").alias("row")).select("row.*")


def eligible_components(features: DataFrame, filtered_stops: DataFrame) -> DataFrame:
    """Features of the components that occur in a selection of stops."""
    present = filtered_stops.select("ElementDesc").distinct()
    return features.join(present, "ElementDesc", "left_semi")
