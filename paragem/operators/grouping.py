"""De-bouncing of stops into failure groups.

Stops that agree in machine, alarm, start and end behave alike, so the windows run
over such *cells* rather than over stops: a cell that stands for very many copies
costs one row. The rules, in the order they apply:

1. a stop opens a group unless the same alarm of the same machine ended at most five
   minute boundaries before;
2. a group's number is the count of openings so far over the whole plant, stops of
   one machine at one instant sharing it. With ``numbering="alarm"`` it is instead the
   ``StopId`` that opened the group of the machine and alarm, so machines never mix;
3. a safety-gate alarm within five minutes of its machine's previous stop takes the
   number that stop had by rule 2;
4. each group is named after the alarm and element of its first stop.

Where the rules leave ties open, stops follow start, line, station, element, end,
alarm and ``StopId``, missing values first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragem import schemas as S
from paragem.functions import time
from paragem.operators.ordered import join_same, with_previous
from paragem.session import stage

MACHINE = ["LineDesc", "StationDesc", "ElementDesc"]
ALARM = [*MACHINE, "AlarmDesc"]
CELL = [*ALARM, "StartTime", "EndTime"]
INSTANT = ["StartTime", *MACHINE]

# Days and minutes of a missing start, before any real one.
NO_DAY = -(2**31)
NO_MINUTE = -(2**62)


def with_stop_ids(stops: DataFrame) -> DataFrame:
    """Stops with a ``StopId``; a missing one is the hash of the row and of its number among equal rows."""
    return told_apart(stops)[0].select(*stops.columns, *([] if _has_ids(stops) else [S.STOP_ID.name]))


def _has_ids(stops: DataFrame) -> bool:
    return S.STOP_ID.name in stops.columns


def told_apart(stops: DataFrame) -> tuple[DataFrame, str]:
    """Stops with every ``StopId`` filled, and the column that orders stops of one cell.

    That is the ``StopId`` where all are given. Stops without one come first, by all
    remaining columns; equal rows are numbered by counting them, so that very many
    of them need no window. Looks for a missing id on call.
    """
    has_ids = _has_ids(stops)
    if has_ids and stops.filter(F.col("StopId").isNull()).isEmpty():
        return stops, "StopId"
    if not has_ids:
        stops = stops.withColumn("StopId", F.lit(None).cast("long"))
    nameless = stops.filter(F.col("StopId").isNull()).groupBy(*stops.columns).agg(F.count(F.lit(1)).alias("_number"))
    nameless = nameless.withColumn("_number", F.explode(F.sequence(F.lit(1), F.col("_number"))))
    rest = F.struct(*[c for c in stops.columns if c not in (*CELL, "StopId")], "_number")
    named = stops.filter(F.col("StopId").isNotNull()).withColumn("_number", F.lit(0).cast("long"))
    numbered = named.unionByName(nameless)
    place = F.struct("StopId", F.when(F.col("StopId").isNull(), rest).alias("rest"))
    filled = F.coalesce("StopId", F.xxhash64(*[c for c in stops.columns if c != "StopId"], "_number"))
    return numbered.withColumn("_place", place).withColumn("StopId", filled).drop("_number"), "_place"


def group_stops(failures: DataFrame, numbering: str = "plant") -> DataFrame:
    """Add the eight grouping columns to extracted failures.

    A ``StopId`` names one stop: rows that repeat one, with the same times and alarm,
    are that stop again and get its values. Stops without one are all different; they
    get an id, see ``with_stop_ids``. Intermediate cell tables are written to the shared
    folder on call, see ``stage``.
    """
    if numbering not in NUMBERINGS:
        raise ValueError(f"numbering must be one of {tuple(NUMBERINGS)}")
    stops, place = told_apart(failures)
    cells = stage(mark_openings(_cells(stops, place)), "stop-openings")
    cells = stage(reassign_gate_alarms(NUMBERINGS[numbering](cells)), "stop-groups")
    return _attach(stops, name_groups(cells), place)


def _cells(stops: DataFrame, place: str = "StopId") -> DataFrame:
    first = [F.min("StopId").alias("first_id")]
    if place != "StopId":
        first = [F.min_by("StopId", place).alias("first_id"), F.min(place).alias("first_place")]
    return (
        stops.groupBy(*CELL)
        .agg(F.count(F.lit(1)).alias("copies"), *first)
        .withColumn("day", F.coalesce(time.day_number(F.col("StartTime")), F.lit(NO_DAY)))
    )


def mark_openings(cells: DataFrame) -> DataFrame:
    """Rule 1: the previous end of the same alarm and the opening flag.

    ``opens`` belongs to the cell's first stop; its copies follow a stop with the
    cell's own end, giving ``copies_open``. ``openings`` is the cell's total.
    """
    cells = with_previous(cells, ALARM, "day", ["StartTime", "EndTime"], {"EndTime": "EndTimeAnterior"})
    marked = cells.withColumn("opens", _opens("EndTimeAnterior")).withColumn("copies_open", _opens("EndTime"))
    return marked.withColumn("openings", F.col("opens") + (F.col("copies") - 1) * F.col("copies_open"))


def _opens(previous_end: str):
    late = time.minutes_crossed(F.col(previous_end), F.col("StartTime")) > S.GROUP_GAP_MINUTES
    return F.when(F.col(previous_end).isNull() | F.coalesce(late, F.lit(False)), 1).otherwise(0)


def number_groups(cells: DataFrame) -> DataFrame:
    """Rule 2: running count of openings over the plant.

    The count is built from sums per instant and machine, minute and day. A window
    sees the instants of one minute, the minutes of one day, or the days, never all
    stops; the days are the only rows that meet in one task.
    """
    minute = F.coalesce(time.minute_number(F.col("StartTime")), F.lit(NO_MINUTE)).alias("minute")
    openings = F.sum("openings").alias("openings")
    instants = cells.groupBy("day", minute, *INSTANT).agg(openings)
    minutes = cells.groupBy("day", minute).agg(openings)
    days = cells.groupBy("day").agg(openings)

    before = (Window.unboundedPreceding, -1)
    day_start = F.coalesce(F.sum("openings").over(Window.orderBy("day").rowsBetween(*before)), F.lit(0))
    minute_start = F.coalesce(
        F.sum("openings").over(Window.partitionBy("day").orderBy("minute").rowsBetween(*before)), F.lit(0)
    )
    in_minute = F.sum("openings").over(Window.partitionBy("day", "minute").orderBy(*INSTANT))

    starts = (
        minutes.select("day", "minute", minute_start.alias("minute_start"))
        .join(days.select("day", day_start.alias("day_start")), "day")
        .select("day", "minute", (F.col("minute_start") + F.col("day_start")).alias("start"))
    )
    numbers = (
        instants.select("day", "minute", *INSTANT, in_minute.alias("in_minute"))
        .join(starts, ["day", "minute"])
        .select(*INSTANT, (F.col("start") + F.col("in_minute")).alias("IDGrupoNumerico"))
    )
    return join_same(cells, numbers, INSTANT).select(*[F.col(f"l.{c}") for c in cells.columns], "r.IDGrupoNumerico")


def number_groups_by_alarm(cells: DataFrame) -> DataFrame:
    """Rule 2 per machine and alarm: the id of the latest opening stop.

    Openings are looked up inside a day; what a day inherits is looked up over the
    days of the alarm.
    """
    opening = F.when(F.col("opens") == 1, F.col("first_id"))
    in_day = (
        Window.partitionBy("_hash", "day", *ALARM)
        .orderBy("StartTime", "EndTime")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier_days = Window.partitionBy(*ALARM).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opened_at = F.when(F.col("opens") == 1, F.struct("StartTime", "EndTime"))
    days = cells.groupBy(*ALARM, "day").agg(F.max_by("first_id", opened_at).alias("opened"))
    inherited = days.select(*ALARM, "day", F.last("opened", ignorenulls=True).over(earlier_days).alias("inherited"))
    found = (
        cells.withColumn("_hash", F.xxhash64(*ALARM))
        .withColumn("opened", F.last(opening, ignorenulls=True).over(in_day))
        .drop("_hash")
    )
    number = F.coalesce("l.opened", "r.inherited").alias("IDGrupoNumerico")
    return join_same(found, inherited, [*ALARM, "day"]).select(*[F.col(f"l.{c}") for c in cells.columns], number)


NUMBERINGS = {"plant": number_groups, "alarm": number_groups_by_alarm}


def reassign_gate_alarms(cells: DataFrame) -> DataFrame:
    """Rule 3: previous number and end of the machine, and the cell's final number.

    Copies of a cell follow a stop of the cell itself, so only the first stop can
    move to another group.
    """
    cells = with_previous(
        cells,
        MACHINE,
        "day",
        ["StartTime", "EndTime", "AlarmDesc"],
        {"IDGrupoNumerico": "Prev_ID", "EndTime": "Prev_EndTime"},
    )
    near = time.minutes_crossed(F.col("Prev_EndTime"), F.col("StartTime")) <= S.GROUP_GAP_MINUTES
    return cells.withColumn(
        "IDGrupoFinal",
        F.when((F.col("AlarmDesc") == S.GATE_ALARM) & near, F.col("Prev_ID")).otherwise(F.col("IDGrupoNumerico")),
    )


def name_groups(cells: DataFrame) -> DataFrame:
    """Rule 4: alarm and element of each group's first stop.

    Where a cell's first stop moved and its copies did not, the cell is split into a
    row for the first stop (``part`` = first) and one for the copies.
    """
    splits = (F.col("IDGrupoFinal") != F.col("IDGrupoNumerico")) & (F.col("copies") > 1)
    copies = cells.filter(splits).withColumn("IDGrupoFinal", F.col("IDGrupoNumerico"))
    parts = cells.withColumn("part", F.when(splits, "first").otherwise("all")).unionByName(
        copies.withColumn("part", F.lit("copies"))
    )
    name = F.struct(F.col("AlarmDesc").alias("PrimeiroAlarmDesc"), F.col("ElementDesc").alias("PrimeiroElementDesc"))
    first = F.min_by(name, F.struct(*INSTANT, "EndTime", "AlarmDesc"))
    names = parts.groupBy("IDGrupoFinal").agg(first.alias("name"))
    return parts.join(names.select("IDGrupoFinal", "name.*"), "IDGrupoFinal")


def _attach(stops: DataFrame, cells: DataFrame, place: str) -> DataFrame:
    """Give every stop the values of its cell.

    Stops shuffle once; a cell with very many copies is a skewed join partition,
    which adaptive execution splits on the stop side.
    """
    is_first = F.col(f"l.{place}").eqNullSafe(F.col("r.first_id" if place == "StopId" else "r.first_place"))
    part = F.col("r.part")
    belongs = (part == "all") | ((part == "first") & is_first) | ((part == "copies") & ~is_first)

    def of_first(value: str, of_copies: str):
        return F.when(is_first, F.col(f"r.{value}")).otherwise(F.col(f"r.{of_copies}"))

    return join_same(stops, cells, CELL, belongs).select(
        *[F.col(f"l.{c}") for c in stops.columns if c != "_place"],
        of_first("EndTimeAnterior", "EndTime").alias("EndTimeAnterior"),
        of_first("opens", "copies_open").alias("IniciouNovoGrupo"),
        "r.IDGrupoNumerico",
        of_first("Prev_ID", "IDGrupoNumerico").alias("Prev_ID"),
        of_first("Prev_EndTime", "EndTime").alias("Prev_EndTime"),
        "r.IDGrupoFinal",
        "r.PrimeiroAlarmDesc",
        "r.PrimeiroElementDesc",
    )
