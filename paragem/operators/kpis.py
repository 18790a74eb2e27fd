"""Reliability (MTBF, MTTR, failure counts) and production-efficiency (OPE) indicators.

A key is a column name or an aliased column. Rows without a key value drop out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragem import schemas as S
from paragem.functions import labels
from paragem.functions.time import day_of

Key = str | Column


def day_key(column: str = "EffectiveDay") -> Column:
    return day_of(F.col(column)).alias("Dia")


def month_key(column: str = "EffectiveDay") -> Column:
    """Month number; the same month of different years is one key."""
    return F.month(column).alias("MesNum")


def week_key(column: str = "EffectiveDay") -> Column:
    """ISO week number, whatever the year."""
    return F.weekofyear(column).alias("SemanaNum")


def _keyed(df: DataFrame, keys: tuple[Key, ...], columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with a value for every key, the keys as ``_key0`` ..., and the keys' own names."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = df.select(*named).columns if named else []
    inner = [f"_key{i}" for i in range(len(named))]
    present = [c for c in columns if c in df.columns]
    out = df.select(*[k.alias(i) for k, i in zip(named, inner)], *present)
    if inner:
        out = out.filter(reduce(and_, [F.col(i).isNotNull() for i in inner]))
    return out, names


def condense_stops(stops: DataFrame) -> DataFrame:
    """Sums per line, component, first alarm and day-shift.

    Every indicator below accepts this table in place of the stops. Its size follows
    the plant and the calendar, not the number of stops, so one pass over the stops
    serves a whole page of indicators.
    """
    dims = [c for c in ("LineDesc", "ElementDesc", "PrimeiroAlarmDesc") if c in stops.columns]
    sums = [_stop_sums(stops)[name].alias(name) for name in STOP_SUMS]
    return stops.groupBy(*dims, "EffectiveDay", "ShiftId").agg(*sums)


def condense_production(production: DataFrame) -> DataFrame:
    """Sums and counts per line and day, accepted in place of the production records."""
    sums = [_production_sums(production)[name].alias(name) for name in PRODUCTION_SUMS]
    return production.groupBy("LineDesc", "EffectiveDate").agg(*sums)


STOP_SUMS = ["main_line_failures", "failures", "seconds", "stops"]
PRODUCTION_SUMS = ["produced", "produced_records", "target", "target_records"]


def _stop_sums(df: DataFrame) -> dict[str, Column]:
    if "main_line_failures" in df.columns:
        return {name: F.sum(name) for name in STOP_SUMS}
    failure = labels.is_failure(F.col("StatusDesc"))
    on_main_line = F.coalesce(F.col("LineGroupDesc") == S.MAIN_LINE, F.lit(False))
    return {
        "main_line_failures": F.count_if(failure & on_main_line),
        "failures": F.count_if(failure),
        "seconds": F.sum(F.when(failure, F.col("Duration"))),
        "stops": F.count(F.lit(1)),
    }


def _production_sums(df: DataFrame) -> dict[str, Column]:
    if "produced_records" in df.columns:
        return {name: F.sum(name) for name in PRODUCTION_SUMS}
    return {
        "produced": F.sum("EffectiveProd"),
        "produced_records": F.count("EffectiveProd"),
        "target": F.sum("TargProd"),
        "target_records": F.count("TargProd"),
    }


STOP_INPUTS = ["StatusDesc", "LineGroupDesc", "Duration", "EffectiveDay", "ShiftId", *STOP_SUMS]
PRODUCTION_INPUTS = ["EffectiveProd", "TargProd", *PRODUCTION_SUMS]


def reliability_kpis(stops: DataFrame, *keys: Key) -> DataFrame:
    """MTBF and MTTR in minutes per key; with no key, one row, zeros over no stops.

    Failures are those of the main line, downtime is that of every line group, and
    uptime adds the minutes of each day-shift seen in the group once. Stops are first
    reduced to day-shifts, so the shuffles carry one row per key and day-shift.
    """
    df, names = _keyed(stops, keys, STOP_INPUTS)
    inner = [f"_key{i}" for i in range(len(names))]
    sums = _stop_sums(df)
    day_shifts = df.groupBy(*inner, "EffectiveDay", "ShiftId").agg(
        sums["main_line_failures"].alias("failures"), sums["seconds"].alias("seconds")
    )
    totals = day_shifts.groupBy(*inner).agg(
        F.coalesce(F.sum("failures"), F.lit(0)).alias("num_falhas"),
        (F.coalesce(F.sum("seconds"), F.lit(0)) / 60).alias("downtime"),
        F.coalesce(F.sum(labels.shift_minutes(F.col("EffectiveDay"), F.col("ShiftId"))), F.lit(0))
        .cast("double")
        .alias("uptime"),
    )
    failed = F.col("num_falhas") > 0
    return totals.select(
        *[F.col(i).alias(n) for i, n in zip(inner, names)],
        F.when(failed, F.col("downtime") / F.col("num_falhas")).otherwise(0.0).alias("mttr_minutos"),
        F.when(failed, F.col("uptime") / F.col("num_falhas")).otherwise(F.col("uptime")).alias("mtbf_minutos"),
        "num_falhas",
    )


def ope_kpis(production: DataFrame, *keys: Key) -> DataFrame:
    """OPE percentage and piece totals per key; zeros where there is no target or no row."""
    df, names = _keyed(production, keys, PRODUCTION_INPUTS)
    inner = [f"_key{i}" for i in range(len(names))]
    sums = _production_sums(df)
    totals = df.groupBy(*inner).agg(
        F.coalesce(sums["produced"], F.lit(0)).alias("produced"), F.coalesce(sums["target"], F.lit(0)).alias("target")
    )
    return totals.select(
        *[F.col(i).alias(n) for i, n in zip(inner, names)],
        F.when(F.col("target") > 0, F.col("produced") / F.col("target") * 100).otherwise(0.0).alias("ope"),
        F.col("produced").alias("pecas_boas"),
        F.lit(0).alias("pecas_ruins"),
        F.col("produced").alias("total_produzido"),
    )


def production_means(production: DataFrame, *keys: Key) -> DataFrame:
    """Mean production and mean loss (target minus production), blanks skipped separately."""
    df, names = _keyed(production, keys, PRODUCTION_INPUTS)
    inner = [f"_key{i}" for i in range(len(names))]
    sums = _production_sums(df)
    produced, target = (F.try_divide(sums[c], sums[f"{c}_records"]) for c in ("produced", "target"))
    means = df.groupBy(*inner).agg((target - produced).alias("perda_media"), produced.alias("producao_media"))
    return means.select(*[F.col(i).alias(n) for i, n in zip(inner, names)], "perda_media", "producao_media")


def failures_total(stops: DataFrame) -> DataFrame:
    """Failures of any line group."""
    return stops.agg(F.coalesce(_stop_sums(stops)["failures"], F.lit(0)).alias("total_falhas"))


def failures_by_day(stops: DataFrame) -> DataFrame:
    """Failures per day, days without any left out."""
    df, _ = _keyed(stops, (day_key(),), STOP_INPUTS)
    days = df.groupBy(F.col("_key0").alias("Dia")).agg(_stop_sums(df)["failures"].alias("falhas"))
    return days.filter(F.col("falhas") > 0)


# --- Series, rankings and labelled views --------------------------------------


def last_days(daily: DataFrame, days: int = 30, column: str = "Dia") -> DataFrame:
    """The latest observed days in date order; gaps are not filled."""
    return daily.orderBy(F.desc(column)).limit(days).orderBy(column)


def by_month(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("Mes", labels.month_label(F.col("MesNum"))).orderBy("MesNum")


def by_week(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("SemanaLabel", labels.week_label(F.col("SemanaNum"))).orderBy("SemanaNum")


def lines_by(stops: DataFrame, metric: str, title: str) -> DataFrame:
    """Lines from the highest metric down."""
    out = reliability_kpis(stops, "LineDesc").select(F.col("LineDesc").alias("Linha"), F.col(metric).alias(title))
    return out.orderBy(F.desc(title), "Linha")


def components_by(stops: DataFrame, metric: str, title: str, ascending: bool) -> DataFrame:
    out = reliability_kpis(stops, "ElementDesc").select(
        F.col("ElementDesc").alias("COMPONENTE"), F.col(metric).alias(title)
    )
    return out.orderBy(F.asc(title) if ascending else F.desc(title), "COMPONENTE")


def top_alarms_by_count(grouped: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent first alarms, ties in alphabetical order."""
    alarms = grouped.filter(F.col("PrimeiroAlarmDesc").isNotNull())
    counted = alarms.groupBy(F.col("PrimeiroAlarmDesc").alias("Descrição da Falha")).agg(
        _stop_sums(grouped)["stops"].alias("Número de Falhas")
    )
    top = counted.orderBy(F.desc("Número de Falhas"), "Descrição da Falha").limit(n)
    return top.withColumn("Descrição Curta", labels.short_text(F.col("Descrição da Falha")))


def top_alarms_by_mttr(grouped: DataFrame, n: int = 3) -> DataFrame:
    kpis = reliability_kpis(grouped, "PrimeiroAlarmDesc").select(
        F.col("PrimeiroAlarmDesc").alias("Descrição da Falha"),
        F.col("mttr_minutos").alias("MTTR Médio (minutos)"),
    )
    return kpis.orderBy(F.desc("MTTR Médio (minutos)"), "Descrição da Falha").limit(n)


def best_and_worst_line(production: DataFrame) -> DataFrame:
    """The lines of highest and lowest OPE, the first name on ties."""
    lines = ope_kpis(production, "LineDesc").select("LineDesc", "ope")
    best = lines.orderBy(F.desc("ope"), "LineDesc").limit(1).withColumn("Destaque", F.lit("MELHOR LINHA"))
    worst = lines.orderBy("ope", "LineDesc").limit(1).withColumn("Destaque", F.lit("PIOR LINHA"))
    return best.unionByName(worst)
