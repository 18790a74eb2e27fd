"""Every operator as a named query over the generic Parquet tables.

``QUERIES`` maps a name to a function of (session, table folder) and the SQL that
must give the same rows, or None where SQL cannot express the result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from contextlib import suppress
from functools import reduce
from operator import and_

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragem import schemas as S
from paragem.functions import labels
from paragem.models import attribution, remaining_life, risk
from paragem.models.store import load_model, save_model
from paragem.operators import filters, grouping, kpis, metrics, rul, sampling
from paragem.plans import cards
from paragem.plans import oracle as O
from paragem.plans.dashboard import Dashboard
from paragem.session import new_shared_path, stage
from paragem.sources import cache, plant, tables
from paragem.sources.files import Files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

SINCE = "2024-01-01"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return register


def add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = (fn, sql)


def over_stops(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(plant.stops(spark, sf))


def over_production(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(plant.production(spark, sf))


def grouped_stops(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.group_stops(filters.extract_failures(plant.stops(spark, sf), SINCE))


def once(prepare: Callable) -> Callable:
    """Run ``prepare`` once per application and table folder; a new application starts anew."""
    done: dict[tuple[str, str], object] = {}

    def prepared(spark: SparkSession, sf: str):
        key = spark.sparkContext.applicationId, sf
        for other in [k for k in done if k[0] != key[0]]:
            del done[other]
        if key not in done:
            done[key] = prepare(spark, sf)
        return done[key]

    return prepared


@once
def _stored_groups_path(spark: SparkSession, sf: str) -> str:
    path = new_shared_path(spark, "grouped-stops")
    tables.write_stops(grouped_stops(spark, sf), path)
    return path


def stored_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped stops, stored on first use of a session and table folder."""
    return tables.read_stops(spark, _stored_groups_path(spark, sf))


# --- Reliability ---------------------------------------------------------------

WEEK_LABEL = "'WK-' || CAST(SemanaNum AS VARCHAR)"
LAST_30 = " QUALIFY row_number() OVER (ORDER BY Dia DESC) <= 30"

add(
    "kpi_global",
    over_stops(kpis.reliability_kpis),
    O.with_tables(O.STOPS, body=O.kpis(None, None) + " SELECT * FROM kpi"),
)
add(
    "kpi_by_line",
    over_stops(lambda df: kpis.reliability_kpis(df, "LineDesc")),
    O.with_tables(O.STOPS, body=O.kpis("LineDesc", "LineDesc") + " SELECT * FROM kpi"),
)
add(
    "kpi_by_component",
    over_stops(lambda df: kpis.reliability_kpis(df, "ElementDesc")),
    O.with_tables(O.STOPS, body=O.kpis("ElementDesc", "ElementDesc") + " SELECT * FROM kpi"),
)
add(
    "kpi_by_month",
    over_stops(lambda df: kpis.by_month(kpis.reliability_kpis(df, kpis.month_key()))),
    O.with_tables(
        O.STOPS, body=O.kpis("month(EffectiveDay)", "MesNum") + f" SELECT *, {O.MONTH_LABEL} AS Mes FROM kpi"
    ),
)
add(
    "kpi_by_week",
    over_stops(lambda df: kpis.by_week(kpis.reliability_kpis(df, kpis.week_key()))),
    O.with_tables(
        O.STOPS, body=O.kpis("week(EffectiveDay)", "SemanaNum") + f" SELECT *, {WEEK_LABEL} AS SemanaLabel FROM kpi"
    ),
)
add(
    "kpi_by_day_last30",
    over_stops(lambda df: kpis.last_days(kpis.reliability_kpis(df, kpis.day_key()))),
    O.with_tables(O.STOPS, body=O.kpis("EffectiveDay", "Dia") + " SELECT * FROM kpi" + LAST_30),
)
add(
    "kpi_by_first_alarm",
    lambda spark, sf: kpis.reliability_kpis(stored_groups(spark, sf), "PrimeiroAlarmDesc"),
    O.with_tables(
        O.STOPS, O.GROUPED, body=O.kpis("PrimeiroAlarmDesc", "PrimeiroAlarmDesc", "grouped") + " SELECT * FROM kpi"
    ),
)
for metric, title in (("mtbf_minutos", "MTBF (minutos)"), ("mttr_minutos", "MTTR (minutos)")):
    add(
        f"lines_by_{metric[:4]}",
        over_stops(lambda df, m=metric, t=title: kpis.lines_by(df, m, t)),
        O.with_tables(
            O.STOPS, body=O.kpis("LineDesc", "LineDesc") + f' SELECT LineDesc AS Linha, {metric} AS "{title}" FROM kpi'
        ),
    )
for metric, title, ascending in (("mtbf_minutos", "MTBF", True), ("mttr_minutos", "MTTR", False)):
    add(
        f"components_by_{metric[:4]}",
        over_stops(lambda df, m=metric, t=title, a=ascending: kpis.components_by(df, m, t, a)),
        O.with_tables(
            O.STOPS,
            body=O.kpis("ElementDesc", "ElementDesc") + f" SELECT ElementDesc AS COMPONENTE, {metric} AS {title} FROM kpi",
        ),
    )
add(
    "failures_total",
    over_stops(kpis.failures_total),
    O.with_tables(
        O.STOPS, body=" SELECT count(*) FILTER (WHERE StatusDesc = 'Falha/Parada') AS total_falhas FROM stops"
    ),
)
add(
    "failures_by_day_last30",
    over_stops(lambda df: kpis.last_days(kpis.failures_by_day(df))),
    O.with_tables(
        O.STOPS,
        body=" SELECT * FROM (SELECT EffectiveDay AS Dia, count(*) AS falhas FROM stops"
        " WHERE StatusDesc = 'Falha/Parada' GROUP BY EffectiveDay)" + LAST_30,
    ),
)
add(
    "top3_alarms_by_count",
    lambda spark, sf: kpis.top_alarms_by_count(stored_groups(spark, sf)),
    O.with_tables(
        O.STOPS,
        O.GROUPED,
        body=""" SELECT PrimeiroAlarmDesc AS "Descrição da Falha", count(*) AS "Número de Falhas",
          substr(PrimeiroAlarmDesc, 1, 50) || '...' AS "Descrição Curta"
        FROM grouped WHERE PrimeiroAlarmDesc IS NOT NULL GROUP BY PrimeiroAlarmDesc
        ORDER BY count(*) DESC, PrimeiroAlarmDesc LIMIT 3""",
    ),
)
add(
    "top3_alarms_by_mttr",
    lambda spark, sf: kpis.top_alarms_by_mttr(stored_groups(spark, sf)),
    O.with_tables(
        O.STOPS,
        O.GROUPED,
        body=O.kpis("PrimeiroAlarmDesc", "alarm", "grouped")
        + ' SELECT alarm AS "Descrição da Falha", mttr_minutos AS "MTTR Médio (minutos)" FROM kpi'
        " ORDER BY mttr_minutos DESC, alarm LIMIT 3",
    ),
)


@query(
    "reliability_cards",
    O.with_tables(
        O.STOPS,
        body=O.kpis("LineDesc", "LineDesc")
        + """ SELECT LineDesc, printf('%.2f', mtbf_minutos) AS mtbf, printf('%.2f', mttr_minutos) AS mttr,
          CAST(num_falhas AS VARCHAR) AS falhas FROM kpi""",
    ),
)
def reliability_cards(spark: SparkSession, sf: str) -> DataFrame:
    by_line = kpis.reliability_kpis(plant.stops(spark, sf), "LineDesc")
    return by_line.select(
        "LineDesc",
        labels.two_decimals(F.col("mtbf_minutos")).alias("mtbf"),
        labels.two_decimals(F.col("mttr_minutos")).alias("mttr"),
        F.col("num_falhas").cast("string").alias("falhas"),
    )


add(
    "reliability_cards_global",
    over_stops(cards.reliability_cards),
    O.with_tables(
        O.STOPS,
        body=O.kpis(None, None)
        + """ SELECT printf('%.2f', mtbf_minutos) AS mtbf, printf('%.2f', mttr_minutos) AS mttr, CAST((SELECT count(*)
          FROM stops WHERE StatusDesc = 'Falha/Parada') AS VARCHAR) AS total_falhas FROM kpi""",
    ),
)

# --- Production ----------------------------------------------------------------

add(
    "ope_cards",
    over_production(cards.ope_cards),
    O.with_tables(
        O.PRODUCTION,
        body=O.ope("LineDesc", "LineDesc")
        + """, best AS (SELECT * FROM ope_kpi ORDER BY ope DESC, LineDesc LIMIT 1),
        worst AS (SELECT * FROM ope_kpi ORDER BY ope, LineDesc LIMIT 1),
        whole AS (SELECT CAST(sum(EffectiveProd) AS DOUBLE) / CAST(sum(TargProd) AS DOUBLE) * 100 AS ope,
          avg(TargProd) - avg(EffectiveProd) AS perda, avg(EffectiveProd) AS media FROM production)
        SELECT format('{:,}', CAST(trunc(perda) AS BIGINT)) AS perda_media, printf('%.2f', media) AS producao_media,
          printf('%.2f%%', whole.ope) AS ope, 'MELHOR LINHA: ' || best.LineDesc AS melhor_linha,
          printf('%.2f%%', best.ope) AS melhor_ope, 'PIOR LINHA: ' || worst.LineDesc AS pior_linha,
          printf('%.2f%%', worst.ope) AS pior_ope FROM whole, best, worst""",
    ),
)

add(
    "ope_global",
    over_production(kpis.ope_kpis),
    O.with_tables(O.PRODUCTION, body=O.ope(None, None) + " SELECT * FROM ope_kpi"),
)
add(
    "ope_by_line",
    over_production(lambda df: kpis.ope_kpis(df, "LineDesc")),
    O.with_tables(O.PRODUCTION, body=O.ope("LineDesc", "LineDesc") + " SELECT * FROM ope_kpi"),
)
add(
    "ope_by_month",
    over_production(lambda df: kpis.by_month(kpis.ope_kpis(df, kpis.month_key("EffectiveDate")))),
    O.with_tables(
        O.PRODUCTION,
        body=O.ope("month(EffectiveDate)", "MesNum") + f" SELECT *, {O.MONTH_LABEL} AS Mes FROM ope_kpi",
    ),
)
add(
    "ope_by_week",
    over_production(lambda df: kpis.by_week(kpis.ope_kpis(df, kpis.week_key("EffectiveDate")))),
    O.with_tables(
        O.PRODUCTION,
        body=O.ope("week(EffectiveDate)", "SemanaNum") + f" SELECT *, {WEEK_LABEL} AS SemanaLabel FROM ope_kpi",
    ),
)
add(
    "ope_by_day_last30",
    over_production(lambda df: kpis.last_days(kpis.ope_kpis(df, kpis.day_key("EffectiveDate")))),
    O.with_tables(O.PRODUCTION, body=O.ope("EffectiveDate", "Dia") + " SELECT * FROM ope_kpi" + LAST_30),
)
add(
    "ope_best_worst_line",
    over_production(kpis.best_and_worst_line),
    O.with_tables(
        O.PRODUCTION,
        body=O.ope("LineDesc", "LineDesc")
        + """ SELECT * FROM (SELECT 'MELHOR LINHA' AS Destaque, LineDesc, ope FROM ope_kpi
            ORDER BY ope DESC, LineDesc LIMIT 1)
          UNION ALL SELECT * FROM (SELECT 'PIOR LINHA', LineDesc, ope FROM ope_kpi ORDER BY ope, LineDesc LIMIT 1)""",
    ),
)
MEANS = "avg(TargProd) - avg(EffectiveProd) AS perda_media, avg(EffectiveProd) AS producao_media"
add(
    "production_loss_and_mean",
    over_production(
        lambda df: kpis.production_means(df).withColumn("perda_texto", labels.thousands(F.col("perda_media")))
    ),
    O.with_tables(
        O.PRODUCTION,
        body=f" SELECT *, format('{{:,}}', CAST(trunc(perda_media) AS BIGINT)) AS perda_texto"
        f" FROM (SELECT {MEANS} FROM production)",
    ),
)
for name, column in (("production_loss", "perda_media"), ("production_mean", "producao_media")):
    add(
        f"{name}_by_day_last30",
        over_production(
            lambda df, c=column: kpis.last_days(
                kpis.production_means(df, kpis.day_key("EffectiveDate")).select("Dia", c)
            )
        ),
        O.with_tables(
            O.PRODUCTION,
            body=f" SELECT Dia, {column} FROM (SELECT EffectiveDate AS Dia, {MEANS} FROM production"
            f" WHERE EffectiveDate IS NOT NULL GROUP BY EffectiveDate)" + LAST_30,
        ),
    )

# --- Filters -------------------------------------------------------------------


@query(
    "filter_date_line_shift",
    O.with_tables(
        O.STOPS,
        body=""" SELECT * FROM stops WHERE EffectiveDay BETWEEN DATE '2024-01-05' AND DATE '2024-02-20'
          AND LineDesc = 'CHASSIS5' AND ShiftId = 2""",
    ),
)
def filter_date_line_shift(spark: SparkSession, sf: str) -> DataFrame:
    df = filters.in_date_range(plant.stops(spark, sf), "EffectiveDay", "2024-01-05", "2024-02-20")
    return filters.with_shift(filters.with_line(df, "CHASSIS5"), 2)


add(
    "filter_line_group",
    over_stops(lambda df: filters.with_line_group(df, "SUBASSEMBLY")),
    O.with_tables(O.STOPS, body=" SELECT * FROM stops WHERE LineGroupDesc = 'SUBASSEMBLY'"),
)
add(
    "filter_day_type",
    lambda spark, sf: filters.with_day_type(
        plant.stops(spark, sf), "EffectiveDay", plant.calendar(spark, sf), "Improdutivo"
    ),
    O.with_tables(
        O.STOPS,
        O.CALENDAR,
        body=" SELECT * FROM stops WHERE EffectiveDay IN (SELECT Data FROM calendar WHERE Tipo = 'Improdutivo')",
    ),
)
for kind, stop_type, test in (
    ("breakdown", S.STOP_TYPE_BREAKDOWN, "Duration >= 600"),
    ("micro", S.STOP_TYPE_MICRO, "Duration < 600"),
):
    add(
        f"filter_stop_type_{kind}",
        over_stops(lambda df, t=stop_type: filters.with_stop_type(df, t)),
        O.with_tables(O.STOPS, body=f" SELECT * FROM stops WHERE {test}"),
    )
PRODUCTION_FILTER = """EffectiveDate BETWEEN DATE '1996-03-01' AND DATE '1999-10-31' AND LineDesc = 'DECKING02'
  AND ShiftId = 1 AND EffectiveDate IN (SELECT Data FROM calendar WHERE Tipo = 'Produtivo')"""
PRODUCTION_SPEC = filters.FilterSpec("1996-03-01", "1999-10-31", line="DECKING02", shift=1, day_type="Produtivo")
for name in ("filter_production", "filter_engine_production"):
    add(
        name,
        (lambda spark, sf: PRODUCTION_SPEC.production(plant.production(spark, sf), plant.calendar(spark, sf)))
        if name == "filter_production"
        else (
            lambda spark, sf: kpis.ope_kpis(
                PRODUCTION_SPEC.apply(
                    plant.stops(spark, sf), plant.production(spark, sf), plant.calendar(spark, sf)
                )[1],
                kpis.month_key("EffectiveDate"),
            )
        ),
        O.with_tables(
            O.PRODUCTION, O.CALENDAR, body=f" SELECT * FROM production WHERE {PRODUCTION_FILTER}"
        )
        if name == "filter_production"
        else O.with_tables(
            O.PRODUCTION.replace("production AS", "every AS"),
            O.CALENDAR,
            f"production AS (SELECT * FROM every WHERE {PRODUCTION_FILTER})",
            body=O.ope("month(EffectiveDate)", "MesNum") + " SELECT * FROM ope_kpi",
        ),
    )
for name, mode, test in (
    ("stop_in_go_only", S.STOP_IN_GO_ONLY, "hit"),
    ("stop_in_go_excluded", S.STOP_IN_GO_NONE, "NOT hit"),
):
    add(
        name,
        over_stops(lambda df, m=mode: filters.with_stop_in_go(df, m)),
        O.with_tables(O.STOPS, O.filled("stops"), body=f" SELECT * EXCLUDE (hit) FROM filled WHERE {test}"),
    )
STOPS_SPEC = filters.FilterSpec(
    "2024-01-01",
    "2024-03-10",
    line_group="MAIN LINE",
    shift=1,
    day_type="Produtivo",
    stop_type=S.STOP_TYPE_MICRO,
)
add(
    "filter_engine_stops",
    lambda spark, sf: STOPS_SPEC.apply(
        plant.stops(spark, sf), plant.production(spark, sf), plant.calendar(spark, sf)
    )[0],
    O.with_tables(
        O.STOPS,
        O.CALENDAR,
        """chosen AS (SELECT * FROM stops WHERE EffectiveDay BETWEEN DATE '2024-01-01' AND DATE '2024-03-10'
          AND LineGroupDesc = 'MAIN LINE' AND ShiftId = 1 AND Duration < 600
          AND EffectiveDay IN (SELECT Data FROM calendar WHERE Tipo = 'Produtivo'))""",
        O.filled("chosen"),
        body=" SELECT * EXCLUDE (hit) FROM filled WHERE NOT hit",
    ),
)
add(
    "filter_options_lines",
    lambda spark, sf: filters.line_options(plant.stops(spark, sf), plant.production(spark, sf)),
    O.with_tables(
        O.STOPS,
        O.PRODUCTION,
        body=""" SELECT LineDesc FROM stops WHERE LineDesc IS NOT NULL
          UNION SELECT LineDesc FROM production WHERE LineDesc IS NOT NULL""",
    ),
)
add(
    "filter_options_line_groups",
    over_stops(filters.line_group_options),
    O.with_tables(O.STOPS, body=" SELECT DISTINCT LineGroupDesc FROM stops WHERE LineGroupDesc IS NOT NULL"),
)
add(
    "filter_options_shifts",
    over_stops(
        lambda df: filters.shift_options(df).withColumn("Turno", labels.shift_label(F.col("ShiftId")))
    ),
    O.with_tables(
        O.STOPS,
        body=""" SELECT DISTINCT ShiftId, CASE ShiftId WHEN 1 THEN 'Turno 3' WHEN 2 THEN 'Turno 1'
          WHEN 3 THEN 'Turno 2' ELSE 'Todos' END AS Turno FROM stops WHERE ShiftId IS NOT NULL""",
    ),
)
add(
    "filter_date_bounds",
    over_stops(filters.date_bounds),
    O.with_tables(
        O.STOPS, body=" SELECT min(EffectiveDay) AS min_date, max(EffectiveDay) AS max_date FROM stops"
    ),
)

SELECTED = """chosen AS (SELECT * FROM grouped WHERE EffectiveDay BETWEEN DATE '2024-01-01' AND DATE '2024-03-10'
  AND LineGroupDesc = 'MAIN LINE' AND ShiftId = 1 AND Duration < 600
  AND EffectiveDay IN (SELECT Data FROM calendar WHERE Tipo = 'Produtivo'))"""


@query(
    "dashboard_components",
    O.with_tables(
        O.STOPS,
        O.CALENDAR,
        O.GROUPED,
        SELECTED,
        O.filled("chosen"),
        "picked AS (SELECT * FROM filled WHERE NOT hit)",
        body=O.kpis("ElementDesc", "ElementDesc", "picked")
        + " SELECT ElementDesc AS COMPONENTE, mttr_minutos AS MTTR FROM kpi",
    ),
)
def dashboard_components(spark: SparkSession, sf: str) -> DataFrame:
    """One table of a whole page: grouped, filtered, condensed, then aggregated."""
    page = Dashboard.select(
        STOPS_SPEC, stored_groups(spark, sf), plant.production(spark, sf), plant.calendar(spark, sf)
    )
    return page.reliability()["mttr_por_componente"]


# --- Grouping and remaining-life features --------------------------------------

add("stop_groups", grouped_stops, O.with_tables(O.STOPS, O.GROUPED, body=" SELECT * FROM grouped"))

add(
    "stop_groups_without_id",
    lambda spark, sf: grouping.group_stops(
        filters.extract_failures(plant.stops(spark, sf).drop("StopId"), SINCE)
    ).drop("StopId"),
    O.with_tables(O.STOPS, O.GROUPED_WITHOUT_ID, body=" SELECT * EXCLUDE (StopId) FROM grouped"),
)
add(
    "stop_groups_by_alarm",
    lambda spark, sf: grouping.group_stops(filters.extract_failures(plant.stops(spark, sf), SINCE), "alarm"),
    O.with_tables(O.STOPS, O.GROUPED_BY_ALARM, body=" SELECT * FROM grouped"),
)
add(
    "component_days",
    over_stops(lambda df: rul.component_days(df).drop("day_number")),
    O.with_tables(O.STOPS, body=O.rul() + " SELECT * FROM daily"),
)
for name, target, frame in (
    ("rul_features", "after_next", "rows"),
    ("rul_features_next_target", "next", "rows"),
    ("rul_features_calendar_days", "after_next", "days"),
):
    add(
        name,
        over_stops(lambda df, t=target, f=frame: rul.rul_features(df, t, f)),
        O.with_tables(O.STOPS, body=O.rul(target, frame) + " SELECT * FROM features"),
    )
add(
    "rul_latest_per_component",
    over_stops(lambda df: rul.latest_per_component(rul.rul_features(df))),
    O.with_tables(O.STOPS, body=O.rul() + O.LATEST + " SELECT * FROM latest"),
)


@query(
    "rul_eligible_components",
    O.with_tables(
        O.STOPS,
        body=O.rul()
        + """ SELECT * FROM features WHERE ElementDesc IN (
          SELECT ElementDesc FROM stops WHERE LineGroupDesc = 'SUBASSEMBLY' OR LineDesc = 'CHASSIS5')""",
    ),
)
def rul_eligible_components(spark: SparkSession, sf: str) -> DataFrame:
    stops = plant.stops(spark, sf)
    chosen = stops.filter((F.col("LineGroupDesc") == "SUBASSEMBLY") | (F.col("LineDesc") == "CHASSIS5"))
    return rul.eligible_components(rul.rul_features(stops), chosen)


COMPONENT_TEXTS = ", ".join(
    f"coalesce({c}, 'N/A') AS {c}" for c in ("LineGroupDesc", "LineDesc", "StationDesc", "ElementDesc")
)


def _report_from_stand_in(spark: SparkSession, sf: str) -> DataFrame:
    latest = rul.latest_per_component(rul.rul_features(plant.stops(spark, sf)))
    stand_in = F.col("tempo_desde_ultima_parada") * 3.9 + F.col("paradas_ultimos_7d") / 8
    return remaining_life.failure_report(
        latest.withColumn("RUL_Previsto", stand_in), F.lit("2024-02-15").cast("date")
    )


add(
    "rul_report_arithmetic",
    _report_from_stand_in,
    O.with_tables(O.STOPS, body=O.rul() + O.LATEST + O.REPORT + " SELECT * FROM report"),
)
add(
    "rul_report_presentation",
    lambda spark, sf: remaining_life.presentation(_report_from_stand_in(spark, sf)),
    O.with_tables(
        O.STOPS,
        body=O.rul()
        + O.LATEST
        + O.REPORT
        + """ SELECT "Componente em Risco",
          CAST("Previsão (dias a partir de hoje)" AS VARCHAR) AS "Previsão (dias a partir de hoje)",
          strftime("Data Estimada da Falha Crítica", '%d/%m/%Y') AS "Data Estimada da Falha Crítica",
          strftime("Baseado em Dados de", '%d/%m/%Y') AS "Baseado em Dados de" FROM report""",
    ),
)



@query(
    "risk_report_presentation",
    O.with_tables(
        O.STOPS,
        body=f""", c AS (SELECT {COMPONENT_TEXTS}, count(*) * 7919 % 10000 / 10000.0 AS p FROM stops GROUP BY ALL)
          SELECT row_number() OVER (ORDER BY p DESC, nullif(StationDesc, 'N/A') NULLS FIRST,
              nullif(ElementDesc, 'N/A') NULLS FIRST) AS posicao, nullif(StationDesc, 'N/A') AS StationDesc,
            nullif(ElementDesc, 'N/A') AS ElementDesc, printf('%.2f%%', p * 100) AS "Probabilidade de Breakdown"
          FROM c""",
    ),
)
def risk_report_presentation(spark: SparkSession, sf: str) -> DataFrame:
    """Order, blanks and percent texts of the risk report, of a stand-in for the probabilities."""
    share = (F.count(F.lit(1)) * 7919 % 10000 / F.lit(10000.0)).alias(risk.RISK)
    scored = risk.as_features(plant.stops(spark, sf)).groupBy(*risk.FEATURES[:4]).agg(share)
    report = risk.presentation(risk.risk_report(scored).coalesce(1))  # one row per component
    return report.select((F.monotonically_increasing_id() + 1).alias("posicao"), "*")


# --- Model inputs and quality measures ------------------------------------------

TEXT_FEATURES = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'N/A') AS {c}" for c in risk.FEATURES)

add(
    "distinct_components",
    over_stops(lambda df: risk.as_features(filters.distinct_components(df).withColumn("ShiftId", F.lit(1)))),
    O.with_tables(
        O.STOPS,
        body=f" SELECT {TEXT_FEATURES} FROM (SELECT DISTINCT LineGroupDesc, LineDesc, StationDesc, ElementDesc,"
        " 1 AS ShiftId FROM stops)",
    ),
)
add(
    "breakdown_training_rows",
    over_stops(risk.training_rows),
    O.with_tables(
        O.STOPS,
        body=f" SELECT StopId, {TEXT_FEATURES}, CASE WHEN Duration >= 600 THEN 1 ELSE 0 END AS Target FROM stops",
    ),
)
add(
    "class_weights",
    over_stops(lambda df: sampling.class_weights(risk.training_rows(df), "Target")),
    O.with_tables(
        O.STOPS,
        body=""", t AS (SELECT CASE WHEN Duration >= 600 THEN 1 ELSE 0 END AS Target FROM stops)
          SELECT Target, count(*) AS linhas, (SELECT count(*) FROM t) / (2 * count(*)) AS peso FROM t GROUP BY Target""",
    ),
)


def _sizes(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    parts = train.select(label, F.lit(1).alias("in_train")).union(test.select(label, F.lit(0)))
    return parts.groupBy(F.col(label).alias("Target")).agg(
        F.sum("in_train").cast("long").alias("treino"), F.sum(1 - F.col("in_train")).cast("long").alias("teste")
    )


@query(
    "stratified_split_sizes",
    O.with_tables(
        O.STOPS,
        body=", "
        + O.SPLIT_SIZES.format(rows="SELECT CASE WHEN Duration >= 600 THEN 1 ELSE 0 END AS level FROM stops"),
    ),
)
def stratified_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = risk.training_rows(plant.stops(spark, sf)).select("StopId", "Target")
    return _sizes(*sampling.exact_split(rows, ["StopId"], "Target"), "Target")


@query(
    "random_split_sizes",
    O.with_tables(O.STOPS, body=O.rul() + ", " + O.SPLIT_SIZES.format(rows="SELECT 0 AS level FROM features")),
)
def random_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    features = stage(rul.rul_features(plant.stops(spark, sf)), "rul-features").withColumn("level", F.lit(0))
    return _sizes(*sampling.exact_split(features, ["ElementDesc", "StartTime"]), "level")


@query("classification_report", O.with_tables(O.STOPS, body=O.STAND_IN_CLASSES))
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    predictions = plant.stops(spark, sf).select(
        labels.is_breakdown(F.col("Duration")).cast("int").alias("Target"),
        (F.col("StopId") % 7 < 3).cast("int").alias("prediction"),
    )
    report = metrics.classification_report(predictions)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


@query(
    "regression_metrics",
    O.with_tables(
        O.STOPS,
        body=""", p AS (SELECT CAST(Duration AS DOUBLE) AS y, CAST(StopId * 7919 % 1200 AS DOUBLE) AS p FROM stops)
          SELECT round(avg(abs(y - p)), 6) AS mae,
            round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM p""",
    ),
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    predictions = plant.stops(spark, sf).select(
        F.col("Duration").cast("double").alias("RUL"),
        (F.col("StopId") * 7919 % 1200).cast("double").alias("prediction"),
    )
    return metrics.regression_metrics(predictions).select(F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"))


# --- Selections from stored tables ------------------------------------------------

# The rare type of day leaves few months of the production log; the dates leave all.
STORED_SPEC = filters.FilterSpec("1995-01-01", "2024-12-31", line_group="MAIN LINE", day_type="Parada")
STORED_CALENDAR = "CASE WHEN day(Data) = 5 AND month(Data) = 2 THEN 'Parada' ELSE 'Produtivo' END AS Tipo"


def _stored_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """A calendar, read from its file, in which one day a year is of a type of its own."""
    path = new_shared_path(spark, "calendar-csv")
    tables.write_calendar_csv(plant.calendar(spark, sf).selectExpr("Data", STORED_CALENDAR), path)
    return tables.read_calendar_csv(spark, path)


@query(
    "filter_stored_stops",
    O.with_tables(
        O.STOPS,
        O.filled("(SELECT * FROM stops WHERE LineGroupDesc = 'MAIN LINE' AND month(EffectiveDay) = 2 AND day(EffectiveDay) = 5)"),
        body=f" SELECT StopId, {', '.join(S.STOP_COLUMNS)} FROM filled WHERE NOT hit",
    ),
)
def filter_stored_stops(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "stops-months")
    tables.write_stops(plant.stops(spark, sf), path)
    return STORED_SPEC.stored_stops(spark, path, _stored_calendar(spark, sf)).select("StopId", *S.STOP_COLUMNS)


@query(
    "filter_stored_production",
    O.with_tables(O.PRODUCTION, body=" SELECT * FROM production WHERE month(EffectiveDate) = 2 AND day(EffectiveDate) = 5"),
)
def filter_stored_production(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "production-months")
    tables.write_production(plant.production(spark, sf), path)
    return STORED_SPEC.stored_production(spark, path, _stored_calendar(spark, sf))


# --- Sources and sinks -----------------------------------------------------------

STOP_SELECT = ", ".join(S.STOP_COLUMNS)
STOPS_WITH_ID = T.StructType([S.STOP_ID, *S.STOPS.fields])
# Stops with fractions of a second, and with quotes, separators and line breaks in texts.
AWKWARD_STOPS = O.with_tables(
    O.STOPS,
    body=""", awkward AS (SELECT * REPLACE (
      CASE WHEN StopId % 3 = 0 THEN Duration + 0.5 ELSE CAST(Duration AS DOUBLE) END AS Duration,
      CASE StopId % 4 WHEN 0 THEN AlarmDesc || ' "A", aberta; fechada' WHEN 1 THEN AlarmDesc || chr(10) || '"fim"'
        ELSE AlarmDesc END AS AlarmDesc) FROM stops) """,
)


def awkward_stops(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("StopId") % 4
    alarm = F.when(number == 0, F.concat("AlarmDesc", F.lit(' "A", aberta; fechada')))
    alarm = alarm.when(number == 1, F.concat("AlarmDesc", F.lit('\n"fim"'))).otherwise(F.col("AlarmDesc"))
    duration = F.col("Duration") + F.when(F.col("StopId") % 3 == 0, 0.5).otherwise(0.0)
    stops = plant.stops(spark, sf).withColumns({"AlarmDesc": alarm, "Duration": duration})
    return stops.select(STOPS_WITH_ID.fieldNames())


@query("stops_csv_round_trip", AWKWARD_STOPS + f"SELECT StopId, {STOP_SELECT} FROM awkward")
def stops_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "stops-csv")
    tables.write_stops_csv(awkward_stops(spark, sf), path)
    return tables.read_stops_csv(spark, path, STOPS_WITH_ID, multi_line=True)


@query("stops_one_file_ranges", AWKWARD_STOPS + f"SELECT StopId, {STOP_SELECT} FROM awkward")
def stops_one_file_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """All stops from a single file with line breaks in texts, which is read range by range."""
    path = f"{new_shared_path(spark, 'stops-file')}/stops.csv"
    stops = awkward_stops(spark, sf)
    tables.export_csv_file(stops, path, ",")
    return tables.read_stops_csv(spark, path, STOPS_WITH_ID, multi_line=True)


@query(
    "stops_cache_date_range",
    O.with_tables(
        O.STOPS,
        body=f" SELECT StopId, {STOP_SELECT} FROM stops"
        " WHERE EffectiveDay BETWEEN DATE '2024-01-20' AND DATE '2024-02-10'",
    ),
)
def stops_cache_date_range(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "stops-cache")
    cache.cached(spark, path, lambda: plant.stops(spark, sf).select(STOPS_WITH_ID.fieldNames()))
    return cache.read_cached(spark, path, dt.date(2024, 1, 20), dt.date(2024, 2, 10))


@query(
    "stops_cache_refresh",
    O.with_tables(
        O.STOPS,
        body=""" SELECT passo, LineDesc, count(*) AS paradas, sum(Duration)::BIGINT AS segundos FROM (
            SELECT unnest(['primeira', 'interrompida', 'ainda nova']) AS passo, * FROM stops WHERE StopId % 2 = 0
            UNION ALL SELECT unnest(['vencida', 'depois']) AS passo, * FROM stops) GROUP BY ALL""",
    ),
)
def stops_cache_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """What readers of a cache see: at first half of the stops; the same after a refresh that breaks off, and while
    it is young enough; all stops once it has grown old, and from then on."""
    path = new_shared_path(spark, "stops-cache")
    every = plant.stops(spark, sf).select(STOPS_WITH_ID.fieldNames())
    clock = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
    hour, seen = dt.timedelta(hours=1), {}

    def broken() -> DataFrame:
        return every.withColumn("Duration", F.raise_error(F.lit("interrupted")).cast("long"))

    def look(step: str, extract: Callable[[], DataFrame], hours: float) -> None:
        stops = cache.cached(spark, path, extract, hour, lambda: clock + hours * hour)
        seen[step] = stops.withColumn("passo", F.lit(step))

    look("primeira", lambda: every.filter("StopId % 2 = 0"), 0)
    with suppress(SparkRuntimeException):
        cache.refresh(spark, path, broken)
    seen["interrompida"] = cache.read_cached(spark, path).withColumn("passo", F.lit("interrompida"))
    look("ainda nova", lambda: every, 1)
    look("vencida", lambda: every, 1.5)
    look("depois", broken, 2)
    return reduce(DataFrame.unionByName, seen.values()).groupBy("passo", "LineDesc").agg(
        F.count(F.lit(1)).alias("paradas"), F.sum("Duration").alias("segundos")
    )


@query(
    "production_csv_round_trip",
    O.with_tables(
        O.PRODUCTION,
        body=""" SELECT CASE WHEN EffectiveProd % 10 = 0 THEN NULL ELSE CAST(EffectiveDate AS TIMESTAMP) END
            AS EffectiveDate, LineDesc, ShiftId, CAST(EffectiveProd AS DOUBLE) AS EffectiveProd,
            CAST(TargProd AS DOUBLE) AS TargProd FROM production""",
    ),
)
def production_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Some dates are spoilt on the way out and must come back as nulls."""
    path = new_shared_path(spark, "production-csv")
    date_text = F.when(F.col("EffectiveProd") % 10 == 0, "sem data").otherwise(F.col("EffectiveDate").cast("string"))
    plant.production(spark, sf).withColumn("EffectiveDate", date_text).write.csv(path, header=True, sep=";")
    return tables.read_production_csv(spark, path)


@query(
    "calendar_from_text",
    """WITH dias AS (SELECT o_orderkey % 3 AS m, CAST(o_orderdate AS DATE) AS d FROM orders),
      pares AS (SELECT d FROM dias WHERE m < 2 UNION ALL SELECT CAST(d + 1 AS DATE) FROM dias WHERE m = 0)
      SELECT d AS Data, CASE WHEN isodow(d) >= 6 THEN 'Improdutivo' ELSE 'Produtivo' END AS Tipo FROM pares""",
)
def calendar_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.calendar_from_text(plant.calendar_text(spark, sf))


@query(
    "calendar_csv_round_trip",
    """SELECT d AS Data, CASE WHEN isodow(d) >= 6 THEN 'Improdutivo' ELSE 'Produtivo' END AS Tipo FROM (
      SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 3 < 2
      UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) FROM orders WHERE o_orderkey % 3 = 0)""",
)
def calendar_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "calendar-csv")
    days = tables.calendar_from_text(plant.calendar_text(spark, sf))
    tables.write_calendar_csv(tables.require_rows(days), path)
    return tables.read_calendar_csv(spark, path)


@query("features_csv_round_trip", O.with_tables(O.STOPS, body=O.rul() + " SELECT * FROM features"))
def features_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "features-csv")
    tables.write_features(rul.rul_features(plant.stops(spark, sf)), path, format="csv")
    return tables.read_features(spark, path, format="csv")


def _as_text(name: str) -> str:
    if name in tables.TIMESTAMPS:
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"
    return f"CAST({name} AS VARCHAR) AS " + (f'"{tables.BYTE_ORDER_MARK}StopId"' if name == "StopId" else name)


@query(
    "export_csv_round_trip",
    AWKWARD_STOPS + f"SELECT {', '.join(map(_as_text, STOPS_WITH_ID.fieldNames()))} FROM awkward",
)
def export_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All columns, read back as plain texts, so the byte-order mark stays visible."""
    path = new_shared_path(spark, "export-csv")
    tables.export_csv(awkward_stops(spark, sf), path)
    names = STOPS_WITH_ID.fieldNames()
    reader = spark.read.schema(", ".join(f"{n} string" for n in names)).options(**tables.QUOTES)
    back = reader.csv(path, header=True, sep=";", enforceSchema=True, multiLine=True)
    return back.withColumnRenamed("StopId", tables.BYTE_ORDER_MARK + "StopId")


def _field(name: str) -> str:
    """SQL of a value as a plain writer puts it."""
    text = f"coalesce({_as_text(name).rsplit(' AS ', 1)[0]}, '')"
    quoted = f"""'"' || replace({text}, '"', '""') || '"'"""
    return f"""CASE WHEN regexp_matches({text}, '[;"\r\n]') THEN {quoted} ELSE {text} END"""


@query(
    "export_one_file",
    AWKWARD_STOPS
    + f"""SELECT unnest(string_split({" || ';' || ".join(map(_field, STOPS_WITH_ID.fieldNames()))}, chr(10))) AS linha,
        false AS marca, 1 AS arquivos FROM awkward
      UNION ALL SELECT '{";".join(STOPS_WITH_ID.fieldNames())}', true, 1""",
)
def export_one_file(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the one file, which line bears the mark, and how many files there are."""
    folder = new_shared_path(spark, "export-file")
    tables.export_csv_file(awkward_stops(spark, sf), f"{folder}/export.csv")
    files = [e for e in Files(spark, folder).entries(folder) if not e.name.endswith(".crc")]
    mark = tables.BYTE_ORDER_MARK.encode()
    marked = Files(spark, folder).head(files[0].path, len(mark)) == mark
    # A reader of text drops a mark at the beginning of a file, and only there.
    line = F.regexp_replace("value", f"^{tables.BYTE_ORDER_MARK}", "").alias("linha")
    header = F.lit(marked) & F.col("linha").startswith("StopId;")
    lines = spark.read.text(folder, lineSep="\n").select(line)
    return lines.withColumn("marca", header | F.col("linha").contains(tables.BYTE_ORDER_MARK)).withColumn(
        "arquivos", F.lit(len(files))
    )


# --- Models ----------------------------------------------------------------------


@once
def _risk_training(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Train once per session and table folder; queries load the saved model."""
    fitted = risk.train(plant.stops(spark, sf))
    return save_model(fitted.model, new_shared_path(spark, "risk-model")), fitted.report


@once
def _rul_training(spark: SparkSession, sf: str) -> tuple[str, DataFrame, DataFrame]:
    features = stage(rul.rul_features(plant.stops(spark, sf)), "rul-features")
    fitted = remaining_life.train(features)
    return save_model(fitted.model, new_shared_path(spark, "rul-model")), fitted.metrics, features


# The queries below say of all rows of a model's result what SQL can say about them.

BREAKDOWN_LEVEL = "SELECT CASE WHEN Duration >= 600 THEN 1 ELSE 0 END AS level FROM stops"


@query(
    "breakdown_training_report",
    O.with_tables(
        O.STOPS,
        body=", "
        + O.SPLIT_SIZES.format(rows=BREAKDOWN_LEVEL).replace("\nSELECT level", ",\nsizes AS (SELECT level")
        + """) SELECT CASE Target WHEN 0 THEN 'Microparada' ELSE 'Breakdown' END AS classe, teste AS support,
          true AS medidas_validas FROM sizes
        UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT CAST(sum(teste) AS BIGINT)
          FROM sizes), true""",
    ),
)
def breakdown_training_report(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of each class; all measures lie between 0 and 1."""
    valid = reduce(and_, [F.col(c).between(0, 1) for c in ("precision", "recall", "f1_score")])
    return _risk_training(spark, sf)[1].select("classe", "support", valid.alias("medidas_validas"))


def _scored(spark: SparkSession, sf: str) -> tuple:
    model = load_model(_risk_training(spark, sf)[0])
    return model, stage(risk.score_components(model, plant.stops(spark, sf)), "risk-scores")


@query(
    "breakdown_risk_scores",
    O.with_tables(O.STOPS, body=f" SELECT DISTINCT {COMPONENT_TEXTS}, true AS probabilidade_valida FROM stops"),
)
def breakdown_risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct component has one probability."""
    scored = _scored(spark, sf)[1]
    return scored.select(*risk.FEATURES[:4], F.col(risk.RISK).between(0, 1).alias("probabilidade_valida"))


@query("highest_risk_component", "SELECT true AS maior_de_todos, true AS texto_confere")
def highest_risk_component(spark: SparkSession, sf: str) -> DataFrame:
    """The component shown has the highest probability, as a percentage with two decimals."""
    scored = _scored(spark, sf)[1]
    top = risk.highest_risk(scored).select(F.col(risk.RISK).alias("top"), labels.percent_text(F.col(risk.RISK)).alias("t"))
    most = scored.agg(F.max(risk.RISK).alias("most"))
    shown = F.abs(F.regexp_replace("t", "%", "").cast("double") / 100 - F.col("most")) <= 0.00005 + 1e-9
    return cards.beside(top, most).select(
        (F.col("top") == F.col("most")).alias("maior_de_todos"), shown.alias("texto_confere")
    )


@query(
    "breakdown_attribution",
    "SELECT unnest(['LineGroupDesc', 'LineDesc', 'StationDesc', 'ElementDesc', 'ShiftId']) AS feature, true AS soma_confere",
)
def breakdown_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Base and contributions of all features add up to the prediction."""
    explained = stage(attribution.explain_highest_risk(*_scored(spark, sf)), "attribution")
    total = explained.agg(F.sum("contribuicao").alias("total")).select(F.lit(1).alias("_one"), "total")
    added = explained.withColumn("_one", F.lit(1)).join(total, "_one")
    same = F.abs(F.col("base") + F.col("total") - F.col("previsao")) < 1e-9
    return added.select("feature", same.alias("soma_confere"))


@query("rul_training_metrics", "SELECT true AS erro_valido, true AS r2_valido")
def rul_training_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rul_training(spark, sf)[1].select(
        (F.col("mae") >= 0).alias("erro_valido"), (F.col("r2") <= 1).alias("r2_valido")
    )


def _planted_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Stops whose breakdowns follow station and shift, but for one in ten that chance decides."""
    stops = plant.stops(spark, sf)
    by_place = (F.ascii(F.substr("StationDesc", F.lit(-1), F.lit(1))) + F.coalesce("ShiftId", F.lit(0))) % 2 == 0
    by_chance = F.pmod(F.xxhash64("StopId"), F.lit(2)) == 0
    long = F.when(F.pmod(F.xxhash64(F.lit("x"), "StopId"), F.lit(10)) == 0, by_chance).otherwise(by_place)
    return stops.withColumn("Duration", F.when(F.coalesce(long, F.lit(False)), 900).otherwise(30).cast("long"))


def _differ(one: DataFrame, other: DataFrame) -> Column:
    """Whether two tables differ in any row, as a column of one table of one row."""
    return F.lit(not (one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()))


@query("breakdown_planted_signal", "SELECT true AS melhor_que_constante, true AS salvo_igual_ao_treinado")
def breakdown_planted_signal(spark: SparkSession, sf: str) -> DataFrame:
    """On a signal that nine of ten stops follow, test accuracy lies above 0.8 and well above a constant's."""
    stops = stage(_planted_stops(spark, sf), "planted-stops")
    fitted = risk.train(stops, trees=10, depth=6)
    loaded = load_model(save_model(fitted.model, new_shared_path(spark, "planted-risk")))
    one, other = (risk.score_components(m, stops).select(*risk.FEATURES, risk.RISK) for m in (fitted.model, loaded))
    report = fitted.report
    part = lambda name, column: F.max(F.when(F.col("classe") == name, F.col(column)))
    constant = F.greatest(part("Microparada", "support"), part("Breakdown", "support")) / part("accuracy", "support")
    accuracy = part("accuracy", "precision")
    better = (accuracy > 0.8) & (accuracy > constant + 0.1)
    return report.agg(better.alias("melhor_que_constante")).withColumn("salvo_igual_ao_treinado", ~_differ(one, other))


@query("rul_planted_signal", "SELECT true AS metade_do_erro_constante, true AS r2_alto, true AS salvo_igual_ao_treinado")
def rul_planted_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Days that fall with a component's stops of a week, and noise: the error is below half of a constant's."""
    days = S.RUL_MODEL_COLUMNS[0]
    noise = F.pmod(F.xxhash64("ElementDesc", "StartTime"), F.lit(100)) / F.lit(100.0)
    known = stage(rul.rul_features(plant.stops(spark, sf)), "rul-features")
    most = known.agg(F.greatest(F.max(days), F.lit(1.0)).alias("most"))
    planted = cards.beside(known, most).withColumn("RUL", 60 - 50 * F.col(days) / F.col("most") + noise).drop("most")
    features = stage(planted, "planted-features")
    fitted = remaining_life.train(features, trees=20, depth=6)
    loaded = load_model(save_model(fitted.model, new_shared_path(spark, "planted-life")))
    mean = fitted.test.agg(F.avg("RUL").alias("mean"))
    off = cards.beside(fitted.test, mean).agg(F.avg(F.abs(F.col("RUL") - F.col("mean"))).alias("constant"))
    rows = remaining_life.as_numbers(features)
    one, other = (m.transform(rows).select("ElementDesc", "StartTime", "prediction") for m in (fitted.model, loaded))
    return cards.beside(fitted.metrics, off).select(
        (F.col("mae") < F.col("constant") / 2).alias("metade_do_erro_constante"),
        (F.col("r2") > 0.7).alias("r2_alto"),
        (~_differ(one, other)).alias("salvo_igual_ao_treinado"),
    )


@query("rul_report", "SELECT true AS dias_validos, true AS datas_conferem, true AS um_por_componente")
def rul_report(spark: SparkSession, sf: str) -> DataFrame:
    """No failure lies in the past, dates and days agree, and no component comes twice."""
    path, _, features = _rul_training(spark, sf)
    as_of = F.lit("2024-02-15").cast("date")
    report = remaining_life.rul_report(load_model(path), features, as_of)
    days, date = F.col(remaining_life.DAYS), F.col(remaining_life.FAILURE_DAY)
    return report.agg(
        F.coalesce(F.every(days >= 0), F.lit(True)).alias("dias_validos"),
        F.coalesce(F.every(F.date_diff(date, as_of) == days), F.lit(True)).alias("datas_conferem"),
        (F.count(F.lit(1)) == F.count_distinct(remaining_life.COMPONENT)).alias("um_por_componente"),
    )


#: What several queries share, by name: bench times it apart.
PREPARATIONS = {"grouped stops": _stored_groups_path, "risk model": _risk_training, "life model": _rul_training}

#: Queries that train a model of their own each time.
TRAININGS = {"breakdown_planted_signal", "rul_planted_signal"}
