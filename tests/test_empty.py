"""No rows in, no rows out: nothing fails on an empty selection."""

from pyspark.sql import functions as F
from rows import production, stops

from paragem import schemas as S
from paragem.models import attribution, remaining_life, risk
from paragem.operators import filters, kpis, metrics, rul
from paragem.operators.grouping import group_stops
from paragem.plans.dashboard import Dashboard


def test_grouping_and_features(spark):
    none = stops(spark).limit(0)
    grouped = group_stops(none)
    assert grouped.count() == 0
    assert grouped.columns[-8:] == S.GROUP_COLUMNS.fieldNames()
    assert [f.dataType for f in grouped.schema][-8:] == [f.dataType for f in S.GROUP_COLUMNS]
    features = rul.rul_features(none)
    assert features.count() == 0
    assert {f.name: f.dataType for f in features.schema} == {f.name: f.dataType for f in S.RUL_FEATURES}
    assert rul.latest_per_component(features).count() == 0


def test_page(spark):
    none = stops(spark).limit(0).withColumn("PrimeiroAlarmDesc", F.lit(None).cast("string"))
    calendar = spark.createDataFrame([], S.CALENDAR)
    page = Dashboard.select(filters.FilterSpec("2025-01-01", "2025-12-31"), none, production(spark), calendar)
    sizes = {k: t.count() for part in (page.reliability(), page.efficiency()) for k, t in part.items()}
    assert {k for k, n in sizes.items() if n} == {"global", "total_falhas", "medias"}


def test_models(spark):
    fitted = risk.train(stops(spark, *[{"Duration": 900 * (i % 2)} for i in range(20)]), trees=2, depth=2)
    scored = risk.score_components(fitted.model, stops(spark).limit(0))
    assert risk.risk_report(scored).count() == 0
    assert attribution.explain_highest_risk(fitted.model, scored).count() == 0
    none = spark.createDataFrame([], S.RUL_FEATURES).withColumn("RUL_Previsto", F.lit(1.0))
    assert remaining_life.failure_report(none).count() == 0
    report = metrics.classification_report(spark.createDataFrame([], "Target int, prediction double"))
    assert {r.support for r in report.collect()} == {0}
    row = metrics.regression_metrics(spark.createDataFrame([], "RUL double, prediction double")).first()
    assert tuple(row) == (None, None)
