"""Indicators over condensed tables equal those over the rows themselves."""

import random

from pyspark.sql import functions as F
from rows import production, stops

from paragem import schemas as S
from paragem.operators import kpis
from paragem.operators.filters import FilterSpec
from paragem.plans.dashboard import Dashboard
from paragem.session import new_shared_path
from paragem.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_page_equals_direct_aggregation(spark):
    rng = random.Random(3)
    df = stops(
        spark,
        *[
            {
                "LineDesc": rng.choice(["L1", "L2", None]),
                "ElementDesc": rng.choice(["E1", "E2", None]),
                "LineGroupDesc": rng.choice(["MAIN LINE", "SUBASSEMBLY"]),
                "StatusDesc": rng.choice(["Falha/Parada", "Normal"]),
                "Duration": rng.choice([30, 700, None]),
                "ShiftId": rng.choice([1, 2, 3, None]),
                "StartTime": f"2025-0{rng.randrange(1, 6)}-{rng.randrange(1, 28):02d}T10:00:00",
            }
            for _ in range(200)
        ],
    ).withColumn("PrimeiroAlarmDesc", F.when(F.col("StopId") % 5 > 0, F.concat(F.lit("a"), F.col("StopId") % 5)))
    made = production(
        spark,
        *[
            (f"2025-0{rng.randrange(1, 6)}-{rng.randrange(1, 28):02d}", rng.choice("ABC"), 1, p, t)
            for p, t in [(rng.choice([None, 5, 9]), rng.choice([None, 10, 20])) for _ in range(100)]
        ],
    )
    calendar = spark.createDataFrame([], S.CALENDAR)
    spec = FilterSpec("2025-01-01", "2025-12-31", stop_in_go=S.ALL_ROWS)
    page = Dashboard.select(spec, df, made, calendar)
    direct = Dashboard(df, made)
    for part in ("reliability", "efficiency"):
        want = getattr(direct, part)()
        for name, table in getattr(page, part)().items():
            assert rows(table) == rows(want[name]), name
    assert page.stops.count() <= df.count()
    assert "main_line_failures" in kpis.condense_stops(page.stops).columns


def test_selections_from_stored_stops_skip_months(spark):
    path = new_shared_path(spark, "test-select")
    tables.write_stops(stops(spark, {}, {"StartTime": "2025-04-01T00:00:00"}), path)
    spec = FilterSpec("2025-03-01", "2025-03-31", stop_in_go=S.ALL_ROWS)
    calendar = spark.createDataFrame([], "Data date, Tipo string")
    selected = spec.stored_stops(spark, path, calendar)
    assert [r.StopId for r in selected.collect()] == [0]
    plan = selected._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(EffectiveMonth" in plan


def test_a_page_stores_only_the_side_it_shows(spark):
    grouped = stops(spark, {}).withColumn("PrimeiroAlarmDesc", F.lit("A"))
    page = Dashboard(grouped, production(spark, ("2025-03-03", "L1", 1, 5, 10)))
    page.reliability()
    assert [k for k in vars(page) if k in ("stops", "production")] == ["stops"]
