"""Feature building against a stop-by-stop rendering."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from rows import at, stops

from paragem.operators import rul


def brute_force(rows):
    """Repeat, back-fill and sum up stop by stop: (component, day) -> figures."""
    by_component = defaultdict(list)
    for r in rows:
        if r["ElementDesc"] is not None and r["StartTime"] is not None:
            by_component[r["ElementDesc"]].append(r)
    days = {}
    for component, items in by_component.items():
        items.sort(key=lambda r: (r["StartTime"], r["StopId"]))
        broken = [r for r in items if (r["Duration"] or 0) >= 600]
        following = [(r["StartTime"], n["StartTime"] if n else None) for r, n in zip(broken, broken[1:] + [None])]
        merged = []
        for r in items:
            hits = [nxt for t, nxt in following if t == r["StartTime"]] or [None]
            merged += [[r, nxt] for nxt in hits]
        fill = None
        for pair in reversed(merged):
            pair[1] = fill = pair[1] if pair[1] is not None else fill
        for r, aim in merged:
            if aim is None:
                continue
            day = days.setdefault((component, r["StartTime"].date()), [0, 0, 0, None])
            left = (aim - r["StartTime"]) / dt.timedelta(days=1)
            day[0] += 1
            day[1] += (r["Duration"] or 0) >= 600
            day[2] += r["Duration"] or 0
            day[3] = left if day[3] is None else min(day[3], left)
    return days


def days_of(df):
    return {
        (r.ElementDesc, r.Dia): [r.num_paradas, r.num_breakdowns, r.total_duration_parada, pytest.approx(r.RUL)]
        for r in rul.component_days(df).collect()
    }


def check(spark, *rows):
    df = stops(spark, *rows)
    want = brute_force([r.asDict() for r in df.collect()])
    assert days_of(df) == want
    return want


def test_single_breakdown_gives_nothing(spark):
    assert check(spark, {"Duration": 700}, {"StartTime": "2025-03-02T10:00:00"}) == {}


def test_stops_aim_at_the_breakdown_after_the_next(spark):
    df = stops(
        spark,
        {"StartTime": "2025-03-01T00:00:00", "Duration": 5},
        {"StartTime": "2025-03-03T00:00:00", "Duration": 900},
        {"StartTime": "2025-03-09T00:00:00", "Duration": 900},
    )
    after = {r.StartTime.day: r.RUL for r in rul.rul_features(df).collect()}
    assert after == {1: 8.0, 3: 6.0}
    following = {r.StartTime.day: r.RUL for r in rul.rul_features(df, target="next").collect()}
    assert following == {1: 2.0, 3: 6.0}


def test_equal_starts_repeat(spark):
    want = check(
        spark,
        *[{"Duration": 900}] * 2,
        {"Duration": 10},
        {"StartTime": "2025-03-05T10:00:00", "Duration": 900},
        {"StartTime": "2025-03-05T10:00:00", "Duration": 901},
    )
    assert want["E1", dt.date(2025, 3, 3)][0] == 6
    # The last repeat of the very last breakdown has nothing to aim at.
    assert want["E1", dt.date(2025, 3, 5)][0] == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_random_stops_with_ties(spark, seed):
    rng = random.Random(seed)
    base = at("2025-03-03T00:00:00")
    rows = [
        {
            "ElementDesc": rng.choice(["E1", "E2", "E3", "E4", None]),
            "StartTime": rng.choice([base + dt.timedelta(hours=5 * rng.randrange(60)), None, base]),
            "Duration": rng.choice([5, 10, 599, 600, 700, None]),
        }
        for _ in range(160)
    ]
    check(spark, *rows)


def test_rolling_frames(spark):
    df = stops(
        spark,
        {"StartTime": "2025-03-01T00:00:00", "Duration": 700},
        {"StartTime": "2025-03-20T00:00:00", "Duration": 800},
        {"StartTime": "2025-04-25T00:00:00", "Duration": 900},
    )
    by_rows = {r.StartTime.day: (r.paradas_ultimos_7d, r.tempo_desde_ultima_parada) for r in rul.rul_features(df).collect()}
    assert by_rows == {1: (1.0, 0.0), 20: (2.0, 19.0)}
    by_days = {r.StartTime.day: r.duracao_total_ultimos_7d for r in rul.rul_features(df, frame="days").collect()}
    assert by_days == {1: 700.0, 20: 800.0}


def test_latest_row(spark):
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1), 1), ("a", dt.date(2025, 1, 3), 2)], "ElementDesc string, StartTime date, x int")
    assert [r.x for r in rul.latest_per_component(df).collect()] == [2]


def test_unknown_option(spark):
    with pytest.raises(ValueError):
        rul.component_days(stops(spark, {}), target="previous")


def test_plan_reads_four_columns_and_hashes(spark):
    from paragem.session import stage

    df = rul.rul_features(stage(stops(spark, {}, {}), "test-stops"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan and "SinglePartition" not in plan
    assert "PushedFilters: [IsNotNull(ElementDesc), IsNotNull(StartTime)]" in plan
    assert "ReadSchema: struct<StopId:bigint,ElementDesc:string,Duration:double,StartTime:timestamp_ntz>" in plan
    assert plan.count("Exchange hashpartitioning") == 3
