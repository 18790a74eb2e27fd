"""Grouping against a row-by-row rendering of its rules."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from rows import at, stops

from paragem.operators import grouping
from paragem.operators.grouping import group_stops

GATE = "TIME OUT APERTURA SAFETY GATE"
OUT = [
    "EndTimeAnterior", "IniciouNovoGrupo", "IDGrupoNumerico", "Prev_ID", "Prev_EndTime", "IDGrupoFinal",
    "PrimeiroAlarmDesc", "PrimeiroElementDesc",
]


def low(value):
    """Sort key with missing values first."""
    return (value is not None, value if value is not None else 0)


def crossed(a, b):
    minute = dt.timedelta(minutes=1)
    floor = dt.datetime(1970, 1, 1)
    return (b - floor) // minute - (a - floor) // minute


def brute_force(rows, numbering="plant"):
    """The rules applied to one row after the other, all in memory."""
    rows = [dict(r) for r in rows]

    def order(*names):
        return lambda r: tuple(low(r[n]) for n in names)

    last, cell, opened = {}, {}, {}
    for r in sorted(rows, key=order("StartTime", "EndTime", "StopId")):
        key = tuple(r[c] for c in ("LineDesc", "StationDesc", "ElementDesc", "AlarmDesc"))
        end = last[key]["EndTime"] if key in last else None
        gap = crossed(end, r["StartTime"]) if end and r["StartTime"] else 0
        r["EndTimeAnterior"], r["IniciouNovoGrupo"] = end, int(end is None or gap > 5)
        last[key] = r
        if cell.get(key) != (r["StartTime"], r["EndTime"]):
            cell[key] = r["StartTime"], r["EndTime"]
            if r["IniciouNovoGrupo"]:
                opened[key] = r["StopId"]
        r["opened"] = opened[key]
    peers = ("StartTime", "LineDesc", "StationDesc", "ElementDesc")
    total, totals = 0, {}
    for r in sorted(rows, key=order(*peers)):
        total += r["IniciouNovoGrupo"]
        totals[tuple(r[c] for c in peers)] = total
    for r in rows:
        r["IDGrupoNumerico"] = totals[tuple(r[c] for c in peers)] if numbering == "plant" else r["opened"]
    last = {}
    for r in sorted(rows, key=order("StartTime", "EndTime", "AlarmDesc", "StopId")):
        key = tuple(r[c] for c in peers[1:])
        before = last.get(key)
        r["Prev_ID"] = before and before["IDGrupoNumerico"]
        r["Prev_EndTime"] = before and before["EndTime"]
        near = bool(r["Prev_EndTime"] and r["StartTime"] and crossed(r["Prev_EndTime"], r["StartTime"]) <= 5)
        r["IDGrupoFinal"] = r["Prev_ID"] if r["AlarmDesc"] == GATE and near else r["IDGrupoNumerico"]
        last[key] = r
    first = {}
    for r in sorted(rows, key=order(*peers, "EndTime", "AlarmDesc", "StopId")):
        first.setdefault(r["IDGrupoFinal"], r)
    for r in rows:
        r["PrimeiroAlarmDesc"] = first[r["IDGrupoFinal"]]["AlarmDesc"]
        r["PrimeiroElementDesc"] = first[r["IDGrupoFinal"]]["ElementDesc"]
    return {r["StopId"]: [r[c] for c in OUT] for r in rows}


def check(spark, *rows, numbering="plant"):
    df = stops(spark, *rows)
    got = {r["StopId"]: [r[c] for c in OUT] for r in group_stops(df, numbering).collect()}
    assert got == brute_force([r.asDict() for r in df.collect()], numbering)
    return got


def test_gap_counts_minute_boundaries(spark):
    got = check(
        spark,
        {"ElementDesc": "X", "StartTime": "2025-03-03T09:59:00", "EndTime": "2025-03-03T10:00:59"},
        {"ElementDesc": "X", "StartTime": "2025-03-03T10:06:00"},
        {"ElementDesc": "Y", "StartTime": "2025-03-03T09:59:00", "EndTime": "2025-03-03T10:00:00"},
        {"ElementDesc": "Y", "StartTime": "2025-03-03T10:05:59"},
    )
    assert [got[i][1] for i in range(4)] == [1, 1, 1, 0]


def test_peers_share_a_number(spark):
    got = check(spark, {"AlarmDesc": "A"}, {"AlarmDesc": "B"})
    assert got[0][2] == got[1][2] == 2


def test_gate_alarms_do_not_chain(spark):
    got = check(
        spark,
        {"StartTime": "2025-03-03T10:00:00"},
        {"StartTime": "2025-03-03T10:02:00", "AlarmDesc": GATE},
        {"StartTime": "2025-03-03T10:30:00", "ElementDesc": "E2"},
        {"StartTime": "2025-03-03T10:03:30", "AlarmDesc": GATE},
    )
    assert got[1][5] == got[0][2]
    assert got[3][5] == got[1][2]


def test_previous_stop_on_an_earlier_day(spark):
    got = check(
        spark,
        {"StartTime": "2025-03-03T23:58:00"},
        {"StartTime": "2025-03-04T00:01:00"},
        {"StartTime": "2025-03-20T00:01:00"},
    )
    assert [got[i][1] for i in range(3)] == [1, 0, 1]
    assert got[2][0] == at("2025-03-04T00:02:00")


@pytest.mark.parametrize("numbering", ["plant", "alarm"])
def test_many_ties_copies_and_blanks(spark, numbering):
    rng = random.Random(7)
    base = at("2025-03-03T23:50:00")
    rows = []
    for _ in range(500):
        start = base + dt.timedelta(seconds=rng.choice([0, 30, 61, 200, 500, 700, 1500, 90000]))
        rows.append(
            {
                "LineDesc": rng.choice(["L1", "L2", None]),
                "StationDesc": rng.choice(["S1", None]),
                "ElementDesc": rng.choice(["E1", "E2", None]),
                "AlarmDesc": rng.choice(["A", "B", GATE, None]),
                "StartTime": rng.choice([start, start, start, start, start, None]),
                "EndTime": rng.choice([start + dt.timedelta(seconds=30), start, None, start - dt.timedelta(minutes=9)]),
                "EffectiveDay": start.date(),
            }
        )
    check(spark, *rows, numbering=numbering)


def test_a_third_of_all_stops_are_copies(spark):
    rows = [{"StartTime": f"2025-03-03T10:{i % 60:02d}:00", "ElementDesc": f"E{i % 7}"} for i in range(200)]
    check(spark, *rows, *[{"AlarmDesc": GATE, "StartTime": "2025-03-03T10:20:30"}] * 100)


def test_repeated_ids_are_one_stop(spark):
    df = stops(spark, {}, {"StartTime": "2025-03-03T10:02:00", "AlarmDesc": GATE})
    many = df.union(df).union(df)
    got = group_stops(many).groupBy("StopId").agg(F.count("*").alias("n"), F.collect_set("IDGrupoFinal").alias("ids"))
    assert sorted((r.StopId, r.n, r.ids) for r in got.collect()) == [(0, 3, [1]), (1, 3, [1])]


def test_stops_without_ids(spark):
    df = stops(spark, {}, {"StartTime": "2025-03-03T10:01:30"}, {}).drop("StopId")
    out = group_stops(df)
    assert out.select("StopId").distinct().count() == 3
    assert sorted(r.IniciouNovoGrupo for r in out.collect()) == [0, 0, 1]


@pytest.mark.parametrize("given", [0, 3])
@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_missing_ids_lose_no_stop(spark, given, partitions):
    """Stops without an id come before those with one, by the remaining columns (here the duration)."""
    rng = random.Random(given)
    rows = [
        {
            "Duration": k,
            "StopId": k if k % 5 < given else None,
            "AlarmDesc": rng.choice(["A", GATE]),
            "StartTime": f"2025-03-03T10:{rng.choice([0, 2, 9, 20]):02d}:00",
            "EndTime": f"2025-03-03T10:{rng.choice([21, 22])}:30",
        }
        for k in range(60)
    ]
    df = stops(spark, *rows)
    got = {r["Duration"]: [r[c] for c in OUT] for r in group_stops(df.repartition(partitions)).collect()}
    ranked = [r.asDict() for r in df.collect()]
    for r in ranked:
        r["StopId"] = r["Duration"] - (0 if r["StopId"] is not None else 1000)
    want = brute_force(ranked)
    assert got == {k % 1000: v for k, v in want.items()}


def test_equal_stops_without_ids_open_once(spark):
    df = stops(spark, *[{}] * 7, {"AlarmDesc": GATE, "StartTime": "2025-03-03T10:02:00"}).drop("StopId")
    out = group_stops(df).collect()
    assert len(out) == 8 and sum(r.IniciouNovoGrupo for r in out) == 2
    assert len({r.StopId for r in out}) == 8


def test_only_day_sums_meet_in_one_task(spark):
    df = stops(spark, {}, {"StartTime": "2025-03-04T10:01:30"})
    numbered = grouping.number_groups(grouping.mark_openings(grouping._cells(df)))
    plan = numbered._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Python" in line for line in plan)
    gathered = [plan[i + 1] for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    assert len(gathered) == 1
    assert re.search(r"HashAggregate\(keys=\[day#\d+\], functions=\[sum\(", gathered[0])
