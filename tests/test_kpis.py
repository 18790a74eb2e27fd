import datetime as dt

from rows import production, stops

from paragem.functions import labels
from paragem.operators import filters, kpis
from pyspark.sql import functions as F


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_sunday_counts_240_minutes_for_any_shift(spark):
    for shift in (1, 3, 9, None):
        df = stops(spark, {"StartTime": "2024-01-07T10:00:00", "ShiftId": shift})
        assert one(kpis.reliability_kpis(df))["mtbf_minutos"] == 240


def test_unknown_weekday_shift_counts_nothing(spark):
    df = stops(spark, {"ShiftId": 9}, {"ShiftId": None})
    assert one(kpis.reliability_kpis(df))["mtbf_minutos"] == 0


def test_a_day_shift_counts_once(spark):
    df = stops(spark, {"LineDesc": "L1"}, {"LineDesc": "L2"}, {"ShiftId": 3})
    assert one(kpis.reliability_kpis(df)) == {
        "mttr_minutos": 1.0,
        "mtbf_minutos": (498 + 330) / 3,
        "num_falhas": 3,
    }


def test_without_main_line_failure(spark):
    df = stops(spark, {"LineGroupDesc": "SUBASSEMBLY"}, {"StatusDesc": "Normal"})
    assert one(kpis.reliability_kpis(df)) == {"mttr_minutos": 0.0, "mtbf_minutos": 498.0, "num_falhas": 0}


def test_downtime_takes_every_line_group(spark):
    df = stops(spark, {"Duration": 60}, {"Duration": 120, "LineGroupDesc": "SUBASSEMBLY"}, {"Duration": None})
    assert one(kpis.reliability_kpis(df))["mttr_minutos"] == 3 / 2


def test_empty_input(spark):
    assert one(kpis.reliability_kpis(stops(spark).limit(0))) == {
        "mttr_minutos": 0.0,
        "mtbf_minutos": 0.0,
        "num_falhas": 0,
    }
    assert one(kpis.ope_kpis(production(spark))) == {
        "ope": 0.0,
        "pecas_boas": 0,
        "pecas_ruins": 0,
        "total_produzido": 0,
    }
    assert kpis.reliability_kpis(stops(spark).limit(0), "LineDesc").count() == 0


def test_missing_key_is_left_out(spark):
    df = stops(spark, {"LineDesc": None}, {"LineDesc": "L1"})
    assert [r.LineDesc for r in kpis.reliability_kpis(df, "LineDesc").collect()] == ["L1"]


def test_key_named_like_a_measured_column(spark):
    df = stops(spark, {"ShiftId": 1}, {"ShiftId": 3})
    got = {r.ShiftId: r.mtbf_minutos for r in kpis.reliability_kpis(df, "ShiftId").collect()}
    assert got == {1: 498.0, 3: 330.0}


def test_top3_ties_are_alphabetical(spark):
    df = stops(spark, *[{} for _ in range(4)]).withColumn(
        "PrimeiroAlarmDesc", F.element_at(F.array(*map(F.lit, "dbca")), (F.col("StopId") + 1).cast("int"))
    )
    assert [r[0] for r in kpis.top_alarms_by_count(df).collect()] == ["a", "b", "c"]


def test_last_30_observed_days(spark):
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=2 * i) for i in range(31)]
    df = stops(spark, *[{"StartTime": f"{d}T10:00:00"} for d in days])
    assert [r.Dia for r in kpis.last_days(kpis.failures_by_day(df)).collect()] == days[1:]


def test_months_and_weeks_ignore_the_year(spark):
    df = stops(spark, {"StartTime": "2024-01-02T10:00:00"}, {"StartTime": "2025-01-02T10:00:00"})
    (row,) = kpis.by_month(kpis.reliability_kpis(df, kpis.month_key())).collect()
    assert (row.MesNum, row.Mes, row.num_falhas) == (1, "Jan", 2)
    (row,) = kpis.by_week(kpis.reliability_kpis(df, kpis.week_key())).collect()
    assert row.SemanaLabel == "WK-1"


def test_iso_week_53(spark):
    df = stops(spark, {"StartTime": "2027-01-01T10:00:00"})
    assert one(kpis.reliability_kpis(df, kpis.week_key()))["SemanaNum"] == 53


def test_ope_guard_and_ties(spark):
    df = production(
        spark,
        ("2025-01-01", "B", 1, 50, 100),
        ("2025-01-01", "A", 1, 1, 2),
        ("2025-01-01", "C", 1, 7, 0),
        ("2025-01-01", "D", 1, 7, -1),
    )
    got = {r.Destaque: (r.LineDesc, r.ope) for r in kpis.best_and_worst_line(df).collect()}
    assert got == {"MELHOR LINHA": ("A", 50.0), "PIOR LINHA": ("C", 0.0)}


def test_means_skip_blanks_separately(spark):
    df = production(spark, ("2025-01-01", "A", 1, 10, None), ("2025-01-01", "A", 1, None, 30))
    assert one(kpis.production_means(df)) == {"perda_media": 20.0, "producao_media": 10.0}


def test_labels(spark):
    row = spark.range(1).select(
        labels.shift_label(F.lit(1)),
        labels.shift_label(F.lit(7)),
        labels.month_label(F.lit(12)),
        labels.short_text(F.lit("x" * 60)),
        labels.short_text(F.lit("curto")),
        labels.thousands(F.lit(-1234567.9)),
        labels.percent_text(F.lit(0.12345)),
        labels.day_text(F.lit("2025-03-09").cast("date")),
    ).first()
    assert list(row) == [
        "Turno 3", "Todos", "Dez", "x" * 50 + "...", "curto...", "-1,234,567", "12.35%", "09/03/2025",
    ]


def test_options(spark):
    s = stops(spark, {"LineDesc": "Z", "ShiftId": 3}, {"LineDesc": None, "ShiftId": None}, {"LineDesc": "B"})
    p = production(spark, ("2025-01-01", "A", 1, 1, 1), ("2025-01-01", "B", 1, 1, 1))
    assert [r[0] for r in filters.line_options(s, p).collect()] == ["A", "B", "Z"]
    assert [r[0] for r in filters.shift_options(s).collect()] == [1, 3]
