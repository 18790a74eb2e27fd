from rows import production, stops

from paragem import schemas as S
from paragem.operators import filters
from paragem.sources import tables


def ids(df):
    return sorted(r.StopId for r in df.select("StopId").collect())


def test_stop_in_go_parts_are_complementary(spark):
    cases = [
        ("Glazing01", "xZNE05", "TTS02"), ("GLAZING", "zne05", "tts02"), ("DECKING", "ZNE01", "TR01"),
        ("chassis5", "zne01", None), ("CHASSIS4", "ZNE02", "X"), ("CHASSIS2", "ZNE06", "X"), ("X", "Y", "PLS_02"),
        ("X", "Y", "PLS13"), ("X", "Y", "PLS14"), ("X", "ZNE07", "Q"), ("X", "Y", "VT_05"), ("X", "Y", "VT_06"),
        (None, None, None), ("X", "Y", "XGA08"),
    ]
    df = stops(spark, *[dict(zip(("LineDesc", "StationDesc", "ElementDesc"), c)) for c in cases])
    hit = ids(filters.with_stop_in_go(df, S.STOP_IN_GO_ONLY))
    assert hit == [0, 3, 4, 5, 6, 7, 9, 11, 13]
    assert ids(filters.with_stop_in_go(df)) == sorted(set(range(len(cases))) - set(hit))


def test_stop_in_go_blanks(spark):
    df = stops(spark, {"LineDesc": None})
    assert filters.with_stop_in_go(df, S.ALL_ROWS).first().LineDesc is None
    assert filters.with_stop_in_go(df, S.STOP_IN_GO_NONE).first().LineDesc == ""


def test_stop_types_leave_out_missing_durations(spark):
    df = stops(spark, {"Duration": 600}, {"Duration": 599}, {"Duration": None})
    assert ids(filters.with_stop_type(df, S.STOP_TYPE_BREAKDOWN)) == [0]
    assert ids(filters.with_stop_type(df, S.STOP_TYPE_MICRO)) == [1]
    assert ids(filters.with_stop_type(df, S.ALL_LINES)) == [0, 1, 2]


def test_whole_selection(spark):
    calendar = spark.sql(
        "SELECT * FROM VALUES (date'2025-03-03', 'Produtivo'), (date'2025-03-04', 'Improdutivo') AS t(Data, Tipo)"
    )
    df = stops(
        spark,
        {"StartTime": "2025-03-03T01:00:00"},
        {"StartTime": "2025-03-04T01:00:00"},
        {"StartTime": "2025-03-05T01:00:00"},
        {"StartTime": None},
        {"ShiftId": None},
    )
    made = production(spark, ("2025-03-03", "L1", 1, 1, 1), ("2025-03-04", "L1", 1, 1, 1), (None, "L1", 1, 1, 1))
    spec = filters.FilterSpec("2025-03-01", "2025-03-04", line="L1", shift=1, day_type="Produtivo")
    stops_out, made_out = spec.apply(df, made, calendar)
    assert ids(stops_out) == [0]
    assert made_out.count() == 1
    every = filters.FilterSpec("2025-03-03", "2025-03-04", stop_in_go=S.ALL_ROWS)
    assert ids(every.stops(df, calendar)) == [0, 1, 4]


def test_extraction(spark):
    df = stops(
        spark,
        {},
        {"LineGroupDesc": "LOGISTICS"},
        {"StatusDesc": "Normal"},
        {"StartTime": "2024-12-31T23:00:00"},
        {"LineGroupDesc": "SUBASSEMBLY", "StartTime": "2025-01-01T00:00:00"},
    )
    assert ids(filters.extract_failures(df)) == [0, 4]


def test_extraction_reaches_the_scan(spark):
    from paragem.session import stage

    df = filters.extract_failures(stage(stops(spark, {}), "test-scan")).select("StopId")
    (scan,) = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    pushed = scan[scan.index("PushedFilters") : scan.index("ReadSchema")]
    for part in ("In(LineGroupDesc", "GreaterThanOrEqual(EffectiveDay", "EqualTo(StatusDesc"):
        assert part in pushed
    assert scan.endswith("struct<StopId:bigint,LineGroupDesc:string,StatusDesc:string,EffectiveDay:date>")


def test_calendar_does_not_shuffle_stops(spark):
    calendar = spark.sql("SELECT date'2025-03-03' AS Data, 'Produtivo' AS Tipo")
    df = filters.with_day_type(stops(spark, {}), "EffectiveDay", calendar, "Produtivo")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Exchange hashpartitioning" not in plan
    assert df.count() == 1


def test_chosen_days_choose_the_folders_of_stored_tables(spark, tmp_path):
    days = spark.range(400).selectExpr("date_add(date'2024-01-01', CAST(id AS INT)) AS d")
    records = days.selectExpr("d AS EffectiveDate", "'L1' AS LineDesc", "1 AS ShiftId", "1L AS EffectiveProd", "1L AS TargProd")
    stored, calendar = str(tmp_path / "production"), str(tmp_path / "calendar")
    tables.write_production(records, stored)
    tables.write_calendar_csv(days.selectExpr("d AS Data", "CASE WHEN month(d) = 6 THEN 'A' ELSE 'B' END AS Tipo"), calendar)
    spec = filters.FilterSpec("2024-01-01", "2025-12-31", day_type="A")
    found = spec.stored_production(spark, stored, tables.read_calendar_csv(spark, calendar))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(EffectiveMonth" in plan
    assert found.columns == records.columns and found.count() == 30
    assert found.filter("month(EffectiveDate) <> 6").count() == 0
    nothing = spec.stored_production(spark, stored, tables.read_calendar_csv(spark, calendar).filter("false"))
    assert nothing.count() == 0
