import csv
import datetime as dt
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import stops

from paragem import schemas as S
from paragem.session import new_shared_path
from paragem.sources import cache, multiline, tables
from paragem.sources.files import Files


def local(path):
    return Path(path.removeprefix("file:"))


def test_stops_csv_with_blanks(spark, tmp_path):
    text = ",".join(S.STOP_COLUMNS) + "\n"
    text += ",MAIN LINE,L1,Falha/Parada,A,60.0,2025-01-02 03:04:05.5,2025-01-02 03:05:05,2025-01-02,S1,1.0\n"
    text += "E1,MAIN LINE,L1,Falha/Parada,A,,2025-01-02 03:04:05,,2025-01-02 00:00:00,S1,\n"
    (tmp_path / "stops.csv").write_text(text)
    a, b = tables.read_stops_csv(spark, str(tmp_path / "stops.csv")).collect()
    assert (a.ElementDesc, a.Duration, a.ShiftId) == (None, 60.0, 1)
    assert a.StartTime == dt.datetime(2025, 1, 2, 3, 4, 5, 500000)
    assert (b.Duration, b.EndTime, b.EffectiveDay, b.ShiftId) == (None, None, dt.date(2025, 1, 2), None)


def test_stops_csv_with_quotes_and_fractions(spark, tmp_path):
    line = ",MAIN LINE,L1,Falha/Parada,{},{},2025-01-02 03:04:05,2025-01-02 03:05:05,2025-01-02,S1,1.0\n"
    text = ",".join(S.STOP_COLUMNS) + "\n"
    text += line.format('"Porta ""A"", aberta"', "12.7") + line.format('"a\nb"', "1")
    (tmp_path / "stops.csv").write_text(text)
    a, b = tables.read_stops_csv(spark, str(tmp_path / "stops.csv"), multi_line=True).collect()
    assert (a.AlarmDesc, a.Duration, a.StationDesc) == ('Porta "A", aberta', 12.7, "S1")
    assert b.AlarmDesc == "a\nb"
    (tmp_path / "bad.csv").write_text(",".join(S.STOP_COLUMNS) + "\n" + line.format("A", "doze"))
    with pytest.raises(Exception, match="not a number: doze"):
        tables.read_stops_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_cache_of_nothing_and_of_half_a_table(spark):
    path = new_shared_path(spark, "test-cache")
    calls = []

    def extract():
        calls.append(1)
        return stops(spark, {}).filter("StopId > 0")

    assert cache.cached(spark, path, extract).columns == cache.cached(spark, path, extract).columns
    assert cache.cached(spark, path, extract).count() == 0 and len(calls) == 1
    half = new_shared_path(spark, "test-cache")
    stops(spark, {}, {}).write.parquet(f"{half}/_versions/v-begun")
    assert cache.cached(spark, half, lambda: stops(spark, {})).count() == 1
    assert cache.read_cached(spark, half).count() == 1


def test_cache_refuses_folders_of_others(spark):
    path = new_shared_path(spark, "test-cache")
    stops(spark, {}, {}).write.parquet(path)
    with pytest.raises(cache.ForeignFolder):
        cache.cached(spark, path, lambda: stops(spark, {}))
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(FileNotFoundError):
        cache.read_cached(spark, path)


def test_cache_serves_and_renews_tables_stored_without_versions(spark):
    path = new_shared_path(spark, "test-cache")
    tables.write_stops(stops(spark, {}, {}), path)
    assert cache.cached(spark, path, lambda: stops(spark, {})).count() == 2
    assert cache.cached(spark, path, lambda: stops(spark, {}), dt.timedelta(1)).count() == 1
    assert cache.read_cached(spark, path).count() == 1


def test_refresh_keeps_the_version_before_and_removes_older_and_abandoned_ones(spark):
    path = new_shared_path(spark, "test-cache")
    rows = [{}]
    start = dt.datetime(2030, 1, 1, tzinfo=dt.UTC)  # what was begun before today is a day old by then

    def extract():
        return stops(spark, *rows)

    first = cache.cached(spark, path, extract)
    stops(spark, {}).write.parquet(f"{path}/_versions/v-abandoned")
    for _ in range(2):
        rows.append({})
        cache.refresh(spark, path, extract, lambda: start)
        if len(rows) == 2:
            assert first.count() == 1  # a reader that has begun goes on
    assert cache.cached(spark, path, extract).count() == 3
    found = Files(spark, path)
    assert len(list(found.entries(f"{path}/_manifests"))) == len(list(found.entries(f"{path}/_versions"))) == 2


def test_refresh_that_finds_its_number_taken_publishes_nothing(spark):
    path = new_shared_path(spark, "test-cache")
    cache.refresh(spark, path, lambda: stops(spark, {}))

    def meanwhile():
        cache.refresh(spark, path, lambda: stops(spark, {}, {}))
        return stops(spark, {}, {}, {})

    with pytest.raises(FileExistsError):
        cache.refresh(spark, path, meanwhile)
    assert cache.read_cached(spark, path).count() == 2


def records_of(text):
    """Records of a text with doubled quotes, by one pass over its signs."""
    out, own, quoted = [], "", False
    for sign in text:
        quoted ^= sign == '"'
        if sign == "\n" and not quoted:
            out.append(own)
            own = ""
        else:
            own += sign
    return [r for r in [*out, own] if r]


@pytest.mark.parametrize("size", [3, 64, 1000, 1 << 20])
def test_records_over_range_edges(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for k in range(3):
        text = "a,b\n"
        for i in range(60):
            text += f"{k}-{i}," + rng.choice(["plain", '"line\nbreak"', '"x ""q"",\n\n\ny"', '"' + "long\n" * 30 + '"', '""', "é"]) + "\n"
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8")
        want += records_of(text)[1:]
    keep = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = multiline.read_records(spark, str(tmp_path))
        assert sorted(r.record for r in got.collect()) == sorted(want)
        lines = spark.read.text(str(tmp_path / "0.csv"), lineSep="\n")
        assert size > 64 or lines.rdd.getNumPartitions() > 8
    finally:
        for name, value in keep.items():
            spark.conf.set(name, value)


def test_records_of_empty_files_marks_and_other_line_ends(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "only.csv").write_bytes(b"a,b\n")
    (tmp_path / "mark.csv").write_bytes(b'\xef\xbb\xbfa,b\r\n1,"x\r\ny"\r\n\r\n2,z')
    got = sorted(r.record for r in multiline.read_records(spark, str(tmp_path)).collect())
    assert got == ['1,"x\r\ny"', "2,z"]
    assert sorted(r.record for r in multiline.read_records(spark, str(tmp_path), header=False).collect())[2:] == ["a,b", "a,b"]


def test_one_file_equals_a_plain_writer(spark, tmp_path):
    rows = [(i, t, None if i % 3 else dt.date(2024, 1, 1 + i)) for i, t in enumerate(
        ['a;b', 'say "x"', "line\nbreak", "\r", " blank ", "", None, "é", "'", "tab\t", "a,b"])]
    df = spark.createDataFrame(rows, "`n;o` long, text string, day date").repartition(4).sortWithinPartitions("n;o").orderBy("n;o")
    path = str(tmp_path / "out.csv")
    tables.export_csv_file(df, path)
    plain = io.StringIO(newline="")
    writer = csv.writer(plain, delimiter=";", lineterminator="\n")
    writer.writerows([df.columns, *[["" if x is None else x for x in r] for r in rows]])
    assert (tmp_path / "out.csv").read_bytes() == plain.getvalue().encode("utf-8-sig")
    assert {p.name for p in tmp_path.iterdir()} <= {"out.csv", ".out.csv.crc"}
    with pytest.raises(FileExistsError):
        tables.export_csv_file(df, path)
    one = str(tmp_path / "one.csv")
    tables.export_csv_file(spark.createDataFrame([("",), (None,), ("x",)], "c string").coalesce(1), one)
    assert (tmp_path / "one.csv").read_bytes().decode("utf-8-sig") == 'c\n""\n""\nx\n'
    tables.export_csv_file(df.filter("false"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_bytes().decode("utf-8-sig") == '"n;o";text;day\n'


def test_cache_extracts_once_and_prunes_months(spark):
    path = new_shared_path(spark, "test-cache")
    calls = []

    def extract():
        calls.append(1)
        return stops(spark, {}, {"StartTime": "2025-04-01T00:00:00"}, {"StartTime": None})

    assert cache.cached(spark, path, extract).count() == 3
    assert cache.cached(spark, path, extract).count() == 3
    assert len(calls) == 1
    part = cache.read_cached(spark, path, dt.date(2025, 3, 3), dt.date(2025, 3, 31))
    assert [r.StopId for r in part.collect()] == [0]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(EffectiveMonth" in plan


def test_production_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "EffectiveDate;LineDesc;ShiftId;EffectiveProd;TargProd\n2025-01-02;L1;1;5;10\nsem data;L1;2;6.5;\n"
    )
    a, b = tables.read_production_csv(spark, str(tmp_path / "p.csv")).collect()
    assert a.EffectiveDate == dt.datetime(2025, 1, 2)
    assert (b.EffectiveDate, b.EffectiveProd, b.TargProd) == (None, 6.5, None)
    (tmp_path / "q.csv").write_text(
        "EffectiveDate;LineDesc;ShiftId;EffectiveProd;TargProd\n03/02/2025;L1;1;10,5;\n31/02/2025;L1;1;1;x\n"
    )
    a, b = tables.read_production_csv(spark, str(tmp_path / "q.csv"), "dd/MM/yyyy", ",").drop("TargProd").collect()
    assert (a.EffectiveDate, a.EffectiveProd, b.EffectiveDate) == (dt.datetime(2025, 2, 3), 10.5, None)
    with pytest.raises(Exception, match="not a number: x"):
        tables.read_production_csv(spark, str(tmp_path / "q.csv"), "dd/MM/yyyy", ",").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_production_csv(spark, str(tmp_path / "none.csv"))


def test_calendar_text(spark):
    lines = ['  { "2025-01-01", "Improdutivo" }, { "2025-01-02", "Produtivo" },', "  -- JANEIRO", "{}"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in tables.require_rows(tables.calendar_from_text(df)).collect()] == [
        (dt.date(2025, 1, 1), "Improdutivo"),
        (dt.date(2025, 1, 2), "Produtivo"),
    ]
    with pytest.raises(ValueError):
        tables.require_rows(tables.calendar_from_text(df.filter("value = '{}'")))


def test_export_starts_with_a_byte_order_mark(spark):
    path = new_shared_path(spark, "test-export")
    tables.export_csv(spark.createDataFrame([("ç", 1)], "a string, b int").coalesce(1), path)
    (part,) = [p for p in local(path).glob("part-*.csv") if p.stat().st_size]
    assert part.read_bytes() == "\ufeffa;b\nç;1\n".encode()


def test_feature_table_formats(spark):
    row = ("E1", dt.date(2025, 1, 2), *[0.1] * 8)
    df = spark.createDataFrame([row], S.RUL_FEATURES)
    for kind in ("csv", "parquet"):
        path = new_shared_path(spark, "test-features")
        tables.write_features(df, path, format=kind)
        assert [tuple(r) for r in tables.read_features(spark, path, kind).collect()] == [row]


def stops_row(spark):
    return stops(spark, {}).withColumn("Duration", F.lit(60).cast("int"))


def test_jdbc_options_are_the_callers(spark):
    given = {"url": "jdbc:x", "user": "u"}
    options = tables.jdbc_stops_options(given, "stops", "2025-01-01", "2025-12-31", 4)
    assert options["preferTimestampNTZ"] == "true"
    assert tables.as_stops(stops_row(spark)).dtypes == spark.createDataFrame([], S.STOPS).dtypes
    assert options["url"] == "jdbc:x" and options["dbtable"] == "stops"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("2025-01-01", "2025-12-31", "4")
