from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import stops

from paragem import jobs
from paragem.models.store import load_model
from paragem.operators.grouping import group_stops
from paragem.session import new_shared_path, shared_dir, stage, staging
from paragem.sources import tables


def folder(spark):
    path = Path(shared_dir(spark).removeprefix("file:"))
    return {p.name for p in path.iterdir()} if path.exists() else set()


def test_jobs_write_their_results(spark, tmp_path):
    rows = [
        {"ElementDesc": f"E{i % 3}", "Duration": 30 + 700 * (i % 2), "StartTime": f"2025-03-{1 + i // 4:02d}T{i % 4:02d}:00:00"}
        for i in range(80)
    ]
    table = f"{tmp_path}/stops"
    tables.write_stops(stops(spark, *rows), table)
    Path(tmp_path / "days.txt").write_text('{"2025-01-01" ,"Produtivo"}, { "2025-01-02", "Improdutivo" }')
    jobs.calendar(spark, f"{tmp_path}/days.txt", f"{tmp_path}/calendar")
    assert tables.read_calendar_csv(spark, f"{tmp_path}/calendar").count() == 2
    jobs.features(spark, table, f"{tmp_path}/features")
    assert tables.read_features(spark, f"{tmp_path}/features").count() > 0
    jobs.train_risk(spark, table, f"{tmp_path}/risk", trees=3, depth=4)
    assert load_model(f"{tmp_path}/risk/model")
    jobs.train_life(spark, f"{tmp_path}/features", f"{tmp_path}/life", trees=3, depth=3)
    assert load_model(f"{tmp_path}/life/model")
    with pytest.raises(SystemExit):
        jobs.main(["unknown"])


def test_a_scope_leaves_nothing_behind(spark, tmp_path):
    kept = stage(spark.range(3), "kept")
    before = folder(spark)
    with staging(spark):
        group_stops(stops(spark, {}, {})).write.parquet(f"{tmp_path}/groups")
        assert folder(spark) - before
    assert folder(spark) == before and kept.count() == 3
    assert spark.read.parquet(f"{tmp_path}/groups").agg(F.count("*")).first()[0] == 2
    assert new_shared_path(spark, "x")
