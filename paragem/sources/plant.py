"""Plant tables derived from the generic ``events``, ``lineitem`` and ``orders`` Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stop per event; users stand for machines and are spread over four months."""
    timed = load(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "hour(ts) AS start_hour",
        "CAST(floor(value * 10) AS BIGINT) AS Duration",
        "timestampadd(DAY, CAST((user_id % 4 - 1) * 31 AS INT), ts) AS StartTime",
    )
    return timed.selectExpr(
        "event_id AS StopId",
        "CASE WHEN user_id % 12 = 11 THEN 'LOGISTICS' WHEN user_id % 12 IN (9, 10) THEN 'SUBASSEMBLY' "
        "ELSE 'MAIN LINE' END AS LineGroupDesc",
        "get(array('Glazing01', 'DECKING02', 'CHASSIS5', 'CHASSIS4', 'CHASSIS2', 'TRIM01'), "
        "CAST(user_id % 6 AS INT)) AS LineDesc",
        "CASE WHEN user_id = 13 THEN NULL WHEN user_id % 12 = 0 THEN 'ZNE05' WHEN user_id % 12 = 2 THEN 'ZNE01' "
        "ELSE concat('ZNE0', user_id % 4 + 4) END AS StationDesc",
        "get(array('TTS02', 'TR01', 'MTR01', 'PLS03', 'BRS01', 'CNV01', 'ROB01', 'ROB02', 'CNV02', 'MTR02', "
        "'VT01'), CAST(user_id % 12 AS INT)) AS ElementDesc",
        "CASE WHEN event_type = 'error' THEN 'TIME OUT APERTURA SAFETY GATE' ELSE upper(event_type) END AS AlarmDesc",
        "CASE WHEN event_type = 'signup' THEN 'Normal' ELSE 'Falha/Parada' END AS StatusDesc",
        "Duration",
        "StartTime",
        "timestampadd(SECOND, CAST(Duration AS INT), StartTime) AS EndTime",
        "CAST(StartTime AS DATE) AS EffectiveDay",
        "CASE WHEN user_id % 50 = 49 THEN NULL WHEN start_hour < 6 THEN 3 WHEN start_hour < 15 THEN 1 "
        "ELSE 2 END AS ShiftId",
    )


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One production record per line item; line ANDON09 has no target."""
    return load(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_shipdate AS DATE) AS EffectiveDate",
        "get(array('Glazing01', 'DECKING02', 'CHASSIS5', 'CHASSIS4', 'CHASSIS2', 'ANDON09'), "
        "CAST(l_suppkey % 6 AS INT)) AS LineDesc",
        "l_linenumber % 3 + 1 AS ShiftId",
        "CAST(l_quantity AS BIGINT) AS EffectiveProd",
        "CASE WHEN l_suppkey % 6 = 5 THEN 0L ELSE 20 + l_partkey % 40 END AS TargProd",
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of 1995 to 2024; weekends are non-productive."""
    days = spark.range(1).selectExpr(
        "explode(sequence(date'1995-01-01', date'2024-12-31', interval 1 day)) AS Data"
    )
    return days.selectExpr("Data", "CASE WHEN weekday(Data) >= 5 THEN 'Improdutivo' ELSE 'Produtivo' END AS Tipo")


def calendar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines that list the order dates with their day type: two, one or no pair per line."""
    days = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS d")
    pair = "concat('{{ \"', {d}, '\", \"', CASE WHEN weekday({d}) >= 5 THEN 'Improdutivo' ELSE 'Produtivo' END, '\" }}')"
    first, second = pair.format(d="d"), pair.format(d="date_add(d, 1)")
    return days.selectExpr(
        f"CASE o_orderkey % 3 WHEN 0 THEN concat('    ', {first}, ', ', {second}, ',') "
        f"WHEN 1 THEN concat({first}, ',') ELSE '    -- JANEIRO' END AS value"
    )
