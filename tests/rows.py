"""Hand-made stops and production records."""

import datetime as dt

from pyspark.sql import types as T

from paragem import schemas as S

WITH_ID = T.StructType([S.STOP_ID, *S.STOPS.fields])
DEFAULTS = {
    "LineGroupDesc": "MAIN LINE",
    "LineDesc": "L1",
    "StationDesc": "S1",
    "ElementDesc": "E1",
    "StatusDesc": "Falha/Parada",
    "AlarmDesc": "A",
    "Duration": 60,
    "ShiftId": 1,
}


def at(text):
    return dt.datetime.fromisoformat(text if len(text) > 10 else text + "T00:00:00")


def stops(spark, *rows):
    """Stops from dicts; start and end are texts, the day follows the start."""
    out = []
    for i, row in enumerate(rows):
        r = {**DEFAULTS, "StopId": i, "StartTime": "2025-03-03T10:00:00", **row}
        for c in ("StartTime", "EndTime"):
            if isinstance(r.get(c), str):
                r[c] = at(r[c])
        if "EndTime" not in r and r["StartTime"] is not None:
            r["EndTime"] = r["StartTime"] + dt.timedelta(seconds=r["Duration"] or 0)
        if "EffectiveDay" not in r:
            r["EffectiveDay"] = r["StartTime"].date() if r["StartTime"] else None
        r["Duration"] = None if r["Duration"] is None else float(r["Duration"])
        out.append(tuple(r.get(f) for f in WITH_ID.fieldNames()))
    return spark.createDataFrame(out, WITH_ID)


def production(spark, *rows):
    schema = "EffectiveDate date, LineDesc string, ShiftId int, EffectiveProd bigint, TargProd bigint"
    return spark.createDataFrame([(at(d).date() if d else None, *rest) for d, *rest in rows], schema)
