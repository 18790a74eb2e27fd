"""Table schemas and the fixed business values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names and types of the tables' columns ---------------------

STOPS = T.StructType(
    [
        T.StructField("ElementDesc", T.StringType()),
        T.StructField("LineGroupDesc", T.StringType()),
        T.StructField("LineDesc", T.StringType()),
        T.StructField("StatusDesc", T.StringType()),
        T.StructField("AlarmDesc", T.StringType()),
        T.StructField("Duration", T.DoubleType()),
        T.StructField("StartTime", T.TimestampNTZType()),
        T.StructField("EndTime", T.TimestampNTZType()),
        T.StructField("EffectiveDay", T.DateType()),
        T.StructField("StationDesc", T.StringType()),
        T.StructField("ShiftId", T.IntegerType()),
    ]
)

STOP_ID = T.StructField("StopId", T.LongType())

GROUP_COLUMNS = T.StructType(
    [
        T.StructField("EndTimeAnterior", T.TimestampNTZType()),
        T.StructField("IniciouNovoGrupo", T.IntegerType()),
        T.StructField("IDGrupoNumerico", T.LongType()),
        T.StructField("Prev_ID", T.LongType()),
        T.StructField("Prev_EndTime", T.TimestampNTZType()),
        T.StructField("IDGrupoFinal", T.LongType()),
        T.StructField("PrimeiroAlarmDesc", T.StringType()),
        T.StructField("PrimeiroElementDesc", T.StringType()),
    ]
)

PRODUCTION = T.StructType(
    [
        T.StructField("EffectiveDate", T.TimestampNTZType()),
        T.StructField("LineDesc", T.StringType()),
        T.StructField("ShiftId", T.IntegerType()),
        T.StructField("EffectiveProd", T.DoubleType()),
        T.StructField("TargProd", T.DoubleType()),
    ]
)

CALENDAR = T.StructType([T.StructField("Data", T.DateType()), T.StructField("Tipo", T.StringType())])

ROLLING_WINDOWS = (7, 14, 30)

RUL_MODEL_COLUMNS = [
    f"{prefix}_ultimos_{n}d" for n in ROLLING_WINDOWS for prefix in ("paradas", "duracao_total")
] + ["tempo_desde_ultima_parada"]

RUL_FEATURES = T.StructType(
    [T.StructField("ElementDesc", T.StringType()), T.StructField("StartTime", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in RUL_MODEL_COLUMNS]
    + [T.StructField("RUL", T.DoubleType())]
)

STOP_COLUMNS = STOPS.fieldNames()

# --- Fixed values: they decide the results and must stay as they are ---------

FAILURE_STATUS = "Falha/Parada"
MAIN_LINE = "MAIN LINE"
EXTRACTED_LINE_GROUPS = ["MAIN LINE", "SUBASSEMBLY"]
EXTRACTED_SINCE = "2025-01-01"
GATE_ALARM = "TIME OUT APERTURA SAFETY GATE"
GROUP_GAP_MINUTES = 5
BREAKDOWN_SECONDS = 600

ALL_LINES = "Todas"
ALL_ROWS = "Todos"
STOP_TYPE_BREAKDOWN = "Breakdown (>10 min)"
STOP_TYPE_MICRO = "Microparada (<10 min)"
STOP_IN_GO_ONLY = "Com Stop In Go"
STOP_IN_GO_NONE = "Sem Stop In Go"

# Minutes of one shift (1 and 2: 8.3 hours, 3: 5.5 hours) and of any Sunday shift.
SHIFT_MINUTES = {1: 498, 2: 498, 3: 330}
SUNDAY_MINUTES = 240

SHIFT_LABELS = {1: "Turno 3", 2: "Turno 1", 3: "Turno 2"}
MONTH_LABELS = {
    1: "Jan", 2: "Fev", 3: "Mar", 4: "Abr", 5: "Mai", 6: "Jun",
    7: "Jul", 8: "Ago", 9: "Set", 10: "Out", 11: "Nov", 12: "Dez",
}

# Stop-in-go rules: (line contains, station contains, element is one of). An empty
# text or list places no condition. Texts match in any case, elements exactly.
STOP_IN_GO_RULES = [
    ("GLAZING", "ZNE05", ["TTS02", "TTS04", "TTS05"]),
    ("DECKING", "ZNE07", ["TR01", "TR02", "TR03", "TR04", "TR05", "TR06", "TR07", "PLS03"]),
    ("CHASSIS5", "ZNE01", []),
    ("CHASSIS4", "ZNE02", []),
    ("CHASSIS2", "ZNE06", []),
    ("", "", [
        "PLS01", "PLS02", "PLS_02", "PLS03", "PLS04", "PLS05", "PLS06", "PLS07", "PLS08", "PLS09",
        "PLS10", "PLS11", "PLS12", "PLS13",
    ]),
    ("", "ZNE07", []),
    ("", "", [
        "BRS01", "BR_01", "BR_02", "BR_03", "BR_04", "BR_05", "BR_06", "BR_07", "BR_08", "BR_09",
        "BR_10", "BR_11", "BR_12", "HGD01", "HGD02", "HGD_01", "HLC01", "HLC_01", "PRB01", "PRB02",
        "PRB03", "PRB04", "PRB05", "PRB06", "PTZ01", "PTZ02", "PTZ03", "PTZ04", "VT01", "VT_01",
        "VT_02", "VT_03", "VT_04", "VT_06", "XGA01", "XGA02", "XGA03", "XGA04", "XGA05", "XGA06",
        "XGA07", "XGA08",
    ]),
]
