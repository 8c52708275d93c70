"""Column names, types and thresholds shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = ("comp_avdp", "comp_aadp", "comp_ahdp")
BOARD_SERIES = "__board__"

# Thresholds that decide results.
EVENT_GAP_MINUTES = 30
PRECURSOR_BOARDS = 20
PRECURSOR_MIN_BOARDS = 3
SLOPE_THRESHOLD = 0.5
RISE_THRESHOLD = 3
BOARD_WIDE_SHARE = 0.5
BOARD_WIDE_MIN_ROWS = 10
PASS_SHIFT_RATIO = 2.0

STOP_GAP_MINUTES = 30
MIN_FIRST_BOARDS = 30
EFFECT_MIN = 1.0
EFFECT_NOISE_RATIO = 0.5

RUN_MIN_BOARDS = 3
PAD_WINDOW = 300
ROW_WINDOW = 500
BASELINE_MIN = 5
SIGMA_BAND = 3.0
SIGNATURE_MIN_BAND = 10.0
PERIODIC_MIN_RUNS = 3
PERIODIC_MAX_CV = 0.25
SETPOINT_MAX_SHARE = 0.34
LOCAL_MIN_PADS = 3
LOCAL_MAX_SPAN = 0.35
FALSE_ALARM_METRIC = 20.0

EWMA_LAMBDA = 0.2
EWMA_LIMIT = 4.0
EWMA_WINDOW = 200
EWMA_MIN_CLEAN = 30
SIGMA_FLOOR = 0.01
L2_STREAK = 3
L2_METRICS = 2
L3_RISE = 3
RECOVERY_BOARDS = 3
HIT_HORIZON = 50
STALE_BOARDS = 100
PAGE_LEVEL = 3
SERIES_CONTEXT = 20

RECENT_BOARDS = 3000

# Defect names the narrow scan keeps.
DEFECT_SUBSET = (
    "Under Volume", "Under Area", "Under Height", "Over Volume", "Over Height", "AREAOVER",
)

# Parameters carried as plan / actual / difference columns.
PARAM_TRIPLES = (
    "printspeed", "frontsqgpress", "rearsqgpress", "printgap", "snapoffdistance",
    "snapoffspeed", "snapoffdelay", "sqgupspeed", "sqgdownspeed", "cleaningfrequency",
    "cleaningspeed", "markdeviation",
)
PARAM_SINGLES = (
    "cycletime", "printmode_plan", "printmode", "printdirection", "pcbsize",
    "cleaningafterlastboard", "temperature", "humidity",
)
AFFECTED_TRIPLES = (
    "printspeed", "frontsqgpress", "rearsqgpress", "snapoffspeed", "cleaningfrequency",
)

# Columns of an export that are text; fdate is a timestamp, the rest double.
TEXT_COLUMNS = (
    "machinename", "cmodel", "barcode", "printmode", "printmode_plan", "printdirection",
    "pcbsize", "compname", "comp_errname",
)

LIMITS_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("work_order", "product_name", "board_sn")]
    + [T.StructField("inspect_time", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("machine", "side", "component", "pad")]
    + [
        T.StructField(n, T.DecimalType(12, 4))
        for n in (
            "x", "y", "volume", "volume_upper", "volume_lower", "area", "area_upper",
            "area_lower", "height", "height_upper", "height_lower",
        )
    ]
)


def parameter_names(columns: list[str]) -> list[str]:
    """Printing parameters, found by their ``abs_<name>`` column."""
    return sorted(c[len("abs_"):] for c in columns if c.startswith("abs_"))


def setpoint_columns(columns: list[str]) -> list[str]:
    return sorted(c for c in columns if c.endswith("_plan") or c == "printmode")
