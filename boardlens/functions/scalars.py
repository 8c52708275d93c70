"""Row-level expressions: parsing, defect names, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted time layouts, tried in order.
TIME_FORMATS = ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy-M-d H:m:s", "yyyy-M-d H:m")

# Compact machine spellings of a defect.
DEFECT_ALIASES = {
    "areaover": "over area",
    "volumeover": "over volume",
    "heightover": "over height",
    "areaunder": "under area",
    "volumeunder": "under volume",
    "heightunder": "under height",
}

# The metric that belongs to each defect, with its display name.
DEFECT_METRICS = {
    "over volume": ("comp_avdp", "多锡"),
    "under volume": ("comp_avdp", "少锡"),
    "over area": ("comp_aadp", "多锡(面积)"),
    "under area": ("comp_aadp", "少锡(面积)"),
    "over height": ("comp_ahdp", "多锡(高度)"),
    "under height": ("comp_ahdp", "少锡(高度不足)"),
}
METRIC_LABELS = {"comp_avdp": "体积偏差", "comp_aadp": "面积偏差", "comp_ahdp": "高度偏差"}

# Defect labels the rules engine accepts (narrower than the aliases).
RULE_LABELS = {
    "under volume": ("UNDER", "volume"),
    "under area": ("UNDER", "area"),
    "under height": ("UNDER", "height"),
    "over volume": ("OVER", "volume"),
    "over area": ("OVER", "area"),
    "areaover": ("OVER", "area"),
    "over height": ("OVER", "height"),
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """CASE over a short fixed table; NULL where the key is absent."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def text(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def stripped(column: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text(column), r"^\s+|\s+$", "")


def parse_time(column: Column | str) -> Column:
    value = stripped(column)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in TIME_FORMATS])


def safe_float(column: Column | str) -> Column:
    """Number of a text; NULL for anything else, ``inf`` and ``nan`` included."""
    value = stripped(column)
    shape = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(value.rlike(shape), value.try_cast("double"))


def is_ng(column: Column | str = "comp_errname") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    value = F.upper(stripped(column))
    # Most rows pass, and need no pattern for that.
    return F.when(column == "PASS", False).otherwise((value != "") & (value != "PASS"))


def normalize_defect(column: Column | str) -> Column:
    value = F.translate(F.lower(F.trim(text(column))), "_-", "  ")
    key = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.coalesce(_lookup(F.replace(key, F.lit(" "), F.lit("")), DEFECT_ALIASES), key)


def defect_direction(column: Column | str) -> Column:
    key = normalize_defect(column)
    return (
        F.when(key.startswith("over"), "OVER")
        .when(key.startswith("under"), "UNDER")
        .otherwise(F.concat(F.lit("OTHER:"), F.when(key == "", "UNKNOWN").otherwise(key)))
    )


def run_direction(column: Column | str) -> Column:
    """Direction of a failing run: everything that is not OVER reads as UNDER."""
    return F.when(normalize_defect(column).startswith("over"), "OVER").otherwise("UNDER")


def defect_metric(column: Column | str) -> Column:
    key = normalize_defect(column)
    return F.coalesce(_lookup(key, {k: v[0] for k, v in DEFECT_METRICS.items()}), F.lit("comp_avdp"))


def defect_name(column: Column | str) -> Column:
    key = normalize_defect(column)
    return F.coalesce(_lookup(key, {k: v[1] for k, v in DEFECT_METRICS.items()}), text(column))


def metric_label(metric: Column | str) -> Column:
    metric = F.col(metric) if isinstance(metric, str) else metric
    return _lookup(metric, METRIC_LABELS)


def component_of(column: Column | str) -> Column:
    value = F.trim(text(column))
    return F.when(value.rlike(r"^.+_\d+$"), F.regexp_extract(value, r"^(.+)_\d+$", 1)).otherwise(value)


def pad_of(column: Column | str) -> Column:
    value = F.trim(text(column))
    return F.when(value.rlike(r"^.+_\d+$"), F.regexp_extract(value, r"_(\d+)$", 1)).otherwise("1")


def stable_id(prefix: str, *columns: Column | str) -> Column:
    """Prefix and full digest of the parts, each preceded by its length, so that
    neither short digests nor separators inside a value let two keys meet."""
    parts = [text(c) for c in columns]
    identity = F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])
    return F.concat(F.lit(prefix), F.sha1(identity.cast("binary")))


def direction_matches(defect: Column | str, direction: Column | str) -> Column:
    name = F.lower(text(defect))
    direction = F.col(direction) if isinstance(direction, str) else direction
    under = name.contains("insufficient") | name.contains("less") | name.contains("under")
    return (
        F.when(direction == "OVER", name.contains("over"))
        .when(direction == "UNDER", under)
        .otherwise(False)
    )


def label_defect(column: Column | str) -> tuple[Column, Column]:
    """(direction, metric) of a rules-engine label, NULL when not a known label."""
    key = F.translate(F.lower(stripped(column)), "_", " ")
    return (
        _lookup(key, {k: v[0] for k, v in RULE_LABELS.items()}),
        _lookup(key, {k: v[1] for k, v in RULE_LABELS.items()}),
    )


def limit_defect(row_metrics: tuple[str, ...] = ("volume", "area", "height")) -> Column:
    """First metric outside its limits as struct(defect, metric), else NULL."""
    cases = []
    for metric in row_metrics:
        prefix = "" if metric == "volume" else "SUSPECT_"
        value = F.col(metric).cast("double")
        upper = F.col(f"{metric}_upper").cast("double")
        lower = F.col(f"{metric}_lower").cast("double")
        complete = value.isNotNull() & upper.isNotNull() & lower.isNotNull()
        cases.append(
            F.when(
                complete & (value > upper),
                F.struct(F.lit(f"{prefix}OVER").alias("defect"), F.lit(metric).alias("metric")),
            ).when(
                complete & (value < lower),
                F.struct(F.lit(f"{prefix}UNDER").alias("defect"), F.lit(metric).alias("metric")),
            )
        )
    return F.coalesce(*cases)


def deviation_percent(value: Column, upper: Column, lower: Column) -> Column:
    middle = (upper + lower) / 2
    return F.round(F.when(middle != 0, (value - middle) / middle * 100), 2)
