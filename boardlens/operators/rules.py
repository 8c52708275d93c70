"""Rules engine: row defects, patterns and risk, quality cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.functions.ordered import ranked
from boardlens.functions.scalars import deviation_percent, label_defect, limit_defect, text

ABNORMAL_ORDER = ("ts", "board_sn", "component", "pad", "row_id")

# Pattern -> (spatial extent, temporal pattern).
PATTERN_AXES = {
    "POINT_REPEAT": ("spatial.single_pad", "temporal.repeated"),
    "BOARD_TREND": ("spatial.board_wide", "temporal.sporadic"),
    "COMPONENT_MULTI_PAD": ("spatial.component_multi_pad", "temporal.sporadic"),
    "SPORADIC": ("spatial.single_pad", "temporal.sporadic"),
}
# Thresholds of the patterns.
REPEAT_BOARDS = 3
TREND_HIGH = 0.10
TREND_MEDIUM = 0.05


def defects(contract: DataFrame) -> DataFrame:
    """Rows of the contract with a defect: by label, else by limits."""
    have = set(contract.columns)
    has_limits = {"volume", "volume_upper", "volume_lower"} <= have
    direction, metric = label_defect("raw_ng_type") if "raw_ng_type" in have else (F.lit(None).cast("string"),) * 2
    found = F.when(
        direction.isNotNull(), F.struct(direction.alias("defect"), metric.alias("metric"))
    )
    if has_limits:
        found = F.coalesce(found, limit_defect())
    df = contract.withColumn("found", found).where("found IS NOT NULL")

    def of_metric(suffix: str) -> Column:
        out = F.lit(None).cast("double")
        for name in ("volume", "area", "height"):
            column = f"{name}{suffix}"
            if column in have:
                out = F.when(F.col("found.metric") == name, F.col(column).cast("double")).otherwise(out)
        return out

    labelled = direction.isNotNull()
    df = df.withColumns({
        "actual_value": of_metric(""),
        "upper_limit": of_metric("_upper"),
        "lower_limit": of_metric("_lower"),
        "_label_deviation": F.when(labelled, of_metric("_deviation_percent")),
    })
    keep = [c for c in ("total_pads",) if c in have]
    return df.select(
        "row_id", "ts", "work_order", "product_name", "board_sn",
        F.col("inspect_time").cast("string").alias("inspect_time"),
        "machine", "side", "component", "pad", *keep,
        F.col("found.defect").alias("defect_type"),
        F.col("found.metric").alias("main_metric"),
        "actual_value", "upper_limit", "lower_limit",
        F.coalesce(
            "_label_deviation",
            deviation_percent(F.col("actual_value"), F.col("upper_limit"), F.col("lower_limit")),
        ).alias("deviation_percent"),
    )


def numbered(df: DataFrame, order: tuple[str, ...], column: str, prefix: str, digits: int) -> DataFrame:
    """Sequential ids along ``order``, numbered slice by slice."""
    return ranked(df, order, "_no").withColumn(column, F.format_string(f"{prefix}%0{digits}d", "_no")).drop("_no")


def abnormals(contract: DataFrame) -> DataFrame:
    return numbered(defects(contract), ABNORMAL_ORDER, "abnormal_id", "ABN", 12)


def board_ratio(found: DataFrame, pad_totals: DataFrame) -> DataFrame:
    """Abnormals on a board over its pads; 0 for a board without pads."""
    counts = found.groupBy("board_sn").agg(F.count(F.lit(1)).alias("_on_board"))
    return counts.join(pad_totals, "board_sn", "left").select(
        "board_sn",
        F.when(F.col("total_pads") > 0, F.col("_on_board") / F.col("total_pads"))
        .otherwise(0.0)
        .alias("board_abnormal_ratio"),
    )


POINT = ["work_order", "product_name", "component", "pad", "defect_type"]
ON_COMPONENT = ["board_sn", "component", "defect_type"]


def _distinct_count(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """count(distinct) as two partial aggregates, so a hot key never gathers its rows."""
    return df.groupBy(*keys, value).agg(F.lit(1)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def repeat_boards(found: DataFrame) -> DataFrame:
    return _distinct_count(found, POINT, "board_sn", "repeat_count")


def component_pads(found: DataFrame) -> DataFrame:
    return _distinct_count(found, ON_COMPONENT, "pad", "pads_on_component")


def classified(found: DataFrame, pad_totals: DataFrame, board_trend: bool = True) -> DataFrame:
    """Pattern and risk of every abnormal."""
    df = (
        found.drop("total_pads")
        .join(board_ratio(found, pad_totals), "board_sn", "left")
        .join(repeat_boards(found), POINT, "left")
        .join(component_pads(found), ON_COMPONENT, "left")
    )
    repeat = F.col("repeat_count") >= REPEAT_BOARDS
    high = F.lit(board_trend) & (F.col("board_abnormal_ratio") >= TREND_HIGH)
    medium = F.lit(board_trend) & (F.col("board_abnormal_ratio") >= TREND_MEDIUM)
    several = F.col("pads_on_component") >= 2
    pattern = (
        F.when(repeat, "POINT_REPEAT").when(high | medium, "BOARD_TREND")
        .when(several, "COMPONENT_MULTI_PAD").otherwise("SPORADIC")
    )
    risk = (
        F.when(repeat | high, "HIGH").when(medium | several, "MEDIUM").otherwise("LOW")
    )
    axes = F.create_map(*[
        x for name, pair in PATTERN_AXES.items()
        for x in (F.lit(name), F.struct(F.lit(pair[0]).alias("spatial"), F.lit(pair[1]).alias("temporal")))
    ])
    return (
        df.withColumns({
            "abnormal_pattern": pattern,
            "risk_level": risk,
            "affected_pad_count": F.when(repeat | high | medium, F.lit(1)).otherwise(F.col("pads_on_component")).cast("bigint"),
        })
        .withColumns({
            "spatial": axes[F.col("abnormal_pattern")]["spatial"],
            "temporal": axes[F.col("abnormal_pattern")]["temporal"],
            "create_quality_case": F.col("risk_level") != "LOW",
        })
        .drop("pads_on_component")
    )


def _case_keys(results: DataFrame) -> DataFrame:
    pattern = F.col("abnormal_pattern")
    per_point = pattern == "POINT_REPEAT"
    per_board = pattern == "BOARD_TREND"
    return results.where("create_quality_case").withColumns({
        "g_board": F.when(~per_point, F.col("board_sn")).otherwise(""),
        "g_component": F.when(~per_board, F.col("component")).otherwise(""),
        "g_pad": F.when(~per_board & (pattern != "COMPONENT_MULTI_PAD"), F.col("pad")).otherwise(""),
    })


CASE_KEY = ["work_order", "product_name", "defect_type", "abnormal_pattern", "g_board", "g_component", "g_pad"]


def quality_cases(results: DataFrame) -> DataFrame:
    """Medium and high risk abnormals grouped by a pattern-dependent key.

    The members of a case are a table of their own (``case_members``): a case can
    hold any number of abnormals, so they are never collected into one row.
    """
    at = F.struct("ts", "abnormal_id")
    latest = F.max_by(
        F.struct("board_sn", "machine", "component", "pad", "main_metric", "board_abnormal_ratio", "inspect_time", "risk_level"), at
    )
    grouped = _case_keys(results).groupBy(*CASE_KEY).agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.min_by("inspect_time", at).alias("first_inspect_time"),
        latest.alias("latest"),
        F.count(F.lit(1)).alias("abnormal_count"),
        F.min("component").alias("c_low"), F.max("component").alias("c_high"),
        F.min("pad").alias("p_low"), F.max("pad").alias("p_high"),
    )
    grouped = grouped.withColumns({"ts": F.col("first_at.ts"), "first_abnormal": F.col("first_at.abnormal_id")})
    return numbered(grouped, ("ts", "first_abnormal"), "case_id", "CASE", 12).select(
        "case_id", *CASE_KEY,
        F.col("latest.inspect_time").alias("created_at"),
        F.col("latest.board_sn").alias("board_sn"),
        F.col("latest.machine").alias("machine"),
        F.when(F.col("c_low") == F.col("c_high"), F.col("latest.component")).otherwise("MULTI").alias("component"),
        F.when(F.col("p_low") == F.col("p_high"), F.col("latest.pad")).otherwise("MULTI").alias("pad"),
        F.col("latest.risk_level").alias("risk_level"),
        F.lit("OPEN").alias("status"),
        F.lit("NOT_RECHECKED").alias("recheck_result"),
        F.lit(None).cast("boolean").alias("effective"),
        "first_inspect_time",
        F.col("latest.inspect_time").alias("latest_inspect_time"),
        "abnormal_count", "first_abnormal",
        F.col("last_at.abnormal_id").alias("last_abnormal"),
        F.col("latest").alias("latest_item"),
    )


def case_members(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case, abnormal, board, pad) rows behind every case."""
    return (
        _case_keys(results).select("abnormal_id", "board_sn", "component", "pad", *CASE_KEY)
        .join(cases.select("case_id", *CASE_KEY), CASE_KEY)
        .select("case_id", "abnormal_id", "board_sn", "component", "pad")
    )


def case_evidence(cases: DataFrame) -> DataFrame:
    """One sentence per case; boards and pads are listed by ``case_members``."""
    item = lambda f: F.col(f"latest_item.{f}")
    n = F.col("abnormal_count")
    return cases.select(
        "case_id",
        F.when(
            F.col("abnormal_pattern") == "POINT_REPEAT",
            F.format_string("%s pad %s shows %s on %d boards, not necessarily consecutive; main metric %s",
                            item("component"), item("pad"), "defect_type", n, item("main_metric")),
        )
        .when(
            F.col("abnormal_pattern") == "COMPONENT_MULTI_PAD",
            F.format_string("%s: %d pads of %s show %s at the same time",
                            item("board_sn"), n, item("component"), "defect_type"),
        )
        .when(
            F.col("abnormal_pattern") == "BOARD_TREND",
            F.concat(
                F.format_string("%s shows a board-wide %s trend: %d points, ", item("board_sn"), "defect_type", n),
                F.round(item("board_abnormal_ratio") * 100, 2).cast("string"), F.lit("%"),
            ),
        )
        .otherwise(F.format_string("%s %s pad %s shows %s", item("board_sn"), item("component"), item("pad"), "defect_type"))
        .alias("evidence"),
    )


def filter_items(items: DataFrame, defect: str = "", risk: str = "", keyword: str = "") -> DataFrame:
    """Search over abnormals or cases: defect suffix, risk, text in any identity field."""
    out = items
    if defect:
        out = out.where(F.col("defect_type").endswith(defect))
    if risk:
        out = out.where(F.col("risk_level") == risk)
    if keyword.strip():
        fields = ("work_order", "product_name", "board_sn", "machine", "component", "pad", "case_id", "abnormal_pattern")
        have = set(items.columns)
        haystack = F.lower(F.concat_ws(" ", *[text(f) if f in have else F.lit("") for f in fields]))
        out = out.where(haystack.contains(keyword.strip().lower()))
    return out
