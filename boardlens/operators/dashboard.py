"""Dashboard figures over abnormals and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.functions.stats import r6

CLOSED = ("CLOSED", "IGNORED")
ABNORMAL_KEY = ("board_sn", "component", "pad", "inspect_time", "defect_type")


def recheck_effective_rate(cases: DataFrame) -> DataFrame:
    seen = F.col("recheck_result").isin("OK", "NG")
    good = seen & ((F.col("recheck_result") == "OK") | F.coalesce("effective", F.lit(False)))
    return cases.agg(
        F.when(F.count_if(seen) > 0, r6(F.count_if(good) / F.count_if(seen))).alias("recheck_effective_rate")
    )


def dashboard_summary(abnormal: DataFrame, cases: DataFrame) -> DataFrame:
    """One row; both sides are one-row aggregates before they meet."""
    rows = abnormal.agg(
        F.count(F.lit(1)).alias("abnormal_count"),
        F.count_if(F.col("defect_type").endswith("OVER")).alias("more_solder_count"),
        F.count_if(F.col("defect_type").endswith("UNDER")).alias("less_solder_count"),
        *[F.count_if(F.col("risk_level") == r).alias(f"{r.lower()}_risk_count") for r in ("HIGH", "MEDIUM", "LOW")],
    )
    done = cases.agg(
        F.count_if(~F.col("status").isin(*CLOSED)).alias("open_case_count"),
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(F.col("status") == "RECURRED").alias("recurrence_count"),
    )
    one = F.lit(1)
    return (
        rows.withColumn("_j", one).join(done.withColumn("_j", one), "_j")
        .join(recheck_effective_rate(cases).withColumn("_j", one), "_j").drop("_j")
    )


def top_by_count(df: DataFrame, keys: list[str], k: int, name: str = "defect_count", main_defect: bool = False) -> DataFrame:
    """The k most frequent keys, ties by key; optionally with their commonest defect."""
    if not main_defect:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    else:
        counts = (
            df.groupBy(*keys, "defect_type").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*keys)
            .agg(
                F.sum("_n").alias(name),
                F.min_by("defect_type", F.struct(-F.col("_n"), "defect_type")).alias("main_defect_type"),
            )
        )
    return counts.orderBy(F.desc(name), *keys).limit(k)


def top_components(abnormal: DataFrame, k: int = 10) -> DataFrame:
    return top_by_count(abnormal, ["component"], k, main_defect=True)


def top_pads(abnormal: DataFrame, k: int = 10) -> DataFrame:
    return top_by_count(abnormal, ["component", "pad"], k, main_defect=True)


def top_products(abnormal: DataFrame, k: int = 10) -> DataFrame:
    return top_by_count(abnormal, ["product_name"], k, main_defect=True)


def top_patterns(abnormal: DataFrame, k: int = 10) -> DataFrame:
    return top_by_count(abnormal, ["abnormal_pattern"], k)


def top_case_locations(cases: DataFrame, k: int = 10) -> DataFrame:
    return top_by_count(cases, ["component", "pad"], k, name="case_count")


def case_metrics(cases: DataFrame) -> DataFrame:
    risk = F.col("risk_level")
    return cases.agg(
        F.count(F.lit(1)).alias("case_total"),
        F.count_if(F.col("status") != "CLOSED").alias("not_closed"),
        F.count_if(risk == "HIGH").alias("high_risk"),
        F.count_if(risk == "MEDIUM").alias("medium_risk"),
        F.count_if(F.col("defect_type") == "OVER").alias("over_cases"),
        F.count_if(F.col("defect_type") == "UNDER").alias("under_cases"),
        F.coalesce(F.sum("abnormal_count"), F.lit(0)).alias("linked_abnormals"),
    )


def new_keys(current: DataFrame, before: DataFrame, keys: tuple[str, ...] = ABNORMAL_KEY) -> DataFrame:
    """Rows whose key was absent from the earlier snapshot; NULL equals NULL."""
    earlier = before.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return current.join(earlier, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def metric_delta(current: DataFrame, before: DataFrame) -> DataFrame:
    """Difference per metric of two one-row summaries; NULL when equal or missing."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns]
        return df.select(F.inline(F.array(*pairs)))

    joined = long(current, "current").join(long(before, "previous"), "metric", "full_outer")
    diff = r6(F.col("current") - F.col("previous"))
    return joined.select("metric", "current", "previous", F.when(diff != 0, diff).alias("delta"))


def trigger_badges(abnormal: DataFrame, triggers: DataFrame) -> DataFrame:
    """The first trigger (by model, pad, start) of the abnormal's component and pad."""
    first = triggers.groupBy("component", "pad").agg(
        F.min_by("trigger_id", F.struct("cmodel", "compname", "start_pos")).alias("trigger_id")
    )
    return abnormal.join(first, ["component", "pad"], "left")


def window_scope(loaded: DataFrame, window_boards: int, source: str) -> DataFrame:
    return loaded.agg(F.count_distinct("barcode").alias("loaded_boards")).select(
        F.lit(window_boards).cast("bigint").alias("window_boards"),
        "loaded_boards",
        F.lit(source).alias("source_table"),
        (F.lit(window_boards > 0) & (F.col("loaded_boards") >= window_boards)).alias("show_scope"),
    )
