"""Evidence around trigger runs: the pad's points before and after, its baseline, the kind of change.

Everything is a child table keyed by ``trigger_id``; a run has no upper length, so
none of it is nested into the trigger's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions.ordered import range_join
from boardlens.functions.stats import slope, tail_rise
from boardlens.operators.runs import SERIES
from boardlens.schema import (
    BASELINE_MIN, METRICS, PAD_WINDOW, PRECURSOR_BOARDS, RISE_THRESHOLD, SIGMA_BAND, SIGNATURE_MIN_BAND, SLOPE_THRESHOLD,
)


def run_window(triggers: DataFrame, points: DataFrame, reach: int = PAD_WINDOW) -> DataFrame:
    """Points of the pad within ``reach`` records of the run, rechecks included.

    ``seq`` counts from the run's first point; ``is_baseline`` marks production
    passes before the run.
    """
    spans = triggers.select(
        "trigger_id", *SERIES, "start_pos", "end_pos",
        F.greatest(F.col("start_pos") - reach, F.lit(0)).alias("low"), (F.col("end_pos") + reach).alias("high"))
    near = range_join(
        spans, points.select(*SERIES, "pos", "row_id", "barcode", "fdate", "ng", "is_recheck", *METRICS),
        SERIES, "low", "high", "pos", 2 * reach)
    made = ~F.col("is_recheck")
    return near.withColumns({
        "seq": F.col("pos") - F.col("start_pos"),
        "in_run": F.col("pos").between(F.col("start_pos"), F.col("end_pos")),
        "is_trigger": F.col("pos").between(F.col("start_pos"), F.col("end_pos")) & made,
        "is_baseline": (F.col("pos") < F.col("start_pos")) & ~F.col("ng") & made,
    }).drop("low", "high", "start_pos", "end_pos")


def metric_values(window: DataFrame) -> DataFrame:
    """One row per point of a window and metric."""
    return window.select("trigger_id", "pos", "is_trigger", "is_baseline", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")
    ).select("trigger_id", "pos", "is_trigger", "is_baseline", "m.metric", "m.value")


def metric_stats(window: DataFrame, at_least: int = BASELINE_MIN) -> DataFrame:
    """Baseline mean and spread (NULL below ``at_least`` points) and the run's mean, per metric."""
    usual = F.when(F.col("is_baseline"), F.col("value"))
    stats = metric_values(window).groupBy("trigger_id", "metric").agg(
        F.count(usual).alias("baseline_points"), F.avg(usual).alias("mean"), F.stddev_pop(usual).alias("sigma"),
        F.avg(F.when(F.col("is_trigger"), F.col("value"))).alias("trigger_mean"))
    enough = F.col("baseline_points") >= at_least
    return stats.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "sigma")})


def baseline_stats(stats: DataFrame, main: DataFrame) -> DataFrame:
    """Baseline band of the main metric, its lower end not below 0."""
    band = SIGMA_BAND * F.col("sigma")
    low = F.col("mean") - band
    return stats.join(main, ["trigger_id", "metric"]).select(
        "trigger_id", "metric", "baseline_points", "mean", "sigma",
        (F.col("mean") + band).alias("upper"), F.when(low < 0, 0.0).otherwise(low).alias("lower"))


def metric_signature(stats: DataFrame) -> DataFrame:
    """Per metric: does the run's mean leave the baseline upwards or downwards?"""
    delta = F.col("trigger_mean") - F.col("mean")
    band = F.when(F.col("sigma").isNotNull(), F.greatest(SIGMA_BAND * F.col("sigma"), F.lit(SIGNATURE_MIN_BAND)))
    return stats.select("trigger_id", "metric", delta.alias("delta"), band.alias("band")).withColumn(
        "verdict",
        F.when(F.col("delta") > F.col("band"), "up").when(F.col("delta") < -F.col("band"), "down")
        .when(F.col("delta").isNotNull(), "flat"))


def change_type(window: DataFrame, stats: DataFrame, main: DataFrame, look_back: int = PRECURSOR_BOARDS) -> DataFrame:
    """Gradual if the last baseline values climb to the run, else a step."""
    back = Window.partitionBy("trigger_id").orderBy(F.col("pos").desc())
    # A window holds at most PAD_WINDOW points before its run, so both stay small.
    last = (
        metric_values(window).where("is_baseline AND value IS NOT NULL").join(main, ["trigger_id", "metric"])
        .withColumn("back", F.row_number().over(back)).where(F.col("back") <= look_back)
    )
    trend = last.groupBy("trigger_id").agg(
        slope("value", -F.col("back")).alias("slope"),
        tail_rise(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v.value)).alias("tail_rise"))
    known = F.col("mean").isNotNull()
    gradual = (F.col("slope") >= SLOPE_THRESHOLD) & (F.col("tail_rise") >= RISE_THRESHOLD)
    return stats.join(main, ["trigger_id", "metric"]).join(trend, "trigger_id", "left").select(
        "trigger_id",
        F.when(~known, "unknown").when(gradual, "gradual").otherwise("step").alias("change_type"),
        *[F.when(known, F.col(c)).alias(c) for c in ("slope", "tail_rise", "trigger_mean")],
        F.when(F.col("mean") != 0, F.col("trigger_mean") / F.col("mean")).alias("jump_ratio"),
    )
