"""Runs of failures on one pad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.functions.ordered import previous
from boardlens.functions.scalars import defect_direction, defect_metric, stable_id, stripped
from boardlens.operators.inspections import SERIES_ORDER
from boardlens.schema import PERIODIC_MAX_CV, PERIODIC_MIN_RUNS, RUN_MIN_BOARDS

SERIES = ["cmodel", "compname"]


def failing_points(points: DataFrame) -> DataFrame:
    """Failing production points of ``pad_points``; equal ``passes`` form one run."""
    return points.where("ng AND NOT is_recheck AND compname <> ''")


def ng_runs(failing: DataFrame) -> DataFrame:
    """One row per maximal run of failing production points of a pad."""
    at = F.struct(*SERIES_ORDER, "pidx", "pos", "machinename")
    runs = failing.groupBy(*SERIES, "passes").agg(
        F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("run_length"))
    return runs.select(
        *SERIES, "passes", F.col("a.ts").alias("ts"), F.col("a.machinename").alias("machine"),
        F.col("a.barcode").alias("start_barcode"), F.col("a.fdate").alias("start_time"),
        F.col("z.barcode").alias("end_barcode"), F.col("z.fdate").alias("end_time"),
        F.col("a.pidx").alias("start_pidx"), F.col("a.pos").alias("start_pos"), F.col("z.pos").alias("end_pos"), "run_length",
    )


def trigger_runs(runs: DataFrame, at_least: int = RUN_MIN_BOARDS) -> DataFrame:
    """Runs long enough to be looked into, with an id of their own."""
    return runs.where(F.col("run_length") >= at_least).withColumn(
        "trigger_id", stable_id("TRG-", *SERIES, "start_barcode", "start_time"))


def run_main_defect(triggers: DataFrame, failing: DataFrame) -> DataFrame:
    """Most frequent defect name of every run, the one seen first among equals."""
    names = (
        failing.withColumn("defect", stripped("comp_errname"))
        .groupBy(*SERIES, "passes", "defect")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pidx").alias("seen"))
    )
    return (
        triggers.select("trigger_id", *SERIES, "passes").join(names, [*SERIES, "passes"])
        .groupBy("trigger_id").agg(F.min_by("defect", F.struct(-F.col("n"), "seen")).alias("main_defect"))
        .withColumns({"metric": defect_metric("main_defect"), "direction": defect_direction("main_defect")})
    )


def periodicity(runs: DataFrame) -> DataFrame:
    """Per pad: do its runs start at regular distances, counted in production boards?"""
    gaps = previous(runs, SERIES, ["ts", "start_pidx"], ["start_pidx"], "before").withColumn(
        "gap", F.col("start_pidx") - F.col("before.start_pidx"))
    stats = gaps.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("run_count"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"))
    regular = (F.col("run_count") >= PERIODIC_MIN_RUNS) & (F.col("mean_gap") > 0) & (
        F.col("sd") / F.col("mean_gap") < PERIODIC_MAX_CV)
    return stats.select(
        *SERIES, "run_count", regular.alias("periodic"),
        F.when(regular, F.round("mean_gap", 1)).alias("mean_gap_boards"))
