"""Failure events: boards that fail the same way within a short time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.functions.ordered import previous, range_join, running
from boardlens.functions.scalars import defect_direction, defect_metric, stripped
from boardlens.functions.stats import slope, tail_rise
from boardlens.operators.inspections import first_inspection_rows, inspections
from boardlens.operators.rules import numbered
from boardlens.schema import (
    BOARD_WIDE_MIN_ROWS, BOARD_WIDE_SHARE, EVENT_GAP_MINUTES, METRICS, PASS_SHIFT_RATIO, PRECURSOR_BOARDS,
    PRECURSOR_MIN_BOARDS, RISE_THRESHOLD, SLOPE_THRESHOLD,
)

LINE = ["model", "machine", "direction"]
BOARD_ORDER = ["ts", "barcode", "fdate"]


def board_defects(rows: DataFrame) -> DataFrame:
    """Failing rows counted per (board, time, direction, defect name)."""
    return (
        rows.where("ng")
        .withColumns({"defect": stripped("comp_errname"), "direction": defect_direction("comp_errname")})
        .groupBy("barcode", "fdate", "direction", "defect")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    )


def direction_boards(rows: DataFrame) -> DataFrame:
    """First inspections with failures, one row per direction; those without a time drop out."""
    first = first_inspection_rows(rows)
    sizes = first.groupBy("barcode", "fdate").agg(
        F.min("ts").alias("ts"),
        F.min_by("cmodel", "row_id").alias("model"),
        F.min_by("machinename", "row_id").alias("machine"),
        F.count(F.lit(1)).alias("row_count"),
    )
    bad = board_defects(first).groupBy("barcode", "fdate", "direction").agg(F.sum("n").alias("ng_count"))
    return (
        bad.join(sizes, ["barcode", "fdate"])
        .where("ts IS NOT NULL")
        .withColumn("ng_share", F.col("ng_count") / F.col("row_count"))
    )


def event_boards(boards: DataFrame, gap_minutes: int = EVENT_GAP_MINUTES) -> DataFrame:
    """Boards with the number of their event on the line; a longer gap opens a new one."""
    gap = F.unix_micros("ts") - F.unix_micros("before.ts")
    opens = F.col("before").isNull() | (gap > gap_minutes * 60_000_000)
    cut = previous(boards, LINE, BOARD_ORDER, ["ts"], "before").withColumn("opens", opens).drop("before")
    return running(cut, LINE, BOARD_ORDER, {"event_no": F.when(F.col("opens"), 1).otherwise(0).cast("bigint")}).drop("opens")


def ng_events(members: DataFrame) -> DataFrame:
    """One row per event, numbered by start."""
    at = F.struct(*BOARD_ORDER)
    wide = (F.col("ng_share") >= BOARD_WIDE_SHARE) & (F.col("row_count") >= BOARD_WIDE_MIN_ROWS)
    events = members.groupBy(*LINE, "event_no").agg(
        F.min(at).alias("first"), F.max(at).alias("last"),
        F.count(F.lit(1)).alias("board_count"),
        F.sum("ng_count").alias("ng_record_count"),
        F.max("ng_share").alias("max_ng_share"),
        F.bool_or(wide).alias("board_wide"),
    ).withColumn("ts", F.col("first.ts"))
    return numbered(events, ("ts", *LINE, "event_no"), "event_id", "EVT", 3).select(
        "event_id", *LINE, "event_no", "ts",
        F.col("first.fdate").alias("start_time"),
        F.col("last.fdate").alias("end_time"),
        F.round((F.unix_micros("last.ts") - F.unix_micros("ts")) / 60_000_000).cast("bigint").alias("duration_minutes"),
        "board_count", "ng_record_count", "max_ng_share",
        F.when(F.col("board_wide"), "BOARD_WIDE").otherwise("LOCAL").alias("scope"),
    )


def event_members(members: DataFrame, events: DataFrame) -> DataFrame:
    """(event, board, time) rows behind every event."""
    return members.join(events.select("event_id", *LINE, "event_no"), [*LINE, "event_no"])


def event_main_defect(members: DataFrame, defects: DataFrame) -> DataFrame:
    """Most frequent defect name of every event, the one seen first among equals."""
    return (
        members.join(defects, ["barcode", "fdate", "direction"])
        .groupBy("event_id", "defect")
        .agg(F.sum("n").alias("n"), F.min(F.struct(*BOARD_ORDER, "first_row")).alias("seen"))
        .groupBy("event_id")
        .agg(F.min_by("defect", F.struct(-F.col("n"), "seen")).alias("main_defect"),
             F.count(F.lit(1)).alias("defect_names"))
        .withColumn("metric", defect_metric("main_defect"))
    )


def recheck_outcome(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Last recheck of every event board: failures in the event's direction, or all
    of them if it shows none in that direction.

    Event boards are first inspections, so a board's last recheck is the same for
    all its events and is found by one aggregate.
    """
    again = (
        inspections(rows).where("is_recheck AND ts IS NOT NULL")
        .groupBy("barcode").agg(F.max(F.struct("ts", "fdate", "ng_count")).alias("last"))
        .select("barcode", F.col("last.ts").alias("recheck_ts"), F.col("last.fdate").alias("recheck_time"), "last.ng_count")
        .withColumnRenamed("ng_count", "all_ng")
    )
    per_direction = board_defects(rows).groupBy(
        "barcode", F.col("fdate").alias("recheck_time"), "direction").agg(F.sum("n").alias("same_ng"))
    return (
        members.select("event_id", "barcode", "ts", "direction")
        .join(again, "barcode").where("recheck_ts > ts")
        .join(per_direction, ["barcode", "recheck_time", "direction"], "left")
        .withColumn("recheck_ng_count", F.coalesce("same_ng", "all_ng"))
        .select("event_id", "barcode", "recheck_time", "recheck_ng_count",
                (F.col("recheck_ng_count") == 0).alias("passed"))
    )


def precursor(events: DataFrame, boards: DataFrame, look_back: int = PRECURSOR_BOARDS) -> DataFrame:
    """Trend of the event's metric over the failure-free boards of its model before it.

    ``events`` carry model, metric and start ``ts``; ``boards`` are inspections.
    The boards before an event are found by their number in the series: one count
    of strictly earlier boards per event, then an equi-join on number ranges.
    """
    clean = (
        boards.where("NOT is_recheck AND ng_count = 0 AND ts IS NOT NULL")
        .select("model", *BOARD_ORDER, F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"avg_{m[len('comp_'):]}").alias("value")) for m in METRICS])).alias("m"))
        .select("model", *BOARD_ORDER, "m.metric", "m.value")
        .where("value IS NOT NULL")
    )
    series = ["model", "metric"]
    one = F.lit(1).cast("bigint")
    points = running(clean, series, BOARD_ORDER, {"place": one})
    starts = events.select("event_id", *series, "ts")
    marks = clean.select(F.lit(None).cast("string").alias("event_id"), *series, "ts").unionByName(starts)
    counted = running(
        marks, series, ["ts"], {"high": F.when(F.col("event_id").isNull(), 1).otherwise(0).cast("bigint")}, before_ts=True
    ).where("event_id IS NOT NULL").withColumn("low", F.greatest(F.col("high") - look_back + 1, one))
    found = range_join(
        counted.where("high > 0").drop("ts"), points.select(*series, "place", "value"),
        series, "low", "high", "place", look_back)
    # At most look_back values an event.
    trend = found.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("baseline_boards"),
        F.avg("value").alias("baseline_avg"),
        slope("value", "place").alias("slope"),
        tail_rise(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda v: v.value)).alias("tail_rise"),
    )
    enough = F.col("baseline_boards") >= PRECURSOR_MIN_BOARDS
    out = starts.join(trend, "event_id", "left").withColumn("baseline_boards", F.coalesce("baseline_boards", F.lit(0)))
    return out.select(
        "event_id", "metric", "baseline_boards", enough.alias("available"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("baseline_avg", "slope", "tail_rise")],
        F.when(enough, (F.col("slope") >= SLOPE_THRESHOLD) & (F.col("tail_rise") >= RISE_THRESHOLD)).alias("has_precursor"),
    )


def environment_recorded(rows: DataFrame) -> DataFrame:
    """Whether any row carries a temperature or humidity."""
    return rows.agg(F.coalesce(
        F.bool_or((F.coalesce("temperature", F.lit(0)) > 0) | (F.coalesce("humidity", F.lit(0)) > 0)),
        F.lit(False)).alias("environment_recorded"))


def event_components(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(event, pad) rows: pads that fail in the event's direction on its boards."""
    bad = rows.where("ng").select("barcode", "fdate", defect_direction("comp_errname").alias("direction"), "compname")
    return members.select("event_id", "barcode", "fdate", "direction").join(
        bad, ["barcode", "fdate", "direction"]).select("event_id", "compname").distinct()


def event_defects(members: DataFrame, defects: DataFrame) -> DataFrame:
    """Failing rows of every event per defect name."""
    return members.join(defects, ["barcode", "fdate", "direction"]).groupBy("event_id", "defect").agg(F.sum("n").alias("n"))


def pass_pad_shift(members: DataFrame, boards: DataFrame, mains: DataFrame, ratio: float = PASS_SHIFT_RATIO) -> DataFrame:
    """Whether the passing pads of an event's boards lie ``ratio`` times above those of failure-free boards outside it.

    ``boards`` are inspections. The boards outside are all failure-free ones less the
    event's own rechecks, so a total per metric and a correction per event suffice.
    """
    long = boards.select("barcode", "fdate", "ng_count", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"pass_{m[len('comp_'):]}").alias("value")) for m in METRICS]))).where("value IS NOT NULL")
    of = members.join(mains.select("event_id", "metric"), "event_id").select("event_id", "metric", "barcode", "fdate")
    inside = of.join(long, ["metric", "barcode", "fdate"]).groupBy("event_id", "metric").agg(F.avg("value").alias("pass_mean"))
    clean = long.where("ng_count = 0")
    total = clean.groupBy("metric").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    own = of.select("event_id", "metric", "barcode").distinct().join(clean.select("metric", "barcode", "value"), ["metric", "barcode"]).groupBy(
        "event_id").agg(F.sum("value").alias("own_total"), F.count("value").alias("own_n"))
    left = F.col("n") - F.coalesce("own_n", F.lit(0))
    usual = F.when(left > 0, (F.col("total") - F.coalesce("own_total", F.lit(0.0))) / left)
    return inside.join(total, "metric", "left").join(own, "event_id", "left").select(
        "event_id", "metric", "pass_mean", usual.alias("usual_mean"),
        F.coalesce((usual > 0) & (F.col("pass_mean") >= ratio * usual), F.lit(False)).alias("shifted"))


def event_findings(
    events: DataFrame, shifts: DataFrame, precursors: DataFrame, drifts: DataFrame, rechecks: DataFrame, environment: DataFrame
) -> DataFrame:
    """What can be said of every event, in order: a row per finding.

    ``drifts`` is the parameter check with event_id.
    """
    drifted = drifts.groupBy("event_id").agg(F.bool_or("drifted").alias("drifted"))
    again = rechecks.groupBy("event_id").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    df = events.select("event_id", "scope").join(shifts.select("event_id", "shifted"), "event_id", "left").join(
        precursors.select("event_id", "available", "has_precursor"), "event_id", "left").join(drifted, "event_id", "left").join(
        again, "event_id", "left").withColumn("recorded", environment.scalar())
    codes = F.array_compact(F.array(
        F.lit("time_cluster"), F.when(F.col("scope") == "BOARD_WIDE", "board_wide"), F.when(F.col("shifted"), "pass_pads_shifted"),
        F.when(F.col("has_precursor"), "precursor").when(F.coalesce("available", F.lit(False)), "no_precursor").otherwise("precursor_unknown"),
        F.when(F.col("drifted"), "parameters_drifted").otherwise("parameters_normal"), F.when(F.col("passed") > 0, "recheck_passed"),
        F.when(F.col("failed") > 0, "recheck_failed"), F.when(~F.col("recorded"), "environment_not_recorded")))
    return df.select("event_id", F.posexplode(codes).alias("place", "finding"))
