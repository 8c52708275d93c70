"""Printing parameters around groups of boards: drift against all other production, and setpoint changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.schema import METRICS, SETPOINT_MAX_SHARE, SIGMA_BAND, parameter_names, setpoint_columns

EVERY_MODEL = "*"


def board_parameters(rows: DataFrame) -> DataFrame:
    """Largest deviation per (board, model, parameter), over all inspections."""
    names = parameter_names(rows.columns)
    wide = rows.groupBy("barcode", "cmodel").agg(*[F.max(f"abs_{n}").cast("double").alias(n) for n in names])
    pairs = [F.struct(F.lit(n).alias("parameter"), F.col(n).alias("value")) for n in names]
    return wide.select("barcode", "cmodel", F.inline(F.array(*pairs))) if names else wide.select(
        "barcode", "cmodel", F.lit("").alias("parameter"), F.lit(None).cast("double").alias("value")).where("false")


def _largest(values: DataFrame, most: int) -> DataFrame:
    """Per (model, parameter) the ``most`` boards with the largest values, numbered; ties by barcode."""
    order = Window.partitionBy("cmodel", "parameter").orderBy(F.col("value").desc(), "barcode")
    return values.where("value IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def parameter_check(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group and parameter: its largest deviation against that of all boards outside the group.

    ``groups`` are (group_id, cmodel, barcode) rows. Of a model's boards in falling
    order the first one outside a group of m boards is among the first m + 1, so a
    group meets that many rows of a ranked list, not its model's boards: the work
    grows with the memberships. A group beside which its model has no rows is
    compared with all models (``cross_model``). A parameter has drifted if the group
    exceeds the others, or they have no value.
    """
    members = groups.select("group_id", F.col("cmodel").alias("model"), "barcode").distinct()
    sizes = members.groupBy("group_id", "model").agg(F.count(F.lit(1)).alias("boards"))
    values = board_parameters(rows)
    inside = members.join(values, "barcode")
    seen = inside.groupBy("group_id", "parameter").agg(F.max("value").alias("group_max"))

    # Boards of the model, and how many of them are the group's own.
    totals = rows.groupBy("barcode", "cmodel").agg(F.lit(1).alias("one")).groupBy(F.col("cmodel").alias("model")).agg(F.count(F.lit(1)).alias("all_boards"))
    own = inside.where(F.col("cmodel") == F.col("model")).groupBy("group_id").agg(F.count_distinct("barcode").alias("own_boards"))
    scope = sizes.join(totals, "model", "left").join(own, "group_id", "left").withColumn(
        "cross_model", F.coalesce("all_boards", F.lit(0)) <= F.coalesce("own_boards", F.lit(0)))

    most = int(sizes.agg(F.coalesce(F.max("boards"), F.lit(0))).first()[0]) + 1
    overall = values.groupBy("barcode", "parameter").agg(F.max("value").alias("value")).withColumn("cmodel", F.lit(EVERY_MODEL))
    lists = _largest(values, most).unionByName(_largest(overall, most))
    places = scope.select(
        "group_id", F.when(F.col("cross_model"), EVERY_MODEL).otherwise(F.col("model")).alias("cmodel"),
        F.explode(F.sequence(F.lit(1), (F.col("boards") + 1).cast("int"))).alias("place"))
    outside = places.join(lists, ["cmodel", "place"]).join(
        members.select("group_id", "barcode"), ["group_id", "barcode"], "left_anti")
    usual = outside.groupBy("group_id", "parameter").agg(F.max("value").alias("baseline_max"))
    drifted = F.col("group_max").isNotNull() & (F.col("baseline_max").isNull() | (F.col("group_max") > F.col("baseline_max")))
    return seen.join(scope.select("group_id", "cross_model"), "group_id").join(usual, ["group_id", "parameter"], "left").select(
        "group_id", "parameter", "cross_model", "group_max", "baseline_max", drifted.alias("drifted"))


def setpoint_changes(window: DataFrame, rows: DataFrame, max_share: float = SETPOINT_MAX_SHARE) -> DataFrame:
    """Planned values that change between consecutive production points of a trigger's window.

    ``window`` has trigger_id, seq, row_id and is_recheck. A field that moves on more
    than ``max_share`` of the window's transitions follows each board and is no setpoint.
    """
    fields = setpoint_columns(rows.columns)
    plans = rows.select("row_id", *[F.col(f).cast("string").alias(f) for f in fields])
    made = window.where("NOT is_recheck").select("trigger_id", "seq", "barcode", "fdate", "row_id").join(plans, "row_id")
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    # A window has a bounded number of points, so its transitions stay in one sorted run.
    order = Window.partitionBy("trigger_id").orderBy("seq")
    values = F.array(*pairs)
    steps = made.withColumn("now", values).withColumn("before", F.lag("now").over(order)).where("before IS NOT NULL")
    moved = steps.select(
        "trigger_id", "seq", "barcode", "fdate", F.explode(F.arrays_zip("before", "now")).alias("z")).select(
        "trigger_id", "seq", "barcode", "fdate", F.col("z.now.field").alias("field"),
        F.col("z.before.value").alias("from_value"), F.col("z.now.value").alias("to_value"))
    changed = F.col("from_value").isNotNull() & F.col("to_value").isNotNull() & (F.col("from_value") != F.col("to_value"))
    shares = moved.groupBy("trigger_id", "field").agg(F.count_if(changed).alias("changes"), F.count(F.lit(1)).alias("transitions"))
    kept = shares.where((F.col("changes") > 0) & (F.col("changes") / F.col("transitions") <= max_share)).select("trigger_id", "field")
    return moved.where(changed).join(kept, ["trigger_id", "field"], "left_semi").withColumn(
        "parameter", F.regexp_replace("field", "_plan$", "")).drop("field")


def recovery(window: DataFrame, triggers: DataFrame, stats: DataFrame, main: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether and where the pad came back to normal after the run, and the setpoints changed on the way.

    Normal is a production pass not above the baseline's upper band (any pass if
    there is no baseline). Changes after the run's last point up to the recovery
    meet it by an equi-join and a range check within one window.
    """
    band = stats.join(main, ["trigger_id", "metric"]).select(
        "trigger_id", "metric", F.col("mean").isNotNull().alias("has_baseline"), (F.col("mean") + SIGMA_BAND * F.col("sigma")).alias("upper"))
    ends = triggers.select("trigger_id", (F.col("end_pos") - F.col("start_pos")).alias("end_seq"))
    points = window.where("NOT is_recheck").join(ends, "trigger_id").where("seq > end_seq").join(band, "trigger_id")
    value = main_value()
    good = ~F.col("ng") & F.coalesce(~F.col("has_baseline") | (value <= F.col("upper")), F.lit(False))
    after = points.groupBy("trigger_id").agg(
        F.count(F.lit(1)).alias("boards_after"), F.min(F.when(good, F.col("seq"))).alias("recovered_seq"))
    found = ends.join(after, "trigger_id", "left").withColumns({
        "boards_after": F.coalesce("boards_after", F.lit(0)),
        "recovery": F.when(F.col("boards_after").isNull(), "no_data").when(F.col("recovered_seq").isNull(), "not_recovered").otherwise("recovered")})
    between = changes.join(found.where("recovered_seq IS NOT NULL").select("trigger_id", "end_seq", "recovered_seq"), "trigger_id").where(
        "seq > end_seq AND seq <= recovered_seq")
    named = between.groupBy("trigger_id").agg(F.array_sort(F.collect_set("parameter")).alias("recovery_parameters"))
    none = F.array().cast("array<string>")
    return found.join(named, "trigger_id", "left").withColumn("recovery_parameters", F.coalesce("recovery_parameters", none))


def main_value() -> Column:
    """The value of the row's main metric."""
    out = None
    for m in METRICS:
        out = F.when(F.col("metric") == m, F.col(m)) if out is None else out.when(F.col("metric") == m, F.col(m))
    return out
