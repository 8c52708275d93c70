"""What lies around a trigger run: siblings, extent, rows before and after, and the observation that sums it up.

Every table is keyed by ``trigger_id`` and computed for all triggers at once.
``window`` is the pad's own window (``evidence.run_window``), ``full`` the rows of the
whole table around the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens import knowledge as K
from boardlens.functions.ordered import range_join, ranked
from boardlens.functions.scalars import component_of, direction_matches, stripped
from boardlens.operators.parameters import main_value
from boardlens.operators.runs import SERIES
from boardlens.schema import (
    BOARD_WIDE_MIN_ROWS, BOARD_WIDE_SHARE, FALSE_ALARM_METRIC, LOCAL_MAX_SPAN, LOCAL_MIN_PADS, METRICS, PAD_WINDOW,
    PERIODIC_MIN_RUNS, PRECURSOR_BOARDS, ROW_WINDOW, parameter_names,
)
from boardlens.session import settled

TOP = 5


def siblings(window: DataFrame, rows: DataFrame, main: DataFrame) -> DataFrame:
    """Points of the other pads of the component on the window's inspections; of equal rows the last one counts."""
    last = rows.groupBy("cmodel", "barcode", "fdate", "compname").agg(
        F.max_by(F.struct("ng", *METRICS), "row_id").alias("r")).withColumn("component", component_of("compname"))
    last = last.withColumnRenamed("compname", "sibling")
    at = window.select("trigger_id", *SERIES, "seq", "barcode", "fdate", "is_trigger").withColumn("component", component_of("compname"))
    met = at.join(last, ["cmodel", "barcode", "fdate", "component"]).where("sibling <> compname").join(main, "trigger_id")
    return met.select("trigger_id", "sibling", "seq", "is_trigger", "metric", "r.*").select(
        "trigger_id", "sibling", "seq", "is_trigger", "ng", main_value().alias("value"))



def scope(window: DataFrame, sizes: DataFrame, sibling_points: DataFrame) -> DataFrame:
    """board if half of a large enough trigger board fails, component if a sibling fails there too, else single."""
    boards = window.where("is_trigger").join(sizes, ["cmodel", "barcode", "fdate"]).withColumn("share", F.col("b_ng") / F.col("b_rows"))
    wide = (F.col("share") >= BOARD_WIDE_SHARE) & (F.col("b_rows") >= BOARD_WIDE_MIN_ROWS)
    shares = boards.groupBy("trigger_id").agg(F.max("share").alias("max_board_ng_share"), F.bool_or(wide).alias("wide"))
    others = sibling_points.where("is_trigger AND ng").groupBy("trigger_id").agg(F.count_distinct("sibling").alias("ng_siblings"))
    return shares.join(others, "trigger_id", "left").select(
        "trigger_id", "max_board_ng_share", F.coalesce("ng_siblings", F.lit(0)).alias("ng_siblings"),
        F.when(F.col("wide"), "board").when(F.col("ng_siblings") > 0, "component").otherwise("single").alias("scope"))


def heat_map(window: DataFrame, rows: DataFrame) -> DataFrame:
    """Per trigger and pad of its model: mean position, failures on the trigger's inspections, failures ever."""
    pads = rows.groupBy(*SERIES).agg(
        F.avg("comp_px").alias("px"), F.avg("comp_py").alias("py"), F.count_if("ng").alias("history_ng_count"))
    at = window.where("is_trigger").select("trigger_id", "cmodel", "barcode", "fdate").distinct()
    met = at.join(rows.select(*SERIES, "barcode", "fdate", "ng"), ["cmodel", "barcode", "fdate"]).groupBy("trigger_id", "compname").agg(
        F.count_if("ng").alias("trigger_ng_count"), F.count(F.lit(1)).alias("trigger_board_count"))
    every = at.select("trigger_id", "cmodel").distinct().join(pads, "cmodel")
    return every.join(met, ["trigger_id", "compname"], "left").select(
        "trigger_id", "compname", "px", "py", *[
            F.coalesce(c, F.lit(0)).alias(c) for c in ("trigger_ng_count", "trigger_board_count")], "history_ng_count")


def parameter_series(window: DataFrame, rows: DataFrame) -> DataFrame:
    """Actual, planned and difference of every parameter at the window's points, and the parameter's place by distinct values."""
    have = set(rows.columns)

    def of(name: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast("double")

    fields = [F.struct(F.lit(n).alias("parameter"), of(n).alias("actual"), of(f"{n}_plan").alias("plan"), of(f"diff_{n}").alias("diff"))
              for n in parameter_names(rows.columns) if n in have]
    values = rows.select("row_id", F.inline(F.array(*fields))).where("actual IS NOT NULL")
    points = window.select("trigger_id", "seq", "row_id").join(values, "row_id")
    counts = points.groupBy("trigger_id", "parameter", F.round("actual", 4)).agg(F.lit(1)).groupBy("trigger_id", "parameter").agg(
        F.count(F.lit(1)).alias("distinct_values"))
    # As many rows a trigger as there are parameters.
    places = counts.withColumn("place", F.row_number().over(
        Window.partitionBy("trigger_id").orderBy(F.col("distinct_values").desc(), "parameter")))
    return points.join(places, ["trigger_id", "parameter"]).select("trigger_id", "parameter", "place", "seq", "actual", "plan", "diff")


def full_window(window: DataFrame, rows: DataFrame, main: DataFrame, reach: int = ROW_WINDOW) -> DataFrame:
    """Rows of the whole table from ``reach`` before a run's first row to ``reach`` after its last.

    Rows are numbered once along (ts, board, pad, row); a run's interval meets them by position.
    The runs' rows and intervals are written first: with their size known, the numbered
    table is not shuffled to meet them if they are few.
    """
    columns = ["ts", "barcode", "compname", "row_id", "fdate", "cmodel", "comp_errname", "ng", "comp_px", "comp_py"]
    placed = ranked(rows.select(*columns), ["ts", "barcode", "compname", "row_id"], "place")
    run = settled(window.where("in_run").select("trigger_id", "row_id", F.col("compname").alias("pad"), "is_trigger"), "run-rows")
    spans = run.join(placed.select("row_id", "place"), "row_id").groupBy("trigger_id", "pad").agg(
        (F.min("place") - reach).alias("low"), (F.max("place") + reach).alias("high")).withColumn("low", F.greatest("low", F.lit(1)))
    spans = settled(spans.join(main.select("trigger_id", "direction"), "trigger_id"), "row-spans")
    near = range_join(spans, placed, [], "low", "high", "place", 4 * reach)
    flags = run.select("trigger_id", "row_id", F.lit(True).alias("is_trigger_row"))
    boards = window.where("is_trigger").select("trigger_id", "barcode", F.lit(True).alias("on_trigger_board")).distinct()
    return near.join(flags, ["trigger_id", "row_id"], "left").join(boards, ["trigger_id", "barcode"], "left").withColumns({
        "is_trigger_row": F.coalesce("is_trigger_row", F.lit(False)),
        "on_trigger_board": F.coalesce("on_trigger_board", F.lit(False)),
        "is_same_component": component_of("compname") == component_of("pad"), "is_same_pad": F.col("compname") == F.col("pad"),
        "is_same_direction": direction_matches("comp_errname", F.col("direction"))})


def context_summary(full: DataFrame) -> DataFrame:
    """Counts over a trigger's rows before and after."""
    return full.groupBy("trigger_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("ng").alias("ng_rows"),
        *[F.count_if(F.col("ng") & F.col(f"is_same_{c}")).alias(f"same_{c}_ng_rows") for c in ("direction", "component", "pad")],
        F.count_if("on_trigger_board").alias("trigger_board_rows"), F.count_if(F.col("on_trigger_board") & F.col("ng")).alias("trigger_board_ng_rows"),
    ).withColumn("ng_rate", F.col("ng_rows") / F.col("total_rows"))


def context_top(full: DataFrame, limit: int = TOP) -> DataFrame:
    """The most frequent defects, components and pads among a trigger's failing rows."""
    defect = stripped("comp_errname")
    kinds = [F.struct(F.lit("defect").alias("kind"), F.when(defect == "", "NG").otherwise(defect).alias("name")),
             F.struct(F.lit("component").alias("kind"), component_of("compname").alias("name")),
             F.struct(F.lit("pad").alias("kind"), F.col("compname").alias("name"))]
    counts = full.where("ng").select("trigger_id", F.inline(F.array(*kinds))).groupBy("trigger_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("trigger_id", "kind").orderBy(F.col("n").desc(), "name"))
    return counts.withColumn("place", place).where(F.col("place") <= limit)


def local_area(full: DataFrame) -> DataFrame:
    """Whether the failing pads of the trigger boards lie within a small part of the board both ways."""
    seen = F.col("comp_px").isNotNull() & F.col("comp_py").isNotNull()
    bad = seen & F.col("ng")

    def span(axis: str, which: Column) -> Column:
        return F.max(F.when(which, F.col(axis))) - F.min(F.when(which, F.col(axis)))

    found = full.where("on_trigger_board").groupBy("trigger_id").agg(
        F.count_if(seen).alias("placed_rows"), F.count_if(bad).alias("ng_rows"),
        F.count_distinct(F.when(bad & (F.col("compname") != ""), F.col("compname"))).alias("ng_pads"),
        *[span(f"comp_p{a}", w).alias(f"{n}_{a}") for a in "xy" for n, w in (("board", seen), ("bad", bad))])
    enough = (F.col("ng_pads") >= LOCAL_MIN_PADS) & (F.col("placed_rows") >= LOCAL_MIN_PADS) & (F.col("board_x") > 0) & (F.col("board_y") > 0)
    x, y = (F.when(enough, F.col(f"bad_{a}") / F.col(f"board_{a}")) for a in "xy")
    return found.select("trigger_id", "ng_rows", "ng_pads", x.alias("x_share"), y.alias("y_share"),
                        F.coalesce((x <= LOCAL_MAX_SPAN) & (y <= LOCAL_MAX_SPAN), F.lit(False)).alias("local_area"))


def exclusion_checks(window: DataFrame, main: DataFrame, kinds: DataFrame, recovered: DataFrame, least_boards: int = 3) -> DataFrame:
    """Doubts about the data of a run and about its being real, as flags and statuses."""
    run = window.where("in_run").join(main, "trigger_id").groupBy("trigger_id").agg(
        F.bool_or("is_recheck").alias("has_recheck"), F.count_distinct("cmodel").alias("models"), F.count_distinct("barcode").alias("boards"),
        F.max(F.when(F.col("ng"), main_value())).alias("largest"))
    df = run.join(kinds.select("trigger_id", "change_type"), "trigger_id").join(
        recovered.select("trigger_id", "recovery", "recovery_parameters"), "trigger_id")
    data = F.array_compact(F.array(
        F.when(F.col("has_recheck"), "has_recheck"), F.when(F.col("models") > 1, "mixed_models"), F.when(F.col("boards") < least_boards, "few_boards")))
    weak = F.coalesce(F.col("largest") < FALSE_ALARM_METRIC, F.lit(False))
    doubts = F.array_compact(F.array(
        F.when(F.col("change_type") == "unknown", "no_baseline"), F.when(weak, "weak_metric"),
        F.when((F.col("recovery") == "recovered") & (F.size("recovery_parameters") == 0), "self_recovery")))
    return df.select(
        "trigger_id", data.alias("data_flags"), F.when(F.size(data) > 0, "review").otherwise("pass").alias("data_status"),
        doubts.alias("alarm_flags"), F.when(weak, "suspect").when(F.size(doubts) > 0, "review").otherwise("pass").alias("alarm_status"))


def classified(scopes: DataFrame, context: DataFrame, areas: DataFrame, checks: DataFrame, periods: DataFrame) -> DataFrame:
    """A trigger on three axes (extent, timing, validity) and the category they make.

    ``periods`` has trigger_id and periodic.
    """
    df = scopes.join(context, "trigger_id").join(areas.select("trigger_id", "local_area"), "trigger_id", "left").join(
        checks, "trigger_id").join(periods, "trigger_id", "left")
    spatial = (
        F.when(F.col("scope") == "board", K.BOARD).when(F.col("scope") == "component", K.COMPONENT)
        .when(F.coalesce("local_area", F.lit(False)), K.LOCAL).when(F.col("ng_rate") >= BOARD_WIDE_SHARE, K.BOARD).otherwise(K.SINGLE))
    suspect = F.col("alarm_status") == "suspect"
    return df.select(
        "trigger_id", spatial.alias("spatial"), F.when(F.coalesce("periodic", F.lit(False)), "periodic").otherwise("consecutive").alias("temporal"),
        F.when(suspect, "spi_suspect").when(F.col("data_status") != "pass", "data_suspect").otherwise("valid").alias("validity"),
        F.when(suspect, "spi_false_alarm").otherwise(spatial).alias("category"))


def cleaning_frequencies(rows: DataFrame) -> DataFrame:
    """Per model the earliest cleaning frequency that is not zero."""
    set_ = F.col("cleaningfrequency").isNotNull() & (F.col("cleaningfrequency") != 0)
    return rows.where(set_).groupBy("cmodel").agg(F.min_by("cleaningfrequency", F.struct("ts", "row_id")).alias("cleaning_frequency"))


def observation(
    triggers: DataFrame, main: DataFrame, axes: DataFrame, kinds: DataFrame, signatures: DataFrame, drifts: DataFrame,
    recovered: DataFrame, periods: DataFrame, checks: DataFrame, frequencies: DataFrame,
) -> DataFrame:
    """One row per trigger: all that the decision ladder looks at.

    ``signatures`` are verdicts per metric; ``drifts`` the parameter check per trigger.
    """
    verdicts = signatures.groupBy("trigger_id").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("verdict"))).alias(f"sig_{m[len('comp_'):]}") for m in METRICS])
    # A parameter table has tens of names, so the array is short.
    names = drifts.groupBy(F.col("group_id").alias("trigger_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("parameter")))).alias("drifted_parameters"), F.bool_or("cross_model").alias("cross_model"))
    none = F.array().cast("array<string>")
    return (
        triggers.select("trigger_id", *SERIES).join(frequencies, "cmodel", "left")
        .join(main.select("trigger_id", "direction"), "trigger_id").join(axes, "trigger_id").join(kinds.select("trigger_id", F.col("change_type").alias("trend_kind")), "trigger_id")
        .join(verdicts, "trigger_id", "left").join(names, "trigger_id", "left")
        .join(recovered.select("trigger_id", "recovery", "recovery_parameters"), "trigger_id")
        .join(periods.select("trigger_id", "periodic", F.col("mean_gap_boards").alias("periodic_gap")), "trigger_id", "left")
        .join(checks.select("trigger_id", "data_status", "alarm_status"), "trigger_id")
        .withColumns({
            "drifted_parameters": F.coalesce("drifted_parameters", none), "cross_model": F.coalesce("cross_model", F.lit(False)),
            "periodic": F.coalesce("periodic", F.lit(False))})
    )


def trigger_findings(
    triggers: DataFrame, window: DataFrame, kinds: DataFrame, scopes: DataFrame, recovered: DataFrame, drifts: DataFrame, periods: DataFrame,
    reach: int = PAD_WINDOW, tail: int = PRECURSOR_BOARDS,
) -> DataFrame:
    """What can be said of every trigger, in order, with the part of its window (from, to) that shows it.

    ``drifts`` is the parameter check with group_id; ``periods`` has run_count and periodic.
    """
    size = window.groupBy("trigger_id").agg(
        (-F.min("seq")).alias("before"), F.max("seq").alias("last"), F.count_if(F.col("is_baseline")).alias("usual"),
        F.min(F.when(~F.col("is_recheck") & ~F.col("in_run") & (F.col("seq") > 0), F.col("seq"))).alias("first_after"),
        F.max(F.when(~F.col("is_recheck"), F.col("seq"))).alias("last_made"))
    drifted = drifts.groupBy(F.col("group_id").alias("trigger_id")).agg(F.bool_or("drifted").alias("drifted"))
    df = (
        triggers.select("trigger_id", "run_length").join(size, "trigger_id").join(kinds.select("trigger_id", "change_type"), "trigger_id")
        .join(scopes.select("trigger_id", "scope"), "trigger_id").join(recovered.select("trigger_id", "recovery", "recovered_seq", "end_seq"), "trigger_id")
        .join(drifted, "trigger_id", "left").join(periods.select("trigger_id", "run_count", "periodic"), "trigger_id", "left"))
    run = (F.lit(0), F.col("run_length") - 1)
    none = (F.lit(None), F.lit(None))

    def finding(code: Column, span: tuple[Column, Column] = none, when: Column | None = None) -> Column:
        row = F.struct(code.alias("finding"), span[0].cast("bigint").alias("from_seq"), span[1].cast("bigint").alias("to_seq"))
        return row if when is None else F.when(when, row)

    rows = [
        finding(F.lit("consecutive_failures"), run),
        finding(F.concat(F.lit("change_"), "change_type"), (
            F.when(F.col("change_type") == "gradual", -F.least(F.col("usual"), F.lit(tail))).when(F.col("change_type") == "step", run[0]),
            F.when(F.col("change_type") == "gradual", F.lit(-1)).when(F.col("change_type") == "step", run[1]))),
        finding(F.concat(F.lit("extent_"), "scope")),
        finding(F.col("recovery"), (
            F.when(F.col("recovery") == "recovered", F.col("recovered_seq")).when(F.col("recovery") == "not_recovered", F.col("first_after")),
            F.when(F.col("recovery") == "recovered", F.col("recovered_seq")).when(F.col("recovery") == "not_recovered", F.col("last_made")))),
        finding(F.when(F.coalesce("drifted", F.lit(False)), "parameters_drifted").otherwise("parameters_normal")),
        finding(F.when(F.col("periodic"), "periodic").otherwise("not_periodic"), when=(F.col("run_count") >= PERIODIC_MIN_RUNS) | F.col("periodic")),
        finding(F.lit("window_short"), when=(F.col("before") < reach) | (F.col("last") - F.col("end_seq") < reach)),
    ]
    return df.select("trigger_id", F.posexplode(F.array_compact(F.array(*rows))).alias("place", "f")).select("trigger_id", "place", "f.*")
