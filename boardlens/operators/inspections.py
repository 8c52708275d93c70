"""Inspections: grouping rows by board and time, rechecks, series of points."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.functions.ordered import running
from boardlens.functions.scalars import component_of, defect_direction, is_ng, pad_of, text
from boardlens.functions.stats import r6, stable_mean
from boardlens.schema import BOARD_SERIES, METRICS
from boardlens.session import settled, top_folder

SERIES_ORDER = ("ts", "barcode", "fdate", "row_id")

# Rechecks are broadcast up to so many; beyond, a shuffle join takes over.
BROADCAST_KEYS = 2_000_000
_RECHECKS: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def keyed(spi: DataFrame) -> DataFrame:
    """Identity columns without NULLs, plus the ``ng`` flag."""
    return spi.withColumns({
        "barcode": text("barcode"),
        "fdate": text("fdate"),
        "cmodel": text("cmodel"),
        "compname": text("compname"),
        "machinename": text("machinename"),
        "ng": is_ng("comp_errname"),
    })


def _short(metric: str) -> str:
    return metric[len("comp_"):]


def inspection_totals(rows: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (board, time) with counts and metric means."""
    return rows.groupBy("barcode", "fdate").agg(
        F.min("ts").alias("ts"),
        F.min_by("cmodel", "row_id").alias("model"),
        F.min_by("machinename", "row_id").alias("machine"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("ng").alias("ng_count"),
        *[stable_mean(m).alias(f"avg_{_short(m)}") for m in METRICS],
        *[stable_mean(F.when(~F.col("ng"), F.col(m))).alias(f"pass_{_short(m)}") for m in METRICS],
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def _few(df: DataFrame) -> DataFrame:
    """A settled table of keys, broadcast unless it is long."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _find_rechecks(rows: DataFrame, owner: list[str]) -> DataFrame:
    times = rows.groupBy(*owner, "fdate").agg(F.lit(1).alias("one"))
    several = settled(times.groupBy(*owner).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*owner), "rechecked-owners")
    seen = rows.join(_few(several), owner, "left_semi").groupBy(*owner, "fdate").agg(F.min("ts").alias("ts"))
    first = (
        seen.groupBy(*owner)
        .agg(F.min(F.struct("ts", "fdate")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return (
        seen.join(first, owner)
        .where(F.struct("ts", "fdate") != F.col("first"))
        .select(*owner, "fdate")
    )


def _recheck_keys(rows: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, time) pairs that are not the owner's first inspection.

    Owners with a single inspection, nearly all of them, drop out in one aggregate.
    What is left is written once per table of rows, so that its size is known and
    the rows themselves need not be shuffled to meet it.
    """
    kept = _RECHECKS.setdefault(rows, {})
    at = (tuple(owner), top_folder(rows.sparkSession))
    if at not in kept:
        kept[at] = _few(settled(_find_rechecks(rows, owner), "rechecks"))
    return kept[at]


def inspections(rows: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Inspections with the recheck flag: any later inspection of the same board."""
    rechecks = _recheck_keys(rows, ["barcode"]).withColumn("is_recheck", F.lit(True))
    return (
        inspection_totals(rows, extra)
        .join(rechecks, ["barcode", "fdate"], "left")
        .withColumn("is_recheck", F.coalesce("is_recheck", F.lit(False)))
    )


def first_inspection_rows(rows: DataFrame) -> DataFrame:
    return rows.join(_recheck_keys(rows, ["barcode"]), ["barcode", "fdate"], "left_anti")


def board_report(rows: DataFrame) -> DataFrame:
    """Inspections with their defect maps, failing pads and counts per direction."""
    types = (
        rows.where("ng")
        .withColumn("err", F.trim("comp_errname"))
        .groupBy("barcode", "fdate", "err")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_set("compname").alias("pads"))
        .withColumn("direction", defect_direction("err"))
    )
    maps = types.groupBy("barcode", "fdate").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("err", "n")))).alias("ng_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pads")))).alias("ng_components"),
    )
    ways = (
        types.groupBy("barcode", "fdate", "direction")
        .agg(
            F.sum("n").alias("n"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("pads")))).alias("pads"),
        )
        .groupBy("barcode", "fdate")
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("direction", "n")))).alias(
                "ng_count_by_direction"
            ),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("direction", "pads")))).alias(
                "ng_components_by_direction"
            ),
        )
    )
    return (
        inspections(rows)
        .withColumn("ng_share", F.col("ng_count") / F.col("row_count"))
        .join(maps, ["barcode", "fdate"], "left")
        .join(ways, ["barcode", "fdate"], "left")
    )


def total_pad_counts(contract: DataFrame) -> DataFrame:
    return (
        contract.groupBy("board_sn", "component", "pad").agg(F.lit(1).alias("one"))
        .groupBy("board_sn").agg(F.count(F.lit(1)).alias("total_pads"))
    )


def inspection_sizes(rows: DataFrame) -> DataFrame:
    """Row and failure counts per (model, board, time)."""
    return rows.groupBy("cmodel", "barcode", "fdate").agg(
        F.count(F.lit(1)).alias("b_rows"), F.count_if("ng").alias("b_ng")
    )


def flagged_points(rows: DataFrame) -> DataFrame:
    """Rows with the recheck flag of their (model, board)."""
    rechecks = _recheck_keys(rows, ["cmodel", "barcode"]).withColumn("is_recheck", F.lit(True))
    return rows.join(rechecks, ["cmodel", "barcode", "fdate"], "left").withColumn(
        "is_recheck", F.coalesce("is_recheck", F.lit(False))
    )


def pad_points(rows: DataFrame) -> DataFrame:
    """Points of every (model, pad) series with running positions.

    ``pos`` numbers all points from 0, ``pidx`` the production points (rechecks
    carry the number of the production point before them), and ``passes`` counts
    production passes up to here; failing production points with the same
    ``passes`` form one run.
    """
    made = ~F.col("is_recheck")
    return running(
        flagged_points(rows),
        ["cmodel", "compname"],
        SERIES_ORDER,
        {
            "pos": F.lit(1).cast("bigint"),
            "pidx": F.when(made, 1).otherwise(0).cast("bigint"),
            "passes": F.when(made & ~F.col("ng"), 1).otherwise(0).cast("bigint"),
        },
    ).withColumns({"pos": F.col("pos") - 1, "pidx": F.col("pidx") - 1})


def monitor_points(rows: DataFrame) -> DataFrame:
    """First-inspection points that can be monitored: named pad and valid time."""
    return first_inspection_rows(rows).where((F.col("compname") != "") & F.col("ts").isNotNull())


def board_mean_points(rows: DataFrame) -> DataFrame:
    """The synthetic per-model series of board means."""
    return (
        first_inspection_rows(rows)
        .where(F.col("ts").isNotNull())
        .groupBy("cmodel", "barcode", "fdate")
        .agg(
            F.min("ts").alias("ts"),
            F.min("row_id").alias("row_id"),
            F.bool_or("ng").alias("ng"),
            F.bool_or(F.col("compname") != "").alias("named"),
            *[stable_mean(m).alias(m) for m in METRICS],
        )
        .withColumn("compname", F.lit(BOARD_SERIES))
    )


def production_boards(rows: DataFrame) -> DataFrame:
    """First inspections with a valid time, for the process dimensions."""
    return (
        first_inspection_rows(rows)
        .where(F.col("ts").isNotNull())
        .groupBy("barcode", "fdate")
        .agg(
            F.min("ts").alias("ts"),
            stable_mean("comp_avdp").alias("mean_avdp"),
            F.count_if("ng").alias("ng_count"),
            F.min_by("cleaningfrequency", "row_id").alias("cleaningfrequency"),
            F.min_by("frontsqgpress", "row_id").alias("frontsqgpress"),
            F.min_by("rearsqgpress", "row_id").alias("rearsqgpress"),
            F.trim(text(F.min_by("printdirection", "row_id"))).alias("printdirection"),
        )
    )


def data_overview(rows: DataFrame) -> DataFrame:
    """One row of totals over all inspections."""
    first = ~F.col("is_recheck")
    n_first = F.count_if(first)
    made = F.sum(F.when(first, F.col("row_count")).otherwise(0))
    bad = F.sum(F.when(first, F.col("ng_count")).otherwise(0))
    bad_boards = F.count_if(first & (F.col("ng_count") > 0))
    again = F.count_if("is_recheck")
    good_again = F.count_if(F.col("is_recheck") & (F.col("ng_count") == 0))
    timed = F.when(F.col("ts").isNotNull(), F.struct("ts", "barcode", "fdate"))
    return inspections(rows).agg(
        F.sum("row_count").alias("record_count"),
        made.alias("production_record_count"),
        n_first.alias("board_count"),
        F.count(F.lit(1)).alias("inspection_count"),
        F.count_distinct("model").alias("model_count"),
        F.count_distinct("machine").alias("machine_count"),
        (made - bad).alias("pass_count"),
        bad.alias("ng_count"),
        F.sum("ng_count").alias("inspection_ng_count"),
        F.sum(F.when(~first, F.col("ng_count")).otherwise(0)).alias("recheck_ng_count"),
        F.when(made > 0, r6(bad / made * 100)).alias("defect_rate_percent"),
        bad_boards.alias("ng_board_count"),
        F.when(n_first > 0, r6((1 - bad_boards / n_first) * 100)).alias("board_pass_rate_percent"),
        again.alias("recheck_count"),
        good_again.alias("recheck_pass_count"),
        F.when(again > 0, r6(good_again / again)).alias("recheck_effective_rate"),
        F.min(timed)["fdate"].alias("first_time"),
        F.max(timed)["fdate"].alias("last_time"),
    )


def normalized(rows: DataFrame, triples: tuple[str, ...], singles: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the export mapped onto the rules contract; absent columns are NULL."""
    have = set(rows.columns)

    def take(name: str, kind: str = "double") -> Column:
        return (F.col(name) if name in have else F.lit(None).cast(kind)).alias(name)

    work_order = F.col("work_order") if "work_order" in have else F.col("cmodel")
    picked = [
        text(work_order).alias("work_order"),
        text("cmodel").alias("product_name"),
        text("barcode").alias("board_sn"),
        text("fdate").alias("inspect_time"),
        text("machinename").alias("machine"),
        F.lit("").alias("side"),
        component_of("compname").alias("component"),
        pad_of("compname").alias("pad"),
        F.col("comp_px").alias("x"),
        F.col("comp_py").alias("y"),
        F.col("comp_errname").alias("raw_ng_type"),
        F.col("comp_avdp").alias("volume_deviation_percent"),
        F.col("comp_aadp").alias("area_deviation_percent"),
        F.col("comp_ahdp").alias("height_deviation_percent"),
    ]
    for name in triples:
        picked += [take(f"{name}_plan"), take(name), take(f"diff_{name}")]
    taken = {c for name in triples for c in (f"{name}_plan", name, f"diff_{name}")}
    picked += [
        take(name, "double" if name in ("cycletime", "temperature", "humidity", "cleaningafterlastboard") else "string")
        for name in singles
        if name not in taken
    ]
    keep = [c for c in ("row_id", "ts", "total_pads") if c in have]
    return rows.select(*keep, *picked)
