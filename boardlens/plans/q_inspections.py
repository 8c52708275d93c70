"""Queries: inspections and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions.stats import r6
from boardlens.operators import inspections as I
from boardlens.plans.registry import query, rows
from boardlens.sources.readers import time_text

_AVG = "avg_avdp", "avg_aadp", "avg_ahdp", "pass_avdp", "pass_aadp", "pass_ahdp"


@query("aggregate_boards", """
SELECT i.barcode, i.fdate, i.model, i.machine, i.row_count, i.ng_count, round(i.ng_count / i.row_count, 6) AS ng_share,
 round(avg_avdp, 6) AS avg_avdp, round(avg_aadp, 6) AS avg_aadp, round(avg_ahdp, 6) AS avg_ahdp,
 round(pass_avdp, 6) AS pass_avdp, round(pass_aadp, 6) AS pass_aadp, round(pass_ahdp, 6) AS pass_ahdp,
 coalesce(t.types, '') AS ng_types, coalesce(t.pads, '') AS ng_components, coalesce(d.ways, '') AS directions, coalesce(d.way_pads, '') AS direction_pads
FROM insp i LEFT JOIN (
  SELECT barcode, fdate, string_agg(comp_errname || '=' || n, ',' ORDER BY comp_errname) AS types,
   array_to_string(list_sort(list_distinct(flatten(list(pads)))), ',') AS pads FROM (
   SELECT barcode, fdate, comp_errname, count(*) AS n, list(DISTINCT compname) AS pads FROM rows_ng WHERE ng GROUP BY ALL) GROUP BY ALL) t USING (barcode, fdate)
 LEFT JOIN (
  SELECT barcode, fdate, string_agg(direction || '=' || n, ',' ORDER BY direction) AS ways,
   string_agg(direction || '=' || pads, ';' ORDER BY direction) AS way_pads FROM (
   SELECT barcode, fdate, CASE WHEN dkey LIKE 'over%' THEN 'OVER' ELSE 'UNDER' END AS direction, count(*) AS n,
    array_to_string(list_sort(list(DISTINCT compname)), ',') AS pads FROM key_norm WHERE ng GROUP BY ALL) GROUP BY ALL) d USING (barcode, fdate)""")
def aggregate_boards(spark, sf):
    df = I.board_report(rows(spark, sf))

    def flat(column):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
        return F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit(""))

    pads = F.transform(
        F.map_entries("ng_components_by_direction"),
        lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, ",")))
    return df.select(
        "barcode", "fdate", "model", "machine", "row_count", "ng_count", r6("ng_share").alias("ng_share"),
        *[r6(c).alias(c) for c in _AVG], flat(F.col("ng_types")).alias("ng_types"),
        F.coalesce(F.array_join("ng_components", ","), F.lit("")).alias("ng_components"),
        flat(F.col("ng_count_by_direction")).alias("directions"),
        F.coalesce(F.array_join(F.array_sort(pads), ";"), F.lit("")).alias("direction_pads"))


@query("recheck_flag", "SELECT barcode, fdate, is_recheck FROM insp")
def recheck_flag(spark, sf):
    return I.inspections(rows(spark, sf)).select("barcode", "fdate", "is_recheck")


@query("first_inspection_rows", "SELECT row_id, barcode, fdate, compname, comp_errname FROM firsts")
def first_inspection_rows(spark, sf):
    return I.first_inspection_rows(rows(spark, sf)).select("row_id", "barcode", "fdate", "compname", "comp_errname")


@query("total_pad_counts", "SELECT barcode AS board_sn, count(DISTINCT compname) AS total_pads FROM spi GROUP BY 1")
def total_pad_counts(spark, sf):
    return I.total_pad_counts(I.normalized(rows(spark, sf), ()))


@query("pad_points", """
SELECT row_id, cmodel, compname, barcode, fdate, pos, is_recheck, ng, b_rows AS board_row_count, b_ng AS board_ng_count FROM points""")
def pad_points(spark, sf):
    base = rows(spark, sf)
    return I.pad_points(base).join(I.inspection_sizes(base), ["cmodel", "barcode", "fdate"]).select(
        "row_id", "cmodel", "compname", "barcode", "fdate", "pos", "is_recheck", "ng",
        F.col("b_rows").alias("board_row_count"), F.col("b_ng").alias("board_ng_count"))


@query("monitor_points", """
SELECT row_id, cmodel, compname, barcode, fdate, ng, comp_avdp, comp_aadp, comp_ahdp FROM firsts WHERE compname <> '' AND ts IS NOT NULL""")
def monitor_points(spark, sf):
    return I.monitor_points(rows(spark, sf)).select(
        "row_id", "cmodel", "compname", "barcode", "fdate", "ng", "comp_avdp", "comp_aadp", "comp_ahdp")


@query("board_mean_points", """
SELECT cmodel, '__board__' AS compname, barcode, fdate, bool_or(ng) AS ng, round(avg(comp_avdp), 6) AS comp_avdp,
 round(avg(comp_aadp), 6) AS comp_aadp, round(avg(comp_ahdp), 6) AS comp_ahdp FROM firsts GROUP BY cmodel, barcode, fdate""")
def board_mean_points(spark, sf):
    return I.board_mean_points(rows(spark, sf)).select(
        "cmodel", "compname", "barcode", "fdate", "ng", *[r6(m).alias(m) for m in I.METRICS])


@query("production_boards", """
SELECT barcode, fdate, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(comp_avdp), 6) AS mean_avdp, count(*) FILTER (ng) AS ng_count,
 arg_min(cleaningfrequency, row_id) AS cleaningfrequency, arg_min(frontsqgpress, row_id) AS frontsqgpress,
 arg_min(rearsqgpress, row_id) AS rearsqgpress, arg_min(printdirection, row_id) AS printdirection FROM firsts GROUP BY barcode, fdate""")
def production_boards(spark, sf):
    return I.production_boards(rows(spark, sf)).withColumns({"ts": time_text("ts"), "mean_avdp": r6("mean_avdp")})


@query("data_overview", """
SELECT CAST(sum(row_count) AS BIGINT) AS record_count, CAST(sum(row_count) FILTER (NOT is_recheck) AS BIGINT) AS production_record_count,
 count(*) FILTER (NOT is_recheck) AS board_count, count(*) AS inspection_count, count(DISTINCT model) AS model_count,
 count(DISTINCT machine) AS machine_count,
 CAST(sum(row_count - ng_count) FILTER (NOT is_recheck) AS BIGINT) AS pass_count,
 CAST(sum(ng_count) FILTER (NOT is_recheck) AS BIGINT) AS ng_count, CAST(sum(ng_count) AS BIGINT) AS inspection_ng_count,
 CAST(sum(ng_count) FILTER (is_recheck) AS BIGINT) AS recheck_ng_count,
 round(sum(ng_count) FILTER (NOT is_recheck) / sum(row_count) FILTER (NOT is_recheck) * 100, 6) AS defect_rate_percent,
 count(*) FILTER (NOT is_recheck AND ng_count > 0) AS ng_board_count,
 round((1 - count(*) FILTER (NOT is_recheck AND ng_count > 0) / count(*) FILTER (NOT is_recheck)) * 100, 6) AS board_pass_rate_percent,
 count(*) FILTER (is_recheck) AS recheck_count, count(*) FILTER (is_recheck AND ng_count = 0) AS recheck_pass_count,
 round(count(*) FILTER (is_recheck AND ng_count = 0) / count(*) FILTER (is_recheck), 6) AS recheck_effective_rate,
 arg_min(fdate, ts) AS first_time, arg_max(fdate, ts) AS last_time FROM insp""")
def data_overview(spark, sf):
    return I.data_overview(rows(spark, sf))
