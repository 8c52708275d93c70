"""Queries: runs of failures on one pad."""

from __future__ import annotations

from boardlens.functions.stats import r6
from boardlens.operators import evidence as V
from boardlens.operators import runs as U
from boardlens.operators.inspections import pad_points
from boardlens.plans.oracle import define
from boardlens.plans.registry import query, rows, shared
from boardlens.schema import METRICS
from boardlens.session import settled

define("made_points", """
SELECT *, row_number() OVER w - 1 AS pidx, sum(CASE WHEN ng THEN 0 ELSE 1 END) OVER w AS passes FROM points WHERE NOT is_recheck
WINDOW w AS (PARTITION BY cmodel, compname ORDER BY ts, barcode, fdate, row_id)
""")
define("pad_runs", """
SELECT cmodel, compname, passes, arg_min(machinename, pidx) AS machine, arg_min(barcode, pidx) AS start_barcode, arg_min(fdate, pidx) AS start_time,
 arg_max(barcode, pidx) AS end_barcode, arg_max(fdate, pidx) AS end_time, min(pidx) AS start_pidx, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS run_length
FROM made_points WHERE ng GROUP BY cmodel, compname, passes
""")
define("run_triggers", """
SELECT *, 'TRG-' || sha1(length(cmodel) || ':' || cmodel || length(compname) || ':' || compname || length(start_barcode) || ':' || start_barcode
 || length(start_time) || ':' || start_time) AS trigger_id FROM pad_runs WHERE run_length >= 3
""")
define("run_window", """
SELECT t.trigger_id, p.pos, p.pos - t.start_pos AS seq, p.barcode, p.fdate, p.ng, p.is_recheck, p.comp_avdp, p.comp_aadp, p.comp_ahdp,
 p.pos BETWEEN t.start_pos AND t.end_pos AND NOT p.is_recheck AS is_trigger, p.pos < t.start_pos AND NOT p.ng AND NOT p.is_recheck AS is_baseline
FROM run_triggers t JOIN points p ON p.cmodel = t.cmodel AND p.compname = t.compname AND p.pos BETWEEN t.start_pos - 300 AND t.end_pos + 300
""")
define("run_values", """
SELECT trigger_id, pos, is_trigger, is_baseline, unnest(['comp_avdp', 'comp_aadp', 'comp_ahdp']) AS metric,
 unnest([comp_avdp, comp_aadp, comp_ahdp]) AS v FROM run_window
""")
define("run_stats", """
SELECT trigger_id, metric, n, CASE WHEN n >= 5 THEN mean END AS mean, CASE WHEN n >= 5 THEN sd END AS sd, hit FROM (
 SELECT trigger_id, metric, count(v) FILTER (is_baseline) AS n, avg(v) FILTER (is_baseline) AS mean, stddev_pop(v) FILTER (is_baseline) AS sd,
  avg(v) FILTER (is_trigger) AS hit FROM run_values GROUP BY ALL)
""")
define("run_main", """
SELECT trigger_id, CASE main_defect WHEN 'AREAOVER' THEN 'comp_aadp' WHEN 'Under Height' THEN 'comp_ahdp' ELSE 'comp_avdp' END AS metric FROM (
 SELECT trigger_id, comp_errname AS main_defect, row_number() OVER (PARTITION BY trigger_id ORDER BY count(*) DESC, min(pidx)) AS place
 FROM run_triggers JOIN (SELECT cmodel, compname, passes, comp_errname, pidx FROM made_points WHERE ng) USING (cmodel, compname, passes)
 GROUP BY trigger_id, comp_errname) WHERE place = 1
""")
define("run_tail", """
SELECT *, lag(v) OVER (PARTITION BY trigger_id ORDER BY pos) AS before FROM (
 SELECT trigger_id, pos, v, row_number() OVER (PARTITION BY trigger_id ORDER BY pos DESC) AS back
 FROM run_values JOIN run_main USING (trigger_id, metric) WHERE is_baseline AND v IS NOT NULL) WHERE back <= 20
""")


# What runs and the windows around them read; the other columns of a row stay in the inspection table.
POINT_COLUMNS = ("row_id", "ts", "barcode", "fdate", "cmodel", "compname", "machinename", "comp_errname", "ng", *METRICS)


@shared
def points(spark, sf):
    return settled(pad_points(rows(spark, sf).select(*POINT_COLUMNS)), "points")


@shared
def tables(spark, sf):
    """Failing points and the runs they form."""
    failing = settled(U.failing_points(points(spark, sf)), "failing-points")
    return failing, settled(U.ng_runs(failing), "runs")


@shared
def triggers(spark, sf):
    return settled(U.trigger_runs(tables(spark, sf)[1]), "triggers")


@shared
def evidence(spark, sf):
    """Points around every trigger run, with the run's main metric."""
    long = triggers(spark, sf)
    window = settled(V.run_window(long, points(spark, sf)), "run-windows")
    return window, settled(U.run_main_defect(long, tables(spark, sf)[0]), "run-defects").select("trigger_id", "metric")


@query("trigger_runs", """
SELECT trigger_id, cmodel, compname, machine, start_barcode, start_time, end_barcode, end_time, start_pidx, start_pos, end_pos, run_length FROM run_triggers""")
def trigger_runs(spark, sf):
    return triggers(spark, sf).drop("passes", "ts")


@query("run_main_defect", """
SELECT trigger_id, main_defect, CASE main_defect WHEN 'AREAOVER' THEN 'comp_aadp' WHEN 'Under Height' THEN 'comp_ahdp' ELSE 'comp_avdp' END AS metric,
 CASE WHEN main_defect IN ('AREAOVER', 'Over Volume') THEN 'OVER' ELSE 'UNDER' END AS direction FROM (
 SELECT trigger_id, comp_errname AS main_defect, row_number() OVER (PARTITION BY trigger_id ORDER BY count(*) DESC, min(pidx)) AS place
 FROM run_triggers JOIN (SELECT cmodel, compname, passes, comp_errname, pidx FROM made_points WHERE ng) USING (cmodel, compname, passes)
 GROUP BY trigger_id, comp_errname) WHERE place = 1""")
def run_main_defect(spark, sf):
    return U.run_main_defect(triggers(spark, sf), tables(spark, sf)[0])


@query("periodicity", """
SELECT cmodel, compname, run_count, coalesce(run_count >= 3 AND sd / mean_gap < 0.25, false) AS periodic,
 CASE WHEN run_count >= 3 AND sd / mean_gap < 0.25 THEN round(mean_gap, 1) END AS mean_gap_boards FROM (
 SELECT cmodel, compname, count(*) AS run_count, avg(gap) AS mean_gap, stddev_pop(gap) AS sd FROM (
  SELECT *, start_pidx - lag(start_pidx) OVER (PARTITION BY cmodel, compname ORDER BY start_pidx) AS gap FROM pad_runs) GROUP BY ALL)""")
def periodicity(spark, sf):
    return U.periodicity(tables(spark, sf)[1])


@query("pad_series_window", "SELECT trigger_id, pos, seq, barcode, fdate, ng, is_recheck, is_trigger FROM run_window")
def pad_series_window(spark, sf):
    return evidence(spark, sf)[0].select("trigger_id", "pos", "seq", "barcode", "fdate", "ng", "is_recheck", "is_trigger")


@query("baseline_stats", """
SELECT trigger_id, metric, n AS baseline_points, round(mean, 6) AS mean, round(sd, 6) AS sigma, round(mean + 3 * sd, 6) AS upper,
 round(CASE WHEN n >= 5 THEN greatest(mean - 3 * sd, 0) END, 6) AS lower FROM run_stats JOIN run_main USING (trigger_id, metric)""")
def baseline_stats(spark, sf):
    window, main = evidence(spark, sf)
    out = V.baseline_stats(V.metric_stats(window), main)
    return out.withColumns({c: r6(c) for c in ("mean", "sigma", "upper", "lower")})


@query("metric_signature", """
SELECT trigger_id, metric, round(hit - mean, 6) AS delta, round(greatest(3 * sd, 10 + 0 * sd), 6) AS band,
 CASE WHEN hit - mean > greatest(3 * sd, 10) THEN 'up' WHEN hit - mean < -greatest(3 * sd, 10) THEN 'down' WHEN hit - mean IS NOT NULL THEN 'flat' END AS verdict FROM run_stats""")
def metric_signature(spark, sf):
    out = V.metric_signature(V.metric_stats(evidence(spark, sf)[0]))
    return out.withColumns({c: r6(c) for c in ("delta", "band")})


@query("change_type", """
SELECT trigger_id, CASE WHEN mean IS NULL THEN 'unknown' WHEN slope >= 0.5 AND rise >= 3 THEN 'gradual' ELSE 'step' END AS change_type,
 round(CASE WHEN mean IS NOT NULL THEN slope END, 6) AS slope, CASE WHEN mean IS NOT NULL THEN rise END AS tail_rise,
 round(CASE WHEN mean IS NOT NULL THEN hit END, 6) AS trigger_mean, round(CASE WHEN mean <> 0 THEN hit / mean END, 6) AS jump_ratio
FROM run_stats JOIN run_main USING (trigger_id, metric) LEFT JOIN (
 SELECT trigger_id, coalesce(regr_slope(v, -back), 0) AS slope, coalesce(min(back) FILTER (NOT coalesce(v > before, false)), 1) - 1 AS rise FROM run_tail GROUP BY 1)
 USING (trigger_id)""")
def change_type(spark, sf):
    window, main = evidence(spark, sf)
    out = V.change_type(window, V.metric_stats(window), main)
    return out.withColumns({c: r6(c) for c in ("slope", "trigger_mean", "jump_ratio")})
