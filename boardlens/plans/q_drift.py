"""Queries: the drift monitor, its warnings and its back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

import boardlens.plans.oracle.drift  # noqa: F401
import boardlens.plans.oracle.mechanisms  # noqa: F401
from boardlens.functions.scalars import stable_id
from boardlens.functions.stats import r6
from boardlens.operators import drift as D
from boardlens.operators import mechanisms as M
from boardlens.operators.inspections import monitor_points
from boardlens.plans.registry import query, rows, shared
from boardlens.session import settled

EPISODE = ("warning_id", "cmodel", "compname", "start_index", "start_barcode", "start_time", "level", "boards_above", "last_index",
           "l2_index", "l2_time", "l3_index", "end_index")


@shared
def floors(spark, sf):
    return settled(D.ng_floors(monitor_points(rows(spark, sf))), "floors")


def watched(spark, sf):
    """Not written: a walk shuffles the points once, and a copy of them would lie beside that."""
    return D.watched_points(rows(spark, sf), floors(spark, sf))


def walk_of(points, floors_, pairs, columns=("*",)):
    """Marked points with their floors, episodes (or some ``columns`` of them) and totals of all series."""
    walk = settled(D.with_floors(D.marked(points, pairs), floors_), "drift-marks")
    totals = settled(D.series_totals(walk), "drift-totals")
    return walk, settled(D.episodes(D.graded(walk, pairs), totals).select(*columns), "drift-episodes"), totals


@shared
def found(spark, sf):
    return walk_of(watched(spark, sf), floors(spark, sf), D.DEFAULT)


@query("ng_floor", "SELECT ts, round(floor_before, 6) AS floor_before FROM watch_floor")
def ng_floor(spark, sf):
    return floors(spark, sf).select("ts", r6("floor_before").alias("floor_before"))


@query("ewma_monitor", """
SELECT cmodel, compname, idx, ['comp_avdp', 'comp_aadp', 'comp_ahdp'][lane % 3 + 1] AS metric, round(z, 6) AS ewma, round(mu, 6) AS center,
 round(sd, 6) AS sigma, round(lim, 6) AS upper, crossed, CAST(streak AS BIGINT) AS streak
FROM walked JOIN watch_series ON sid = lane // 3 WHERE idx >= 0""")
def ewma_monitor(spark, sf):
    out = D.metric_trace(D.walked(watched(spark, sf)))
    return out.select(*D.SERIES, "idx", "metric", *[r6(c).alias(c) for c in ("ewma", "center", "sigma", "upper")], "crossed",
                      F.col("streak").cast("bigint").alias("streak"))


@query("warning_levels", """
SELECT cmodel, compname, idx, barcode, fdate, CAST(n_metrics AS BIGINT) AS n_metrics, CAST(longest AS BIGINT) AS longest, CAST(level AS BIGINT) AS level FROM drift_levels""")
def warning_levels(spark, sf):
    return D.graded(found(spark, sf)[0]).select(
        *D.SERIES, "idx", "barcode", "fdate", *[F.col(c).cast("bigint").alias(c) for c in ("n_metrics", "longest", "level")])


@query("episodes", """
SELECT warning_id, cmodel, compname, start_index, start_barcode, start_time, CAST(level AS BIGINT) AS level, boards_above, last_index, l2_index, l2_time,
 l3_index, end_index, metrics FROM drift_episodes""")
def episodes(spark, sf):
    return found(spark, sf)[1].select(*EPISODE, F.array_join("metrics", ",").alias("metrics")).withColumn("level", F.col("level").cast("bigint"))


@query("replay", """
SELECT cmodel, compname, s.boards, s.ng_count, coalesce(crossings, 0) AS crossings, coalesce(episodes, 0) AS episodes, CAST(coalesce(level, 0) AS BIGINT) AS level
FROM watch_series s LEFT JOIN (SELECT cmodel, compname, CAST(sum(boards_above) AS BIGINT) AS crossings, count(*) AS episodes, max(level) AS level
 FROM drift_episodes GROUP BY ALL) USING (cmodel, compname)""")
def replay(spark, sf):
    _, warned, totals = found(spark, sf)
    per = warned.groupBy(*D.SERIES).agg(
        F.sum("boards_above").alias("crossings"), F.count(F.lit(1)).alias("episodes"), F.max("level").cast("bigint").alias("level"))
    return totals.join(per, D.SERIES, "left").select(*D.SERIES, "boards", "ng_count", *[
        F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("crossings", "episodes", "level")])


def _score(name):
    return f"""
SELECT round(lam, 1) AS lam, width AS "limit", total AS total_boards, coalesce(l2, 0) AS l2_episode_count, coalesce(hits, 0) AS hit_count,
 coalesce(l2, 0) - coalesce(hits, 0) AS false_count, round((coalesce(l2, 0) - coalesce(hits, 0)) / total * 100, 6) AS false_per_100_boards
FROM {name} JOIN (SELECT max(boards) AS total FROM watch_series WHERE compname = '__board__') ON true"""


@query("backtest", _score("(SELECT 0.2 AS lam, CAST(4 AS DOUBLE) AS width, l2, hits FROM drift_score)"))
def backtest(spark, sf):
    walk, warned, totals = found(spark, sf)
    return D.backtest(warned, walk, totals).withColumn("false_per_100_boards", r6("false_per_100_boards"))


@query("backtest_outcomes", """
SELECT cmodel, compname, barcode AS first_ng_barcode, fdate AS first_ng_time, idx - warned AS lead_boards, coalesce(idx - warned <= 50, false) AS warned_within_horizon
FROM (SELECT cmodel, compname, min(idx) AS idx, arg_min(barcode, idx) AS barcode, arg_min(fdate, idx) AS fdate FROM watch WHERE ng AND compname <> '__board__' GROUP BY ALL) p
LEFT JOIN (SELECT e.cmodel, e.compname, max(l2_index) AS warned FROM drift_episodes e
 JOIN (SELECT cmodel, compname, min(idx) AS first_index FROM watch WHERE ng GROUP BY ALL) f USING (cmodel, compname) WHERE l2_index <= first_index GROUP BY ALL) USING (cmodel, compname)""")
def backtest_outcomes(spark, sf):
    _, warned, totals = found(spark, sf)
    return D.outcomes(warned, totals).drop("lam", "limit")


@query("backtest_grid", _score("(SELECT CAST(pair // 3 + 1 AS DOUBLE) / CAST(10 AS DOUBLE) AS lam, CAST(5 + pair % 3 AS DOUBLE) / CAST(2 AS DOUBLE) AS width, l2, hits FROM range(9) p(pair) LEFT JOIN grid_score USING (pair))"))
def backtest_grid(spark, sf):
    walk, warned, totals = walk_of(
        watched(spark, sf), floors(spark, sf), D.GRID, (*D.SERIES, "lam", "limit", "start_index", "l2_index"))
    return D.backtest(warned, walk, totals, D.GRID).withColumn("false_per_100_boards", r6("false_per_100_boards"))


_HEALTH = """
(SELECT s.cmodel, s.compname, s.compname = '__board__' AS is_board_series, s.boards, s.ng_count, CAST(coalesce(e.level, 0) AS BIGINT) AS level, e.level IS NOT NULL AS episode_active,
 w.z AS ewma, w.mu AS center, w.lim AS upper, (f.low - w.z) / (3 * w.sd) AS margin
FROM watch_series s JOIN walked w ON w.lane = s.sid * 3 AND w.idx = s.boards - 1
JOIN (SELECT min(comp_avdp) AS low FROM firsts WHERE ng AND comp_avdp > 0 AND ts IS NOT NULL) f ON true
LEFT JOIN (SELECT cmodel, compname, level FROM drift_episodes WHERE end_index IS NULL) e ON e.cmodel = s.cmodel AND e.compname = s.compname)"""
_FIGURES = ("ewma", "center", "upper", "margin")


def health(spark, sf):
    walk, warned, totals = found(spark, sf)
    out = D.pad_health(walk, warned, totals, floors(spark, sf))
    return out.withColumns({c: r6(c) for c in _FIGURES}).withColumn("level", F.col("level").cast("bigint"))


@query("pad_health", f"SELECT * REPLACE (round(ewma, 6) AS ewma, round(center, 6) AS center, round(upper, 6) AS upper, round(margin, 6) AS margin) FROM {_HEALTH}")
def pad_health(spark, sf):
    return health(spark, sf)


@query("health_tone", f"""
SELECT cmodel, compname, round(margin, 6) AS margin, CASE WHEN episode_active OR coalesce(margin < 0, false) THEN 'danger' WHEN margin < 0.5 THEN 'warn'
 WHEN margin IS NULL THEN 'muted' ELSE 'ok' END AS tone FROM {_HEALTH}""")
def health_tone(spark, sf):
    return D.health_tone(health(spark, sf)).select(*D.SERIES, "margin", "tone").orderBy(F.asc_nulls_last("margin"), *D.SERIES)


@query("warnings_report", """
SELECT row_number() OVER (ORDER BY NOT page_alert, status <> 'active', start_ts, warning_id) AS place, warning_id, cmodel, compname, CAST(level AS BIGINT) AS level,
 status, pending_new_baseline, page_alert, start_time, start_barcode, l2_time, boards_above, metrics FROM drift_warnings""")
def warnings_report(spark, sf):
    return D.report(D.warnings(found(spark, sf)[1])).select(
        "place", "warning_id", *D.SERIES, F.col("level").cast("bigint").alias("level"), "status", "pending_new_baseline", "page_alert", "start_time",
        "start_barcode", "l2_time", "boards_above", F.array_join("metrics", ",").alias("metrics"))


@query("warnings_summary", """
SELECT (SELECT count(*) FROM watch_series WHERE compname <> '__board__') AS pads_monitored, count(*) FILTER (status = 'active') AS active_episodes,
 count(*) FILTER (page_alert) AS page_alerts, count(*) FILTER (pending_new_baseline) AS pending_new_baseline FROM drift_warnings""")
def warnings_summary(spark, sf):
    _, warned, totals = found(spark, sf)
    return D.warning_summary(D.warnings(warned), totals)


@query("warning_series", """
SELECT warning_id, w.idx, w.barcode, w.fdate, w.ng, round(w.comp_avdp, 6) AS comp_avdp, round(z, 6) AS ewma, round(lim, 6) AS upper
FROM drift_episodes e JOIN watch w ON w.cmodel = e.cmodel AND w.compname = e.compname AND w.idx BETWEEN e.start_index - 20 AND coalesce(end_index, e.boards - 1)
JOIN watch_series s ON s.cmodel = e.cmodel AND s.compname = e.compname JOIN walked k ON k.lane = s.sid * 3 AND k.idx = w.idx""")
def warning_series(spark, sf):
    _, warned, totals = found(spark, sf)
    out = D.warning_series(warned, D.walked(watched(spark, sf)), totals)
    return out.withColumns({c: r6(c) for c in ("comp_avdp", "ewma", "upper")})


@query("warning_mechanisms", """
SELECT warning_id, mechanism, CAST(place AS BIGINT) AS place, 0.45 AS confidence FROM drift_episodes JOIN mechanism_extents
 ON extent = CASE WHEN compname = '__board__' THEN 'board_wide' ELSE 'single_pad' END WHERE early""")
def warning_mechanisms(spark, sf):
    return M.warning_mechanisms(found(spark, sf)[1]).withColumn("place", F.col("place").cast("bigint"))


@query("accept_baseline", "SELECT cmodel, compname, CAST(restarts AS BIGINT) AS restarts, boards, ng_count, episodes, CAST(level AS BIGINT) AS level FROM accepted_series")
def accept_baseline(spark, sf):
    """Accepted here: every warning that a board could raise and whose id begins with a digit below 8."""
    points = settled(watched(spark, sf), "watched")  # every round reads them
    ids = points.select(stable_id("WRN-", *D.SERIES, "barcode", "fdate").alias("warning_id"))
    walk = settled(D.with_accepted(points, ids.where(F.substring("warning_id", 5, 1) < "8"), floors(spark, sf), D.marked), "accepted-trace")
    totals = settled(D.series_totals(walk), "accepted-totals")
    warned = D.episodes(D.graded(walk), totals)
    per = warned.groupBy(*D.SERIES).agg(F.count(F.lit(1)).alias("episodes"), F.max(F.when(F.col("end_index").isNull(), F.col("level"))).alias("level"))
    times = walk.groupBy(*D.SERIES).agg(F.max("restarts").cast("bigint").alias("restarts"))
    return totals.join(times, D.SERIES).join(per, D.SERIES, "left").select(
        *D.SERIES, "restarts", "boards", "ng_count", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("episodes", "level")])
