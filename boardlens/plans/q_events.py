"""Queries: failure events."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions.stats import r6
from boardlens.operators import events as E
from boardlens.operators import parameters as P
from boardlens.operators.inspections import first_inspection_rows, inspections
from boardlens.plans.oracle import define
from boardlens.plans.registry import query, rows, shared
from boardlens.session import settled

define("dir_defects", """
SELECT barcode, fdate, CASE WHEN dkey LIKE 'over%' THEN 'OVER' ELSE 'UNDER' END AS direction, comp_errname AS defect,
 count(*) AS n, min(row_id) AS first_row FROM key_norm WHERE ng GROUP BY ALL
""")
define("dir_boards", """
SELECT d.barcode, d.fdate, d.direction, i.ts, i.model, i.machine, i.row_count, d.ng_dir, d.ng_dir / i.row_count AS share
FROM (SELECT barcode, fdate, direction, sum(n) AS ng_dir FROM dir_defects GROUP BY ALL) d
JOIN insp i USING (barcode, fdate) WHERE NOT i.is_recheck
""")
define("on_line", """
SELECT *, sum(opens) OVER (PARTITION BY model, machine, direction ORDER BY ts, barcode, fdate) AS event_no FROM (
 SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w <= INTERVAL 30 MINUTE, false) THEN 0 ELSE 1 END AS opens
 FROM dir_boards WINDOW w AS (PARTITION BY model, machine, direction ORDER BY ts, barcode, fdate))
""")
define("event_heads", """
SELECT printf('EVT%03d', row_number() OVER (ORDER BY min(ts), model, machine, direction, event_no)) AS event_id, model, machine, direction, event_no,
 min(ts) AS ts, max(ts) AS last_ts, arg_min(fdate, ts) AS start_time, arg_max(fdate, ts) AS end_time, count(*) AS board_count,
 CAST(sum(ng_dir) AS BIGINT) AS ng_record_count, max(share) AS max_ng_share,
 CASE WHEN bool_or(share >= 0.5 AND row_count >= 10) THEN 'BOARD_WIDE' ELSE 'LOCAL' END AS scope
FROM on_line GROUP BY model, machine, direction, event_no
""")
define("event_rows", "SELECT o.*, h.event_id FROM on_line o JOIN event_heads h USING (model, machine, direction, event_no)")
define("event_main", """
SELECT *, CASE defect WHEN 'AREAOVER' THEN 'comp_aadp' WHEN 'Under Height' THEN 'comp_ahdp' ELSE 'comp_avdp' END AS metric FROM (
 SELECT event_id, defect, count(*) OVER (PARTITION BY event_id) AS defect_names,
  row_number() OVER (PARTITION BY event_id ORDER BY sum(n) DESC, min((ts, barcode, fdate, first_row))) AS place
 FROM event_rows JOIN dir_defects USING (barcode, fdate, direction) GROUP BY event_id, defect) WHERE place = 1
""")
define("pre_clean", """
SELECT model, metric, ts, v, row_number() OVER (PARTITION BY model, metric ORDER BY ts, barcode, fdate) AS place FROM (
  SELECT model, ts, barcode, fdate, unnest(['comp_avdp', 'comp_aadp', 'comp_ahdp']) AS metric, unnest([avg_avdp, avg_aadp, avg_ahdp]) AS v
  FROM insp WHERE NOT is_recheck AND ng_count = 0) WHERE v IS NOT NULL
""")
define("pre_cut", """
SELECT h.event_id, m.metric, h.model, (SELECT count(*) FROM pre_clean c WHERE c.model = h.model AND c.metric = m.metric AND c.ts < h.ts) AS high
 FROM event_heads h JOIN event_main m USING (event_id)
""")
define("pre_tail", """
SELECT u.event_id, u.metric, c.place, c.v, lag(c.v) OVER w AS before, row_number() OVER (PARTITION BY u.event_id ORDER BY c.place DESC) AS back
 FROM pre_cut u LEFT JOIN pre_clean c ON c.model = u.model AND c.metric = u.metric AND c.place BETWEEN u.high - 19 AND u.high
 WINDOW w AS (PARTITION BY u.event_id ORDER BY c.place)
""")
define("pre_trend", """
SELECT event_id, metric, count(v) AS n, avg(v) AS mean, coalesce(regr_slope(v, place), 0) AS slope,
  coalesce(min(back) FILTER (NOT coalesce(v > before, false)), 1) - 1 AS rise FROM pre_tail GROUP BY ALL
""")


@shared
def tables(spark, sf):
    """Inspection rows, events and their boards; the boards are settled once."""
    base = rows(spark, sf)
    members = settled(E.event_boards(settled(E.direction_boards(base), "failing-boards")), "event-boards")
    events = settled(E.ng_events(members), "events")
    return base, events, settled(E.event_members(members, events), "event-members")


def _mains(base, members):
    return E.event_main_defect(members, E.board_defects(first_inspection_rows(base)))


@query("ng_events", "SELECT event_id, barcode, fdate, direction, CAST(ng_dir AS BIGINT) AS ng_count, round(share, 6) AS ng_share FROM event_rows")
def ng_events(spark, sf):
    return tables(spark, sf)[2].select("event_id", "barcode", "fdate", "direction", "ng_count", r6("ng_share").alias("ng_share"))


@query("event_main_defect", "SELECT event_id, defect AS main_defect, defect_names, metric FROM event_main")
def event_main_defect(spark, sf):
    base, _, members = tables(spark, sf)
    return _mains(base, members)


@query("event_summary", """
SELECT event_id, model, machine, direction, start_time, end_time, CAST(round(epoch(last_ts - ts) / 60) AS BIGINT) AS duration_minutes,
 board_count, ng_record_count, round(max_ng_share, 6) AS max_ng_share, scope FROM event_heads""")
def event_summary(spark, sf):
    return tables(spark, sf)[1].drop("event_no", "ts").withColumn("max_ng_share", r6("max_ng_share"))


@query("event_components", """
SELECT DISTINCT e.event_id, k.compname FROM event_rows e JOIN key_norm k
 ON k.barcode = e.barcode AND k.fdate = e.fdate AND k.ng AND CASE WHEN k.dkey LIKE 'over%' THEN 'OVER' ELSE 'UNDER' END = e.direction""")
def event_components(spark, sf):
    base, _, members = tables(spark, sf)
    return E.event_components(members, base)


@query("recheck_outcome", """
SELECT e.event_id, e.barcode, r.fdate AS recheck_time, CAST(coalesce(s.same_ng, r.ng_count) AS BIGINT) AS recheck_ng_count,
 coalesce(s.same_ng, r.ng_count) = 0 AS passed
FROM event_rows e JOIN (SELECT barcode, arg_max(fdate, ts) AS fdate, max(ts) AS ts, arg_max(ng_count, ts) AS ng_count FROM insp WHERE is_recheck GROUP BY 1) r
 ON r.barcode = e.barcode AND r.ts > e.ts
LEFT JOIN (SELECT barcode, fdate, direction, sum(n) AS same_ng FROM dir_defects GROUP BY ALL) s
 ON s.barcode = r.barcode AND s.fdate = r.fdate AND s.direction = e.direction""")
def recheck_outcome(spark, sf):
    base, _, members = tables(spark, sf)
    return E.recheck_outcome(members, base)


@query("precursor", """
SELECT event_id, metric, n AS baseline_boards, n >= 3 AS available, round(CASE WHEN n >= 3 THEN mean END, 6) AS baseline_avg,
 round(CASE WHEN n >= 3 THEN slope END, 6) AS slope, CASE WHEN n >= 3 THEN rise END AS tail_rise,
 CASE WHEN n >= 3 THEN slope >= 0.5 AND rise >= 3 END AS has_precursor FROM pre_trend""")
def precursor(spark, sf):
    base, events, members = tables(spark, sf)
    starts = events.join(_mains(base, members), "event_id")
    out = E.precursor(starts, inspections(base))
    return out.withColumns({c: r6(c) for c in ("baseline_avg", "slope")})


@query("environment_recorded", "SELECT coalesce(bool_or(temperature > 0 OR humidity > 0), false) AS environment_recorded FROM spi")
def environment_recorded(spark, sf):
    return E.environment_recorded(rows(spark, sf))


define("pass_means", """
SELECT barcode, fdate, ng_count, metric, value FROM (SELECT barcode, fdate, ng_count, unnest(['comp_avdp', 'comp_aadp', 'comp_ahdp']) AS metric,
 unnest([pass_avdp, pass_aadp, pass_ahdp]) AS value FROM insp) WHERE value IS NOT NULL""")
define("event_shift", """
SELECT e.event_id, any_value(m.metric) AS metric, avg(v.value) AS pass_mean, any_value(u.usual) AS usual FROM event_rows e JOIN event_main m USING (event_id)
JOIN pass_means v ON v.metric = m.metric AND v.barcode = e.barcode AND v.fdate = e.fdate
JOIN (SELECT m.event_id, (SELECT avg(p.value) FROM pass_means p WHERE p.metric = m.metric AND p.ng_count = 0 AND NOT EXISTS (
  SELECT 1 FROM event_rows x WHERE x.event_id = m.event_id AND x.barcode = p.barcode)) AS usual FROM event_main m) u USING (event_id)
GROUP BY e.event_id""")


@query("event_defects", "SELECT event_id, defect, CAST(sum(n) AS BIGINT) AS n FROM event_rows JOIN dir_defects USING (barcode, fdate, direction) GROUP BY ALL")
def event_defects(spark, sf):
    base, _, members = tables(spark, sf)
    return E.event_defects(members, E.board_defects(first_inspection_rows(base)))


@shared
def shifts(spark, sf):
    base, _, members = tables(spark, sf)
    return settled(E.pass_pad_shift(members, inspections(base), _mains(base, members)), "pass-shifts")


@query("pass_pad_shift", """
SELECT event_id, metric, round(pass_mean, 6) AS pass_mean, round(usual, 6) AS usual_mean, coalesce(usual > 0 AND pass_mean >= 2 * usual, false) AS shifted FROM event_shift""")
def pass_pad_shift(spark, sf):
    return shifts(spark, sf).withColumns({c: r6(c) for c in ("pass_mean", "usual_mean")})


@query("event_findings", """
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS BIGINT) AS place, finding FROM (
 SELECT event_id, 0 AS k, 'time_cluster' AS finding FROM event_heads
 UNION ALL SELECT event_id, 1, 'board_wide' FROM event_heads WHERE scope = 'BOARD_WIDE'
 UNION ALL SELECT event_id, 2, 'pass_pads_shifted' FROM event_shift WHERE usual > 0 AND pass_mean >= 2 * usual
 UNION ALL SELECT event_id, 3, CASE WHEN n >= 3 AND slope >= 0.5 AND rise >= 3 THEN 'precursor' WHEN n >= 3 THEN 'no_precursor' ELSE 'precursor_unknown' END FROM pre_trend
 UNION ALL SELECT group_id, 4, CASE WHEN bool_or(drifted) THEN 'parameters_drifted' ELSE 'parameters_normal' END FROM event_parameters GROUP BY 1
 UNION ALL SELECT event_id, 5, 'recheck_passed' FROM event_again WHERE bad = 0 GROUP BY 1
 UNION ALL SELECT event_id, 6, 'recheck_failed' FROM event_again WHERE bad > 0 GROUP BY 1
 UNION ALL SELECT event_id, 7, 'environment_not_recorded' FROM event_heads)""")
def event_findings(spark, sf):
    base, events, members = tables(spark, sf)
    groups = members.select(F.col("event_id").alias("group_id"), F.col("model").alias("cmodel"), "barcode")
    drifts = P.parameter_check(base, groups).withColumnRenamed("group_id", "event_id")
    starts = events.join(_mains(base, members), "event_id")
    out = E.event_findings(events, shifts(spark, sf), E.precursor(starts, inspections(base)), drifts, E.recheck_outcome(members, base),
                           E.environment_recorded(base))
    return out.withColumn("place", F.col("place").cast("bigint"))


define("event_again", """
SELECT e.event_id, coalesce(s.same_ng, r.ng_count) AS bad
FROM event_rows e JOIN (SELECT barcode, arg_max(fdate, ts) AS fdate, max(ts) AS ts, arg_max(ng_count, ts) AS ng_count FROM insp WHERE is_recheck GROUP BY 1) r
 ON r.barcode = e.barcode AND r.ts > e.ts
LEFT JOIN (SELECT barcode, fdate, direction, sum(n) AS same_ng FROM dir_defects GROUP BY ALL) s
 ON s.barcode = r.barcode AND s.fdate = r.fdate AND s.direction = e.direction""")
