"""Shared expressions for parameters, evidence around triggers and diagnosis."""

import boardlens.plans.oracle.mechanisms  # noqa: F401
import boardlens.plans.q_events  # noqa: F401
import boardlens.plans.q_runs  # noqa: F401
from boardlens.plans.oracle import define

define("board_params", """
SELECT barcode, cmodel, parameter, max(value) AS value FROM (
 SELECT barcode, cmodel, unnest(['printspeed', 'snapoffspeed']) AS parameter, unnest([abs_printspeed, abs_snapoffspeed]) AS value FROM spi) GROUP BY ALL
""")


def drift_of(name: str, groups: str) -> None:
    define(f"{name}_usual", f"""
SELECT s.group_id, b.parameter, max(b.value) AS baseline_max FROM (SELECT DISTINCT group_id, model FROM {groups}) s JOIN board_params b ON b.cmodel = s.model
WHERE NOT EXISTS (SELECT 1 FROM {groups} g WHERE g.group_id = s.group_id AND g.barcode = b.barcode) GROUP BY ALL""")
    define(name, f"""
SELECT *, group_max > coalesce(baseline_max, -1) AS drifted FROM (
 SELECT g.group_id, b.parameter, max(b.value) AS group_max, NOT bool_or(u.group_id IS NOT NULL) AS cross_model,
  CASE WHEN bool_or(u.group_id IS NOT NULL) THEN max(u.baseline_max) ELSE (SELECT max(o.value) FROM board_params o WHERE o.parameter = b.parameter
   AND NOT EXISTS (SELECT 1 FROM {groups} x WHERE x.group_id = g.group_id AND x.barcode = o.barcode)) END AS baseline_max
 FROM {groups} g JOIN board_params b USING (barcode) LEFT JOIN {name}_usual u ON u.group_id = g.group_id AND u.parameter = b.parameter GROUP BY g.group_id, b.parameter)""")


define("event_groups", "SELECT DISTINCT event_id AS group_id, model, barcode FROM event_rows")
drift_of("event_parameters", "event_groups")

define("run_points", """
SELECT *, in_run AND NOT is_recheck AS is_trigger FROM (
 SELECT t.trigger_id, t.cmodel, t.compname, t.end_pos - t.start_pos AS end_seq, p.row_id, p.barcode, p.fdate, p.ng, p.is_recheck, p.b_rows, p.b_ng,
  p.comp_avdp, p.comp_aadp, p.comp_ahdp, p.pos - t.start_pos AS seq, p.pos BETWEEN t.start_pos AND t.end_pos AS in_run
 FROM run_triggers t JOIN points p ON p.cmodel = t.cmodel AND p.compname = t.compname AND p.pos BETWEEN t.start_pos - 300 AND t.end_pos + 300)
""")
define("run_way", """
SELECT trigger_id, CASE main_defect WHEN 'AREAOVER' THEN 'comp_aadp' WHEN 'Under Height' THEN 'comp_ahdp' ELSE 'comp_avdp' END AS metric,
 CASE WHEN main_defect IN ('AREAOVER', 'Over Volume') THEN 'OVER' ELSE 'UNDER' END AS direction FROM (
 SELECT trigger_id, comp_errname AS main_defect, row_number() OVER (PARTITION BY trigger_id ORDER BY count(*) DESC, min(pidx)) AS place
 FROM run_triggers JOIN (SELECT cmodel, compname, passes, comp_errname, pidx FROM made_points WHERE ng) USING (cmodel, compname, passes)
 GROUP BY trigger_id, comp_errname) WHERE place = 1
""")
define("trigger_groups", "SELECT DISTINCT trigger_id AS group_id, cmodel AS model, barcode FROM run_points WHERE is_trigger")
drift_of("trigger_parameter_rows", "trigger_groups")
define("setpoint_steps", """
SELECT trigger_id, seq, barcode, fdate, field, v, lag(v) OVER w AS pv, row_number() OVER w AS n FROM (
 SELECT trigger_id, seq, p.barcode, p.fdate, unnest(['markdeviation_plan', 'printmode', 'printspeed_plan', 'snapoffspeed_plan']) AS field,
  unnest([CAST(markdeviation_plan AS VARCHAR), printmode, CAST(printspeed_plan AS VARCHAR), CAST(snapoffspeed_plan AS VARCHAR)]) AS v
 FROM run_points p JOIN spi s USING (row_id) WHERE NOT is_recheck) WINDOW w AS (PARTITION BY trigger_id, field ORDER BY seq)
""")
define("setpoint_moves", """
SELECT trigger_id, seq, barcode, fdate, replace(field, '_plan', '') AS parameter, pv AS from_value, v AS to_value FROM setpoint_steps
JOIN (SELECT trigger_id, field FROM setpoint_steps WHERE n > 1 GROUP BY ALL HAVING count(*) FILTER (v <> pv) > 0 AND count(*) FILTER (v <> pv) / count(*) <= 0.34) USING (trigger_id, field)
WHERE n > 1 AND v <> pv
""")
define("run_value", """
SELECT p.*, w.metric, w.direction, CASE w.metric WHEN 'comp_avdp' THEN comp_avdp WHEN 'comp_aadp' THEN comp_aadp ELSE comp_ahdp END AS value FROM run_points p JOIN run_way w USING (trigger_id)
""")
define("run_recovered", """
SELECT t.trigger_id, any_value(t.end_pos - t.start_pos) AS end_seq, count(v.row_id) AS boards_after,
 min(v.seq) FILTER (NOT v.ng AND (s.mean IS NULL OR coalesce(v.value <= s.mean + 3 * s.sd, false))) AS recovered_seq
FROM run_triggers t LEFT JOIN run_value v ON v.trigger_id = t.trigger_id AND NOT v.is_recheck AND v.seq > v.end_seq
LEFT JOIN run_stats s ON s.trigger_id = v.trigger_id AND s.metric = v.metric GROUP BY t.trigger_id
""")
define("run_recovery", """
SELECT r.trigger_id, boards_after, recovered_seq, CASE WHEN boards_after = 0 THEN 'no_data' WHEN recovered_seq IS NULL THEN 'not_recovered' ELSE 'recovered' END AS recovery,
 coalesce((SELECT string_agg(DISTINCT parameter, ',' ORDER BY parameter) FROM setpoint_moves m WHERE m.trigger_id = r.trigger_id AND m.seq > r.end_seq AND m.seq <= r.recovered_seq), '') AS recovery_parameters
FROM run_recovered r
""")
define("run_siblings", """
SELECT v.trigger_id, r.compname AS sibling, v.seq, v.is_trigger, r.ng, CASE v.metric WHEN 'comp_avdp' THEN r.comp_avdp WHEN 'comp_aadp' THEN r.comp_aadp ELSE r.comp_ahdp END AS value
FROM run_value v JOIN rows_ng r ON r.cmodel = v.cmodel AND r.barcode = v.barcode AND r.fdate = v.fdate AND r.compname <> v.compname
 AND regexp_extract(r.compname, '^(.+)_[0-9]+$', 1) = regexp_extract(v.compname, '^(.+)_[0-9]+$', 1)
""")
define("run_scope", """
SELECT trigger_id, max_share, coalesce(n, 0) AS ng_siblings, CASE WHEN wide THEN 'board' WHEN n > 0 THEN 'component' ELSE 'single' END AS scope
FROM (SELECT trigger_id, max(b_ng / b_rows) AS max_share, bool_or(b_ng / b_rows >= 0.5 AND b_rows >= 10) AS wide FROM run_points WHERE is_trigger GROUP BY 1)
LEFT JOIN (SELECT trigger_id, count(DISTINCT sibling) AS n FROM run_siblings WHERE is_trigger AND ng GROUP BY 1) USING (trigger_id)
""")
define("run_parameters", """
SELECT trigger_id, seq, unnest(['printspeed', 'snapoffspeed']) AS parameter, unnest([printspeed, snapoffspeed]) AS actual, unnest([printspeed_plan, snapoffspeed_plan]) AS "plan",
 unnest([diff_printspeed, diff_snapoffspeed]) AS diff FROM run_points JOIN spi USING (row_id)
""")
define("placed_rows", "SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, barcode, compname, row_id) AS place FROM rows_ng")
define("run_rows", """
SELECT s.trigger_id, p.*, f.row_id IS NOT NULL AS is_trigger_row, b.barcode IS NOT NULL AS on_trigger_board,
 regexp_extract(p.compname, '^(.+)_[0-9]+$', 1) = regexp_extract(s.pad, '^(.+)_[0-9]+$', 1) AS is_same_component, p.compname = s.pad AS is_same_pad,
 CASE w.direction WHEN 'OVER' THEN contains(lower(p.comp_errname), 'over') ELSE contains(lower(p.comp_errname), 'under') END AS is_same_direction
FROM (SELECT r.trigger_id, r.compname AS pad, min(place) - 500 AS low, max(place) + 500 AS high FROM run_points r JOIN placed_rows USING (row_id) WHERE r.in_run GROUP BY ALL) s
JOIN run_way w USING (trigger_id) JOIN placed_rows p ON p.place BETWEEN s.low AND s.high
LEFT JOIN (SELECT trigger_id, row_id FROM run_points WHERE in_run) f ON f.trigger_id = s.trigger_id AND f.row_id = p.row_id
LEFT JOIN (SELECT DISTINCT trigger_id, barcode FROM run_points WHERE is_trigger) b ON b.trigger_id = s.trigger_id AND b.barcode = p.barcode
""")
define("run_areas", """
SELECT *, coalesce(x_share <= 0.35 AND y_share <= 0.35, false) AS local_area FROM (
 SELECT trigger_id, ng_rows, ng_pads, CASE WHEN enough THEN bx / ax END AS x_share, CASE WHEN enough THEN "by" / ay END AS y_share FROM (
  SELECT *, ng_pads >= 3 AND n >= 3 AND ax > 0 AND ay > 0 AS enough FROM (
   SELECT trigger_id, count(*) AS n, count(*) FILTER (ng) AS ng_rows, count(DISTINCT compname) FILTER (ng) AS ng_pads,
    max(comp_px) - min(comp_px) AS ax, max(comp_py) - min(comp_py) AS ay,
    max(comp_px) FILTER (ng) - min(comp_px) FILTER (ng) AS bx, max(comp_py) FILTER (ng) - min(comp_py) FILTER (ng) AS "by"
   FROM run_rows WHERE on_trigger_board GROUP BY 1)))
""")
define("run_change", """
SELECT trigger_id, CASE WHEN mean IS NULL THEN 'unknown' WHEN slope >= 0.5 AND rise >= 3 THEN 'gradual' ELSE 'step' END AS change_type
FROM run_stats JOIN run_main USING (trigger_id, metric) LEFT JOIN (
 SELECT trigger_id, coalesce(regr_slope(v, -back), 0) AS slope, coalesce(min(back) FILTER (NOT coalesce(v > before, false)), 1) - 1 AS rise FROM run_tail GROUP BY 1) USING (trigger_id)
""")
define("run_checks", """
SELECT trigger_id, concat_ws(',', CASE WHEN rechecked THEN 'has_recheck' END, CASE WHEN boards < 3 THEN 'few_boards' END) AS data_flags,
 CASE WHEN rechecked OR boards < 3 THEN 'review' ELSE 'pass' END AS data_status,
 concat_ws(',', CASE WHEN change_type = 'unknown' THEN 'no_baseline' END, CASE WHEN weak THEN 'weak_metric' END, CASE WHEN alone THEN 'self_recovery' END) AS alarm_flags,
 CASE WHEN weak THEN 'suspect' WHEN change_type = 'unknown' OR alone THEN 'review' ELSE 'pass' END AS alarm_status
FROM (SELECT trigger_id, bool_or(is_recheck) AS rechecked, count(DISTINCT barcode) AS boards, coalesce(max(value) FILTER (ng) < 20, false) AS weak
 FROM run_value WHERE in_run GROUP BY 1) JOIN run_change USING (trigger_id)
JOIN (SELECT trigger_id, recovery = 'recovered' AND recovery_parameters = '' AS alone FROM run_recovery) USING (trigger_id)
""")
define("pad_periods", """
SELECT cmodel, compname, coalesce(run_count >= 3 AND sd / mean_gap < 0.25, false) AS periodic, CASE WHEN run_count >= 3 AND sd / mean_gap < 0.25 THEN round(mean_gap, 1) END AS gap FROM (
 SELECT cmodel, compname, count(*) AS run_count, avg(gap) AS mean_gap, stddev_pop(gap) AS sd FROM (
  SELECT *, start_pidx - lag(start_pidx) OVER (PARTITION BY cmodel, compname ORDER BY start_pidx) AS gap FROM pad_runs) GROUP BY ALL)
""")
define("run_axes", """
SELECT trigger_id, spatial, CASE WHEN periodic THEN 'periodic' ELSE 'consecutive' END AS temporal,
 CASE WHEN alarm_status = 'suspect' THEN 'spi_suspect' WHEN data_status <> 'pass' THEN 'data_suspect' ELSE 'valid' END AS validity,
 CASE WHEN alarm_status = 'suspect' THEN 'spi_false_alarm' ELSE spatial END AS category
FROM (SELECT trigger_id, CASE scope WHEN 'board' THEN 'board_wide' WHEN 'component' THEN 'component_multi_pad' ELSE
  CASE WHEN local_area THEN 'local_area' WHEN rate >= 0.5 THEN 'board_wide' ELSE 'single_pad' END END AS spatial
 FROM run_scope JOIN run_areas USING (trigger_id) JOIN (SELECT trigger_id, count(*) FILTER (ng) / count(*) AS rate FROM run_rows GROUP BY 1) USING (trigger_id))
JOIN run_checks USING (trigger_id) JOIN (SELECT trigger_id, periodic FROM run_triggers JOIN pad_periods USING (cmodel, compname)) USING (trigger_id)
""")
define("run_observed", """
SELECT trigger_id, direction, category, spatial, temporal, validity, change_type AS trend_kind, sig_avdp, sig_aadp, sig_ahdp, coalesce(names, '') AS drifted_parameters,
 coalesce(cross_model, false) AS cross_model, recovery, recovery_parameters, periodic, gap AS periodic_gap, CAST(3 AS DOUBLE) AS cleaning_frequency, data_status, alarm_status
FROM run_triggers JOIN pad_periods USING (cmodel, compname) JOIN run_way USING (trigger_id) JOIN run_axes USING (trigger_id) JOIN run_change USING (trigger_id)
LEFT JOIN (SELECT trigger_id, max(v) FILTER (metric = 'comp_avdp') AS sig_avdp, max(v) FILTER (metric = 'comp_aadp') AS sig_aadp, max(v) FILTER (metric = 'comp_ahdp') AS sig_ahdp FROM (
  SELECT trigger_id, metric, CASE WHEN hit - mean > greatest(3 * sd, 10) THEN 'up' WHEN hit - mean < -greatest(3 * sd, 10) THEN 'down' WHEN hit - mean IS NOT NULL THEN 'flat' END AS v
  FROM run_stats) GROUP BY 1) USING (trigger_id)
LEFT JOIN (SELECT group_id AS trigger_id, string_agg(parameter, ',' ORDER BY parameter) FILTER (drifted) AS names, bool_or(cross_model) AS cross_model FROM trigger_parameter_rows GROUP BY 1) USING (trigger_id)
JOIN run_recovery USING (trigger_id) JOIN run_checks USING (trigger_id)
""")
define("mechanism_signatures", """
SELECT * FROM (VALUES ('aperture_clogging', 'UNDER', ['up'], ['up', 'flat'], ['up', 'flat']), ('poor_release', 'UNDER', ['up'], ['flat'], ['up']),
 ('understencil_residue', 'OVER', ['up'], ['up'], ['flat', 'up']), ('poor_gasketing', 'BOTH', ['flat', 'up'], ['up'], ['up']), ('slump', 'OVER', ['flat'], ['up'], ['up']),
 ('paste_rheology_drift', 'BOTH', NULL, NULL, NULL), ('supply_interruption', 'UNDER', ['up'], ['up'], ['up'])) m(mechanism, way, a, b, c)
""")
_judged = " + ".join(f"CASE WHEN {c} IS NOT NULL AND {s} IS NOT NULL THEN 1 ELSE 0 END" for c, s in zip("abc", ("sig_avdp", "sig_aadp", "sig_ahdp"), strict=True))
_agreed = " + ".join(f"CASE WHEN {c} IS NOT NULL AND {s} IS NOT NULL AND list_contains({c}, {s}) THEN 1 ELSE 0 END" for c, s in zip("abc", ("sig_avdp", "sig_aadp", "sig_ahdp"), strict=True))
_against = " OR ".join(f"coalesce({s} = 'down' AND {c} = ['up'], false)" for c, s in zip("abc", ("sig_avdp", "sig_aadp", "sig_ahdp"), strict=True))
define("run_signatures", f"""
SELECT trigger_id, mechanism, CASE WHEN {_judged} = 0 THEN 'unknown' WHEN {_against} THEN 'conflict' WHEN {_agreed} = {_judged} AND {_judged} >= 2 THEN 'matched' ELSE 'partial' END AS status
FROM run_observed JOIN mechanism_signatures ON way = direction OR way = 'BOTH'
""")
define("mechanism_ranks", """
SELECT * FROM (SELECT direction, extent, timing, mechanism, row_number() OVER (PARTITION BY direction, extent, timing ORDER BY way = 'BOTH', NOT timely, place) AS rank FROM (
 SELECT d.direction, m.extent, t.timing, m.way, m.mechanism, m.place, EXISTS (SELECT 1 FROM mechanism_times x WHERE x.mechanism = m.mechanism AND x.timing = t.timing) AS timely
 FROM mechanism_extents m JOIN (VALUES ('OVER'), ('UNDER')) d(direction) ON m.way = d.direction OR m.way = 'BOTH'
 JOIN (VALUES ('consecutive'), ('periodic'), ('repeated'), ('sporadic')) t(timing) ON true)) WHERE rank <= 3
""")
_rules = [
    ("spi_false_alarm_gate", 10, 0, "'spi_false_alarm_review'", "validity = 'spi_suspect'", "'spi_false_call'", "0.85", "1"),
    ("parameter_recovery", 20, 0, "'parameter_recovery'", "recovery = 'recovered' AND recovery_parameters <> ''", "'parameter_mismatch'", "0.85", "1"),
    ("parameter_drift", 21, 0, "'snapoff_parameter_drift'", "drifted_parameters LIKE '%snapoff%'", "'poor_release'", "0.75", "CASE WHEN cross_model THEN 0.8 ELSE 1 END"),
    ("parameter_drift", 21, 3, "'parameter_drift'", "list_contains(string_split(drifted_parameters, ','), 'printspeed')", "'parameter_mismatch'", "0.75", "CASE WHEN cross_model THEN 0.8 ELSE 1 END"),
    ("periodic_recurrence", 30, 0, "'periodic_maintenance_cycle'", "periodic", "'cleaning_cycle_mismatch'", "0.80",
     "CASE WHEN abs(periodic_gap - greatest(round_even(periodic_gap / 3, 0), 1) * 3) <= CAST(0.2 AS DOUBLE) * 3 THEN 1.15 ELSE 1 END"),
    ("scope_prior", 50, 0, "lower(direction) || '_' || category", "validity <> 'spi_suspect'",
     "CASE category WHEN 'board_wide' THEN CASE direction WHEN 'OVER' THEN 'paste_rheology_drift' ELSE 'supply_interruption' END WHEN 'local_area' THEN "
     "CASE direction WHEN 'OVER' THEN 'poor_gasketing' ELSE 'aperture_clogging' END ELSE CASE direction WHEN 'OVER' THEN 'understencil_residue' ELSE 'aperture_clogging' END END",
     "CASE WHEN category IN ('single_pad', 'component_multi_pad') THEN 0.70 ELSE 0.65 END", "1"),
    ("trend_shape", 60, 0, "'trend_' || trend_kind", "trend_kind = 'gradual' OR (trend_kind = 'step' AND drifted_parameters = '')", "NULL", "0.60", "1"),
]
define("run_nominated", " UNION ALL ".join(
    f"""SELECT trigger_id, direction, spatial, '{step}' AS step, {order} AS step_order, {place} AS place, {rule} AS rule, {mechanism} AS mechanism,
 CAST({prior} AS DECIMAL(4, 2)) AS prior, CAST({factor} AS DECIMAL(4, 2)) AS factor FROM run_observed WHERE {fires}
""" for step, order, place, rule, fires, mechanism, prior, factor in _rules) + """ UNION ALL
SELECT trigger_id, o.direction, o.spatial, 'mechanism_projection', 70, rank, 'projected_' || mechanism, mechanism, CAST(0.45 AS DECIMAL(4, 2)), CAST(1 AS DECIMAL(4, 2))
FROM run_observed o JOIN mechanism_ranks r ON r.direction = o.direction AND r.extent = o.spatial AND r.timing = o.temporal
""")
define("run_any_signature", f"""
SELECT trigger_id, mechanism, CASE WHEN {_judged} = 0 THEN 'unknown' WHEN {_against} THEN 'conflict' WHEN {_agreed} = {_judged} AND {_judged} >= 2 THEN 'matched' ELSE 'partial' END AS status
FROM run_observed JOIN mechanism_signatures ON true
""")
define("run_candidates", """
SELECT *, CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level, coalesce(mechanism, rule) AS cause FROM (
 SELECT n.trigger_id, step, step_order, place, rule, n.mechanism, coalesce(status, 'unknown') AS signature_match,
  least(CAST(round(CAST(prior AS DECIMAL(18, 8)) * factor * CASE status WHEN 'matched' THEN 1.2 WHEN 'conflict' THEN 0.7 ELSE 1.0 END
   * CASE WHEN n.mechanism IS NULL OR n.mechanism = 'undetermined' THEN 1.0 WHEN EXISTS (SELECT 1 FROM mechanism_extents e WHERE e.mechanism = n.mechanism AND e.extent = n.spatial) THEN 1.1
     ELSE 0.9 END, 3) AS DECIMAL(6, 3)), 0.95) AS confidence
 FROM run_nominated n LEFT JOIN run_any_signature s ON s.trigger_id = n.trigger_id AND s.mechanism = n.mechanism)
""")
define("run_assessed", """
SELECT * EXCLUDE (of_cause, cause_rank), CASE WHEN cause_rank <= 3 AND of_cause = 1 THEN cause_rank END AS priority,
 CASE WHEN cause_rank > 3 THEN 'not_in_top' WHEN of_cause > 1 THEN 'same_cause' END AS eliminated FROM (
 SELECT *, dense_rank() OVER (PARTITION BY trigger_id ORDER BY lead_key) AS cause_rank FROM (
  SELECT *, first_value((-confidence, step_order, place, rule)) OVER w AS lead_key, row_number() OVER w AS of_cause
  FROM run_candidates WINDOW w AS (PARTITION BY trigger_id, cause ORDER BY confidence DESC, step_order, place, rule)))
""")
define("run_overall", """
SELECT trigger_id, CASE WHEN data_status <> 'pass' THEN 'LOW' WHEN level = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END AS overall
FROM run_observed JOIN (SELECT trigger_id, level FROM run_assessed WHERE priority = 1) USING (trigger_id)
""")
define("mechanism_checks", """
SELECT * FROM (VALUES ('aperture_clogging', 'trend_slope'), ('aperture_clogging', 'cleaning_marker'), ('poor_release', 'parameter_drift'), ('understencil_residue', 'trend_slope'),
 ('understencil_residue', 'cleaning_marker'), ('paste_rheology_drift', 'trend_slope'), ('parameter_mismatch', 'parameter_drift'), ('parameter_mismatch', 'recovery'),
 ('squeegee_one_side', 'print_direction_split'), ('cleaning_cycle_mismatch', 'periodic_recurrence'), ('cleaning_cycle_mismatch', 'cleaning_frequency_reference'),
 ('cleaning_cycle_mismatch', 'cleaning_marker'), ('alignment_offset', 'mark_deviation_trend'), ('spi_false_call', 'spi_metric_mismatch')) m(mechanism, c)
""")
define("run_auto", """
SELECT trigger_id, mechanism, c, CASE c WHEN 'mark_deviation_trend' THEN 'planned' WHEN 'cleaning_marker' THEN 'not_collected' WHEN 'print_direction_split' THEN 'not_collected'
 ELSE CASE WHEN CASE c WHEN 'trend_slope' THEN trend_kind = 'gradual' WHEN 'parameter_drift' THEN drifted_parameters <> '' WHEN 'recovery' THEN recovery = 'recovered' AND recovery_parameters <> ''
  WHEN 'periodic_recurrence' THEN periodic WHEN 'spi_metric_mismatch' THEN validity = 'spi_suspect'
  ELSE coalesce(abs(periodic_gap - greatest(round_even(periodic_gap / 3, 0), 1) * 3) <= CAST(0.2 AS DOUBLE) * 3, false) END THEN 'passed' ELSE 'not_seen' END END AS status
FROM run_assessed JOIN run_observed USING (trigger_id) JOIN mechanism_checks USING (mechanism) WHERE run_assessed.priority IS NOT NULL
UNION ALL
SELECT trigger_id, mechanism, 'metric_signature', CASE signature_match WHEN 'matched' THEN 'passed' WHEN 'conflict' THEN 'mismatch' ELSE 'not_seen' END
FROM run_assessed WHERE priority IS NOT NULL AND signature_match <> 'unknown' AND mechanism IS NOT NULL
""")
