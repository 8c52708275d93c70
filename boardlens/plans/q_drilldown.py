"""Queries: parameters, evidence around triggers, observation and diagnosis."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

import boardlens.plans.oracle.drilldown  # noqa: F401
from boardlens.functions.stats import r6
from boardlens.operators import diagnosis as G
from boardlens.operators import drilldown as D
from boardlens.operators import events as E
from boardlens.operators import evidence as V
from boardlens.operators import mechanisms as M
from boardlens.operators import parameters as P
from boardlens.operators import runs as U
from boardlens.operators.inspections import inspection_sizes, monitor_points, pad_points
from boardlens.functions.scalars import component_of, pad_of
from boardlens.operators import dashboard as B
from boardlens.operators import drift
from boardlens.operators.inspections import inspections
from boardlens.plans import q_drift, q_events, q_runs
from boardlens.plans.q_rules import _earlier, abnormal_results
from boardlens.plans.oracle import define
from boardlens.plans.registry import query, rows, shared
from boardlens.session import settled


@shared
def tables(spark, sf):
    return Drilldown(spark, sf)


class Drilldown:
    """Tables around all trigger runs of one folder; each is settled when first used."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def rows(self):
        return rows(self.spark, self.sf)

    @cached_property
    def points(self):
        return q_runs.points(self.spark, self.sf)

    @cached_property
    def runs(self):
        return q_runs.tables(self.spark, self.sf)[1]

    @cached_property
    def triggers(self):
        return q_runs.triggers(self.spark, self.sf)

    @cached_property
    def window(self):
        return q_runs.evidence(self.spark, self.sf)[0]

    @cached_property
    def main(self):
        found = U.run_main_defect(self.triggers, q_runs.tables(self.spark, self.sf)[0])
        over = F.when(F.col("direction") == "OVER", "OVER").otherwise("UNDER")
        return settled(found.select("trigger_id", "metric", over.alias("direction")), "run-metrics")

    @cached_property
    def metric(self):
        return self.main.select("trigger_id", "metric")

    @cached_property
    def stats(self):
        return settled(V.metric_stats(self.window), "run-stats")

    @cached_property
    def siblings(self):
        return settled(D.siblings(self.window, self.rows, self.metric), "siblings")

    @cached_property
    def scopes(self):
        return D.scope(self.window, inspection_sizes(self.rows), self.siblings)

    @cached_property
    def changes(self):
        return settled(P.setpoint_changes(self.window, self.rows), "setpoint-changes")

    @cached_property
    def recovered(self):
        return settled(P.recovery(self.window, self.triggers, self.stats, self.metric, self.changes), "recovery")

    @cached_property
    def kinds(self):
        return settled(V.change_type(self.window, self.stats, self.metric), "change-types")

    @cached_property
    def full(self):
        return settled(D.full_window(self.window, self.rows, self.main), "full-windows")

    @cached_property
    def checks(self):
        return settled(D.exclusion_checks(self.window, self.metric, self.kinds, self.recovered), "exclusion-checks")

    @cached_property
    def periods(self):
        return self.triggers.select("trigger_id", *U.SERIES).join(U.periodicity(self.runs), U.SERIES)

    @cached_property
    def drifts(self):
        return settled(P.parameter_check(self.rows, self.window.where("is_trigger").select(
            F.col("trigger_id").alias("group_id"), "cmodel", "barcode")), "trigger-parameters")

    @cached_property
    def axes(self):
        return D.classified(self.scopes, D.context_summary(self.full), D.local_area(self.full), self.checks, self.periods)

    @cached_property
    def observed(self):
        return settled(D.observation(
            self.triggers, self.main, self.axes, self.kinds, V.metric_signature(self.stats), self.drifts, self.recovered, self.periods, self.checks,
            D.cleaning_frequencies(self.rows)), "observations")

    @cached_property
    def candidates(self):
        return settled(G.nominations(self.observed), "candidates")

    @cached_property
    def assessed(self):
        return settled(G.assessed(self.candidates), "assessments")


@query("parameter_check", """
SELECT group_id AS event_id, parameter, cross_model, round(group_max, 6) AS group_max, round(baseline_max, 6) AS baseline_max, drifted FROM event_parameters""")
def parameter_check(spark, sf):
    base, _, members = q_events.tables(spark, sf)
    groups = members.select(F.col("event_id").alias("group_id"), F.col("model").alias("cmodel"), "barcode")
    return P.parameter_check(base, groups).withColumnRenamed("group_id", "event_id").withColumns({c: r6(c) for c in ("group_max", "baseline_max")})


@query("trigger_parameters", """
SELECT group_id AS trigger_id, parameter, cross_model, round(group_max, 6) AS group_max, round(baseline_max, 6) AS baseline_max, drifted FROM trigger_parameter_rows""")
def trigger_parameters(spark, sf):
    return tables(spark, sf).drifts.withColumnRenamed("group_id", "trigger_id").withColumns({c: r6(c) for c in ("group_max", "baseline_max")})


@query("setpoint_changes", "SELECT trigger_id, seq, barcode, fdate, parameter, from_value, to_value FROM setpoint_moves")
def setpoint_changes(spark, sf):
    return tables(spark, sf).changes


@query("recovery", "SELECT trigger_id, boards_after, recovered_seq, recovery, recovery_parameters FROM run_recovery")
def recovery(spark, sf):
    return tables(spark, sf).recovered.select(
        "trigger_id", "boards_after", "recovered_seq", "recovery", F.array_join("recovery_parameters", ",").alias("recovery_parameters"))


@query("sibling_series", "SELECT trigger_id, sibling, seq, is_trigger, ng, round(value, 6) AS value FROM run_siblings")
def sibling_series(spark, sf):
    return tables(spark, sf).siblings.withColumn("value", r6("value"))


@query("trigger_scope", "SELECT trigger_id, round(max_share, 6) AS max_board_ng_share, ng_siblings, scope FROM run_scope")
def trigger_scope(spark, sf):
    return tables(spark, sf).scopes.withColumn("max_board_ng_share", r6("max_board_ng_share"))


@query("pad_heatmap", """
SELECT trigger_id, p.compname, round(px, 6) AS px, round(py, 6) AS py, coalesce(hit, 0) AS trigger_ng_count, coalesce(n, 0) AS trigger_board_count, history_ng_count
FROM (SELECT DISTINCT trigger_id, cmodel FROM run_triggers) t
JOIN (SELECT cmodel, compname, avg(comp_px) AS px, avg(comp_py) AS py, count(*) FILTER (ng) AS history_ng_count FROM rows_ng GROUP BY ALL) p USING (cmodel)
LEFT JOIN (SELECT trigger_id, r.compname, count(*) FILTER (r.ng) AS hit, count(*) AS n FROM run_points w JOIN rows_ng r ON r.cmodel = w.cmodel AND r.barcode = w.barcode AND r.fdate = w.fdate
 WHERE w.is_trigger GROUP BY ALL) USING (trigger_id, compname)""")
def pad_heatmap(spark, sf):
    d = tables(spark, sf)
    return D.heat_map(d.window, d.rows).withColumns({c: r6(c) for c in ("px", "py")})


@query("param_series", """
SELECT trigger_id, parameter, place, seq, round(actual, 6) AS actual, round("plan", 6) AS "plan", round(diff, 6) AS diff FROM run_parameters JOIN (
 SELECT trigger_id, parameter, row_number() OVER (PARTITION BY trigger_id ORDER BY count(DISTINCT round(actual, 4)) DESC, parameter) AS place
 FROM run_parameters GROUP BY trigger_id, parameter) USING (trigger_id, parameter)""")
def param_series(spark, sf):
    d = tables(spark, sf)
    out = D.parameter_series(d.window, d.rows).withColumns({c: r6(c) for c in ("actual", "plan", "diff")})
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("full_window", "SELECT trigger_id, row_id, place, is_trigger_row, is_same_component, is_same_pad FROM run_rows")
def full_window(spark, sf):
    return tables(spark, sf).full.select("trigger_id", "row_id", "place", "is_trigger_row", "is_same_component", "is_same_pad")


@query("context_summary", """
SELECT trigger_id, count(*) AS total_rows, count(*) FILTER (ng) AS ng_rows, count(*) FILTER (ng AND is_same_direction) AS same_direction_ng_rows,
 count(*) FILTER (ng AND is_same_component) AS same_component_ng_rows, count(*) FILTER (ng AND is_same_pad) AS same_pad_ng_rows,
 count(*) FILTER (on_trigger_board) AS trigger_board_rows, count(*) FILTER (ng AND on_trigger_board) AS trigger_board_ng_rows,
 round(count(*) FILTER (ng) / count(*), 6) AS ng_rate FROM run_rows GROUP BY trigger_id""")
def context_summary(spark, sf):
    return D.context_summary(tables(spark, sf).full).withColumn("ng_rate", r6("ng_rate"))


@query("context_top", """
SELECT * FROM (SELECT trigger_id, kind, name, count(*) AS n, row_number() OVER (PARTITION BY trigger_id, kind ORDER BY count(*) DESC, name) AS place FROM (
 SELECT trigger_id, unnest(['defect', 'component', 'pad']) AS kind, unnest([comp_errname, regexp_extract(compname, '^(.+)_[0-9]+$', 1), compname]) AS name FROM run_rows WHERE ng)
 GROUP BY trigger_id, kind, name) WHERE place <= 5""")
def context_top(spark, sf):
    return D.context_top(tables(spark, sf).full).withColumn("place", F.col("place").cast("bigint"))


@query("local_area", """
SELECT trigger_id, ng_rows, ng_pads, round(x_share, 6) AS x_share, round(y_share, 6) AS y_share, local_area FROM run_areas""")
def local_area(spark, sf):
    return D.local_area(tables(spark, sf).full).withColumns({c: r6(c) for c in ("x_share", "y_share")})


@query("exclusion_checks", "SELECT trigger_id, data_flags, data_status, alarm_flags, alarm_status FROM run_checks")
def exclusion_checks(spark, sf):
    return tables(spark, sf).checks.withColumns({c: F.array_join(c, ",") for c in ("data_flags", "alarm_flags")})


@query("classify_axes", "SELECT trigger_id, spatial, temporal, validity, category FROM run_axes")
def classify_axes(spark, sf):
    return tables(spark, sf).axes


@query("observation", """
SELECT trigger_id, direction, category, spatial, temporal, validity, trend_kind, sig_avdp, sig_aadp, sig_ahdp, drifted_parameters, cross_model, recovery, recovery_parameters,
 periodic, periodic_gap, cleaning_frequency, data_status, alarm_status FROM run_observed""")
def observation(spark, sf):
    return tables(spark, sf).observed.select(
        "trigger_id", "direction", "category", "spatial", "temporal", "validity", "trend_kind", "sig_avdp", "sig_aadp", "sig_ahdp",
        F.array_join("drifted_parameters", ",").alias("drifted_parameters"), "cross_model", "recovery",
        F.array_join("recovery_parameters", ",").alias("recovery_parameters"), "periodic", "periodic_gap", "cleaning_frequency", "data_status", "alarm_status")


@query("signature_match", "SELECT trigger_id, mechanism, status FROM run_signatures")
def signature_match(spark, sf):
    return G.signature_match(tables(spark, sf).observed)


@query("nominate_candidates", """
SELECT trigger_id, step, CAST(step_order AS BIGINT) AS step_order, CAST(place AS BIGINT) AS place, rule, mechanism, signature_match, CAST(confidence AS DOUBLE) AS confidence, level FROM run_candidates""")
def nominate_candidates(spark, sf):
    return tables(spark, sf).candidates.select(
        "trigger_id", "step", F.col("step_order").cast("bigint").alias("step_order"), F.col("place").cast("bigint").alias("place"), "rule", "mechanism",
        "signature_match", F.col("confidence").cast("double").alias("confidence"), "level")


@query("diagnose", """
SELECT trigger_id, cause, rule, CAST(confidence AS DOUBLE) AS confidence, level, CAST(priority AS BIGINT) AS priority, eliminated, overall FROM run_assessed JOIN run_overall USING (trigger_id)""")
def diagnose(spark, sf):
    d = tables(spark, sf)
    grades = G.overall(d.assessed, d.observed).select("trigger_id", F.col("confidence").alias("overall"))
    return d.assessed.join(grades, "trigger_id").select(
        "trigger_id", "cause", "rule", F.col("confidence").cast("double").alias("confidence"), "level", F.col("priority").cast("bigint").alias("priority"),
        "eliminated", "overall")


@query("decision_trace", """
SELECT o.trigger_id, step, CAST(step_order AS BIGINT) AS step_order, n IS NOT NULL AS fired, coalesce(n, 0) AS nominated, highest
FROM run_observed o JOIN (VALUES ('spi_false_alarm_gate', 10), ('parameter_recovery', 20), ('parameter_drift', 21), ('periodic_recurrence', 30), ('scope_prior', 50),
 ('trend_shape', 60), ('mechanism_projection', 70)) s(step, step_order) ON true
LEFT JOIN (SELECT trigger_id, step, count(*) AS n, CAST(max(confidence) AS DOUBLE) AS highest FROM run_candidates GROUP BY ALL) USING (trigger_id, step)""")
def decision_trace(spark, sf):
    d = tables(spark, sf)
    return G.decision_trace(d.candidates, d.observed).withColumns({
        "step_order": F.col("step_order").cast("bigint"), "highest": F.col("highest").cast("double")})


@query("auto_checks", """SELECT trigger_id, mechanism, c AS "check", status FROM run_auto""")
def auto_checks(spark, sf):
    d = tables(spark, sf)
    return G.auto_checks(d.assessed, d.observed)


@query("disposition", """
SELECT trigger_id, disposition, CASE disposition WHEN 'data_continuity_review' THEN 'P3' WHEN 'spi_program_review' THEN 'P2' WHEN 'immediate_field_check' THEN 'P1'
 WHEN 'halt_and_contain' THEN 'P1' WHEN 'confirm_primary_cause' THEN 'P2' ELSE 'P3' END AS priority FROM (
 SELECT trigger_id, CASE WHEN data_status <> 'pass' THEN 'data_continuity_review' WHEN alarm_status = 'suspect' THEN 'spi_program_review'
  WHEN category IN ('board_wide', 'component_multi_pad', 'local_area') THEN 'immediate_field_check' WHEN recovery = 'not_recovered' THEN 'halt_and_contain'
  WHEN overall = 'HIGH' THEN 'confirm_primary_cause' ELSE 'fast_single_point_check' END AS disposition FROM run_observed JOIN run_overall USING (trigger_id))""")
def disposition(spark, sf):
    d = tables(spark, sf)
    return G.disposition(d.observed, G.overall(d.assessed, d.observed))


@query("abnormal_causes", """
SELECT a.abnormal_id, CAST(coalesce(m.rank, 1) AS BIGINT) AS rank, coalesce(m.mechanism, 'observe_next_board') AS mechanism, CASE WHEN m.mechanism IS NULL THEN 0.35 ELSE 0.45 END AS confidence
FROM abnormal a LEFT JOIN (SELECT DISTINCT direction, extent, timing, rank, mechanism FROM mechanism_ranks) m
 ON a.abnormal_pattern <> 'SPORADIC' AND m.direction = a.defect_type
 AND m.extent = CASE a.abnormal_pattern WHEN 'POINT_REPEAT' THEN 'single_pad' WHEN 'BOARD_TREND' THEN 'board_wide' ELSE 'component_multi_pad' END
 AND m.timing = CASE a.abnormal_pattern WHEN 'POINT_REPEAT' THEN 'repeated' ELSE 'sporadic' END""")
def abnormal_causes(spark, sf):
    return M.abnormal_causes(abnormal_results(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("event_causes", """
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY way = 'BOTH', place) AS BIGINT) AS rank, mechanism, 0.45 AS confidence FROM (
 SELECT DISTINCT event_id, way, place, mechanism FROM event_heads JOIN mechanism_extents ON (way = direction OR way = 'BOTH')
  AND CASE scope WHEN 'BOARD_WIDE' THEN extent = 'board_wide' ELSE extent <> 'board_wide' END)
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY way = 'BOTH', place) <= 3""")
def event_causes(spark, sf):
    return M.event_causes(q_events.tables(spark, sf)[1]).withColumn("rank", F.col("rank").cast("bigint"))


@query("trigger_findings", """
SELECT trigger_id, CAST(row_number() OVER (PARTITION BY trigger_id ORDER BY k) - 1 AS BIGINT) AS place, finding, CAST(a AS BIGINT) AS from_seq, CAST(z AS BIGINT) AS to_seq FROM (
 SELECT trigger_id, 0 AS k, 'consecutive_failures' AS finding, 0 AS a, run_length - 1 AS z FROM run_triggers
 UNION ALL SELECT trigger_id, 1, 'change_' || change_type, CASE change_type WHEN 'gradual' THEN -least(usual, 20) WHEN 'step' THEN 0 END,
  CASE change_type WHEN 'gradual' THEN -1 WHEN 'step' THEN run_length - 1 END FROM run_change JOIN run_sizes USING (trigger_id) JOIN run_triggers USING (trigger_id)
 UNION ALL SELECT trigger_id, 2, 'extent_' || scope, NULL, NULL FROM run_scope
 UNION ALL SELECT trigger_id, 3, recovery, CASE recovery WHEN 'recovered' THEN recovered_seq WHEN 'not_recovered' THEN first_after END,
  CASE recovery WHEN 'recovered' THEN recovered_seq WHEN 'not_recovered' THEN last_made END FROM run_recovery JOIN run_sizes USING (trigger_id)
 UNION ALL SELECT group_id, 4, CASE WHEN bool_or(drifted) THEN 'parameters_drifted' ELSE 'parameters_normal' END, NULL, NULL FROM trigger_parameter_rows GROUP BY 1
 UNION ALL SELECT trigger_id, 5, CASE WHEN periodic THEN 'periodic' ELSE 'not_periodic' END, NULL, NULL FROM run_triggers JOIN pad_periods USING (cmodel, compname)
  JOIN (SELECT cmodel, compname, count(*) AS run_count FROM pad_runs GROUP BY ALL) USING (cmodel, compname) WHERE run_count >= 3
 UNION ALL SELECT trigger_id, 6, 'window_short', NULL, NULL FROM run_sizes WHERE "before" < 300 OR last - end_seq < 300)""")
def trigger_findings(spark, sf):
    d = tables(spark, sf)
    return D.trigger_findings(d.triggers, d.window, d.kinds, d.scopes, d.recovered, d.drifts, d.periods).withColumn("place", F.col("place").cast("bigint"))


@query("abnormal_trigger_badge", """
SELECT abnormal_id, trigger_id FROM abnormal LEFT JOIN (
 SELECT regexp_extract(compname, '^(.+)_[0-9]+$', 1) AS component, regexp_extract(compname, '_([0-9]+)$', 1) AS pad, arg_min(trigger_id, (cmodel, compname, start_pos)) AS trigger_id
 FROM run_triggers GROUP BY 1, 2) USING (component, pad)""")
def abnormal_trigger_badge(spark, sf):
    triggers = tables(spark, sf).triggers.withColumns({"component": component_of("compname"), "pad": pad_of("compname")})
    return B.trigger_badges(abnormal_results(spark, sf), triggers).select("abnormal_id", "trigger_id")


@query("label_to_concept", """
SELECT trigger_id, cause, CASE direction WHEN 'OVER' THEN 'defect.over_volume' ELSE 'defect.insufficient_volume' END AS direction_concept,
 CASE cause WHEN 'trend_gradual' THEN 'root_cause.cumulative_state_degradation' WHEN 'trend_step' THEN 'root_cause.discrete_process_change' ELSE 'mech.' || cause END AS cause_concept
FROM run_assessed JOIN run_way USING (trigger_id) WHERE priority IS NOT NULL""")
def label_to_concept(spark, sf):
    d = tables(spark, sf)
    rows_ = d.assessed.where("priority IS NOT NULL").join(d.main, "trigger_id").select("trigger_id", "cause", "direction")
    return M.label_to_concept(rows_, direction="direction", cause="cause").drop("direction")


@query("snapshot_new_ids", """
SELECT 'trigger' AS kind, trigger_id AS id FROM run_triggers t WHERE (SELECT count(*) FROM made_points p WHERE p.cmodel = t.cmodel AND p.compname = t.compname AND p.passes = t.passes
 AND p.ng AND p.ts < (SELECT cut FROM half_time)) < 3
UNION ALL SELECT 'alert', warning_id FROM drift_warnings WHERE page_alert AND warning_id NOT IN (
 SELECT warning_id FROM cut_episodes WHERE end_index IS NULL AND level >= 3 AND boards_above < 100)""")
def snapshot_new_ids(spark, sf):
    """Triggers and page alerts of today that a snapshot of the first half of the time did not show."""
    before = settled(_earlier(rows(spark, sf)), "earlier")
    failing = U.failing_points(pad_points(before))
    old_triggers = U.trigger_runs(U.ng_runs(failing))
    old_found = q_drift.walk_of(drift.watched_points(before), drift.ng_floors(monitor_points(before)), drift.DEFAULT)[1]

    def alerts(found):
        return drift.warnings(found).where("page_alert").select(F.lit("alert").alias("kind"), F.col("warning_id").alias("id"))

    def ids(triggers):
        return triggers.select(F.lit("trigger").alias("kind"), F.col("trigger_id").alias("id"))

    now = ids(tables(spark, sf).triggers).union(alerts(q_drift.found(spark, sf)[1]))
    return B.new_keys(now, ids(old_triggers).union(alerts(old_found)), ("kind", "id"))


define("run_sizes", """
SELECT trigger_id, any_value(end_seq) AS end_seq, -min(seq) AS "before", max(seq) AS last, count(*) FILTER (seq < 0 AND NOT ng AND NOT is_recheck) AS usual,
 min(seq) FILTER (NOT is_recheck AND NOT in_run AND seq > 0) AS first_after, max(seq) FILTER (NOT is_recheck) AS last_made FROM run_points GROUP BY 1
""")
