"""Queries: stage datasets and the snapshot job."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.jobs import Snapshot, write_stage
from boardlens.operators import dashboard as B
from boardlens.operators import diagnosis as G
from boardlens.operators import drift as D
from boardlens.plans import q_drift, q_drilldown, q_events, q_rules, registry
from boardlens.plans.registry import query
from boardlens.session import new_folder


def anomaly_cases(spark, sf):
    results, cases = q_rules.case_tables(spark, sf)
    return {"abnormals": results, "cases": cases, "top_components": B.top_components(results)}


def param_analysis(spark, sf):
    _, events, members = q_events.tables(spark, sf)
    return {"events": events, "members": members}


def drilldown(spark, sf):
    d = q_drilldown.tables(spark, sf)
    return {"observations": d.observed, "assessments": d.assessed, "dispositions": G.disposition(d.observed, G.overall(d.assessed, d.observed))}


def early_warning(spark, sf):
    return {"warnings": D.warnings(q_drift.found(spark, sf)[1])}


STAGES = {"anomaly_cases": anomaly_cases, "param_analysis": param_analysis, "drilldown": drilldown, "early_warning": early_warning}


def snapshot(target: str, stages=None, fmt: str = "parquet") -> Snapshot:
    """The four analyses as one job, with tables of its own in place of those that the session's queries share."""
    return Snapshot(target, stages or STAGES, fmt, registry.SHARED)


@query("stage_sink", """
SELECT warning_id, cmodel, compname, CAST(level AS BIGINT) AS level, status, page_alert, boards_above, metrics FROM drift_warnings""")
def stage_sink(spark, sf):
    """Warnings written as JSON, with their lists, and read back."""
    df = D.warnings(q_drift.found(spark, sf)[1])
    folder = new_folder(spark, "stage-json")
    write_stage(df, folder, "json")
    back = spark.read.schema(df.schema).json(folder)
    return back.select("warning_id", *D.SERIES, F.col("level").cast("bigint").alias("level"), "status", "page_alert", "boards_above",
                       F.array_join("metrics", ",").alias("metrics"))


@query("snapshot_pipeline", """
SELECT 'anomaly_cases' AS stage, true AS ok, (SELECT count(*) FROM abnormal) + (SELECT count(*) FROM cases) + least((SELECT count(DISTINCT component) FROM abnormal), 10) AS "rows"
UNION ALL SELECT 'param_analysis', true, (SELECT count(*) FROM event_heads) + (SELECT count(*) FROM event_rows)
UNION ALL SELECT 'drilldown', true, 2 * (SELECT count(*) FROM run_observed) + (SELECT count(*) FROM run_assessed)
UNION ALL SELECT 'early_warning', true, (SELECT count(*) FROM drift_warnings)""")
def snapshot_pipeline(spark, sf):
    job = snapshot(new_folder(spark, "snapshots"))
    job.run(spark, sf, "000000000001")
    return job.published(spark).select("stage", "ok", "rows")
