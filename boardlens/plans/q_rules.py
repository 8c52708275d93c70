"""Queries: rules engine, cases, dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions.stats import r6
from boardlens.operators import dashboard as D
from boardlens.operators import rules as R
from boardlens.operators.inspections import first_inspection_rows, keyed, normalized
from boardlens.plans.registry import query, rows, shared
from boardlens.schema import RECENT_BOARDS
from boardlens.session import settled
from boardlens.sources.readers import recent_boards
from boardlens.sources.spi import limits_rows, spi_rows


def pad_totals(contract):
    return contract.groupBy("board_sn").agg(F.max("total_pads").alias("total_pads"))


@shared
def abnormal_rows(spark, sf):
    contract = normalized(first_inspection_rows(rows(spark, sf)), ())
    return settled(R.abnormals(contract), "abnormals")


@shared
def abnormal_results(spark, sf):
    found = abnormal_rows(spark, sf)
    return settled(R.classified(found, pad_totals(found)), "results")


@shared
def case_tables(spark, sf):
    results = abnormal_results(spark, sf)
    return results, settled(R.quality_cases(results), "cases")


def worked(cases):
    """Cases as the shop floor would have left them: some closed, some rechecked."""
    n = F.substring("case_id", 5, 20).cast("bigint")
    return cases.withColumns({
        "status": F.when(n % 7 == 0, "CLOSED").when(n % 7 == 1, "IGNORED").when(n % 7 == 2, "RECURRED").otherwise("OPEN"),
        "recheck_result": F.when(n % 3 == 0, "OK").when(n % 3 == 1, "NG").otherwise("NOT_RECHECKED"),
        "effective": n % 5 == 0,
    })


@query("abnormals", """
SELECT printf('ABN%012d', row_number() OVER (ORDER BY ts, board_sn, component, pad, row_id)) AS abnormal_id, row_id, defect AS defect_type,
 metric AS main_metric, v AS actual_value, u AS upper_limit, l AS lower_limit,
 round(CASE WHEN labelled THEN v ELSE round((v - (u + l) / 2) / ((u + l) / 2) * 100, 2) END, 6) AS deviation_percent
FROM (
 SELECT *, CASE metric WHEN 'volume' THEN volume WHEN 'area' THEN area ELSE height END AS v,
  CASE metric WHEN 'volume' THEN volume_upper WHEN 'area' THEN area_upper ELSE height_upper END AS u,
  CASE metric WHEN 'volume' THEN volume_lower WHEN 'area' THEN area_lower ELSE height_lower END AS l
 FROM (SELECT *, row_id // 1000 % 2 = 0 AND comp_errname <> 'PASS' AS labelled,
   CASE WHEN row_id // 1000 % 2 = 0 AND comp_errname <> 'PASS' THEN
     CASE comp_errname WHEN 'AREAOVER' THEN 'area' WHEN 'Under Height' THEN 'height' ELSE 'volume' END
    WHEN volume > volume_upper OR volume < volume_lower THEN 'volume' WHEN area > area_upper OR area < area_lower THEN 'area'
    WHEN height > height_upper OR height < height_lower THEN 'height' END AS metric,
   CASE WHEN row_id // 1000 % 2 = 0 AND comp_errname <> 'PASS' THEN
     CASE WHEN comp_errname IN ('Over Volume', 'AREAOVER') THEN 'OVER' ELSE 'UNDER' END
    WHEN volume > volume_upper THEN 'OVER' WHEN volume < volume_lower THEN 'UNDER'
    WHEN area > area_upper THEN 'SUSPECT_OVER' WHEN area < area_lower THEN 'SUSPECT_UNDER'
    WHEN height > height_upper THEN 'SUSPECT_OVER' WHEN height < height_lower THEN 'SUSPECT_UNDER' END AS defect
  FROM limits_view) WHERE defect IS NOT NULL)""")
def abnormals(spark, sf):
    spi = spi_rows(spark, sf)
    contract = limits_rows(spi).withColumn("ts", F.col("inspect_time"))
    return R.abnormals(contract).select(
        "abnormal_id", "row_id", "defect_type", "main_metric", "actual_value", "upper_limit", "lower_limit",
        r6("deviation_percent").alias("deviation_percent"))


@query("board_abnormal_ratio", "SELECT DISTINCT board_sn, round(board_abnormal_ratio, 6) AS board_abnormal_ratio FROM abnormal")
def board_abnormal_ratio(spark, sf):
    found = abnormal_rows(spark, sf)
    return R.board_ratio(found, pad_totals(found)).withColumn("board_abnormal_ratio", r6("board_abnormal_ratio"))


@query("point_repeat_count", "SELECT DISTINCT work_order, product_name, component, pad, defect_type, repeat_count FROM abnormal")
def point_repeat_count(spark, sf):
    return R.repeat_boards(abnormal_rows(spark, sf))


@query("component_pad_count", "SELECT abnormal_id, affected_pad_count FROM abnormal")
def component_pad_count(spark, sf):
    return abnormal_results(spark, sf).select("abnormal_id", "affected_pad_count")


@query("classify_pattern", """
SELECT abnormal_id, board_sn, component, pad, defect_type, main_metric, round(deviation_percent, 6) AS deviation_percent, abnormal_pattern, risk_level,
 CASE abnormal_pattern WHEN 'BOARD_TREND' THEN 'spatial.board_wide' WHEN 'COMPONENT_MULTI_PAD' THEN 'spatial.component_multi_pad' ELSE 'spatial.single_pad' END AS spatial,
 CASE abnormal_pattern WHEN 'POINT_REPEAT' THEN 'temporal.repeated' ELSE 'temporal.sporadic' END AS temporal FROM abnormal""")
def classify_pattern(spark, sf):
    return abnormal_results(spark, sf).select(
        "abnormal_id", "board_sn", "component", "pad", "defect_type", "main_metric",
        r6("deviation_percent").alias("deviation_percent"), "abnormal_pattern", "risk_level", "spatial", "temporal")


@query("quality_cases", """
SELECT case_id, work_order, product_name, defect_type, abnormal_pattern, board_sn, machine, component, pad, risk_level,
 first_inspect_time, latest_inspect_time, abnormal_count, first_abnormal, last_abnormal FROM cases""")
def quality_cases(spark, sf):
    return case_tables(spark, sf)[1].select(
        "case_id", "work_order", "product_name", "defect_type", "abnormal_pattern", "board_sn", "machine", "component", "pad",
        "risk_level", "first_inspect_time", "latest_inspect_time", "abnormal_count", "first_abnormal", "last_abnormal")


@query("case_members", """
SELECT case_id, abnormal_id, r.board_sn, r.component, r.pad FROM case_rows r
JOIN cases c USING (work_order, product_name, defect_type, abnormal_pattern, gkey)""")
def case_members(spark, sf):
    results, cases = case_tables(spark, sf)
    return R.case_members(results, cases)


@query("case_evidence", """
SELECT case_id, CASE abnormal_pattern
 WHEN 'POINT_REPEAT' THEN l_component || ' pad ' || l_pad || ' shows ' || defect_type || ' on ' || abnormal_count || ' boards, not necessarily consecutive; main metric ' || l_metric
 WHEN 'COMPONENT_MULTI_PAD' THEN board_sn || ': ' || abnormal_count || ' pads of ' || l_component || ' show ' || defect_type || ' at the same time'
 WHEN 'BOARD_TREND' THEN board_sn || ' shows a board-wide ' || defect_type || ' trend: ' || abnormal_count || ' points, ' || round(l_ratio * 100, 2) || '%'
 END AS evidence FROM cases""")
def case_evidence(spark, sf):
    return R.case_evidence(case_tables(spark, sf)[1])


@query("dashboard_summary", """
SELECT a.*, c.* FROM (SELECT count(*) AS abnormal_count, count(*) FILTER (defect_type LIKE '%OVER') AS more_solder_count,
 count(*) FILTER (defect_type LIKE '%UNDER') AS less_solder_count, count(*) FILTER (risk_level = 'HIGH') AS high_risk_count,
 count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_count, count(*) FILTER (risk_level = 'LOW') AS low_risk_count FROM abnormal) a,
 (SELECT count(*) FILTER (status NOT IN ('CLOSED', 'IGNORED')) AS open_case_count, count(*) AS case_count,
  count(*) FILTER (status = 'RECURRED') AS recurrence_count,
  round(count(*) FILTER (recheck_result = 'OK' OR (recheck_result = 'NG' AND effective)) / count(*) FILTER (recheck_result IN ('OK', 'NG')), 6) AS recheck_effective_rate
  FROM worked_cases) c""")
def dashboard_summary(spark, sf):
    results, cases = case_tables(spark, sf)
    return D.dashboard_summary(results, settled(worked(cases), "cases"))


@query("recheck_effective_rate", """
SELECT round(count(*) FILTER (recheck_result = 'OK' OR (recheck_result = 'NG' AND effective)) / count(*) FILTER (recheck_result IN ('OK', 'NG')), 6) AS recheck_effective_rate
FROM worked_cases""")
def recheck_effective_rate(spark, sf):
    return D.recheck_effective_rate(worked(case_tables(spark, sf)[1]))


def _top_sql(keys: str) -> str:
    return f"""
SELECT {keys}, CAST(sum(n) AS BIGINT) AS defect_count, arg_min(defect_type, printf('%012d', 1000000000 - n) || defect_type) AS main_defect_type
FROM (SELECT {keys}, defect_type, count(*) AS n FROM abnormal GROUP BY ALL) GROUP BY {keys} ORDER BY defect_count DESC, {keys} LIMIT 10"""


@query("top_components", _top_sql("component"))
def top_components(spark, sf):
    return D.top_components(abnormal_rows(spark, sf))


@query("top_pads", _top_sql("component, pad"))
def top_pads(spark, sf):
    return D.top_pads(abnormal_rows(spark, sf))


@query("top_products", _top_sql("product_name"))
def top_products(spark, sf):
    return D.top_products(abnormal_rows(spark, sf))


@query("top_patterns", "SELECT abnormal_pattern, count(*) AS defect_count FROM abnormal GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_patterns(spark, sf):
    return D.top_patterns(abnormal_results(spark, sf))


@query("top_case_locations", "SELECT component, pad, count(*) AS case_count FROM cases GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def top_case_locations(spark, sf):
    return D.top_case_locations(case_tables(spark, sf)[1])


@query("case_metrics", """
SELECT count(*) AS case_total, count(*) FILTER (status <> 'CLOSED') AS not_closed, count(*) FILTER (risk_level = 'HIGH') AS high_risk,
 count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk, count(*) FILTER (defect_type = 'OVER') AS over_cases,
 count(*) FILTER (defect_type = 'UNDER') AS under_cases, CAST(coalesce(sum(abnormal_count), 0) AS BIGINT) AS linked_abnormals FROM worked_cases""")
def case_metrics(spark, sf):
    return D.case_metrics(worked(case_tables(spark, sf)[1]))


def _earlier(df):
    """The rows an earlier snapshot would have held: the first half of the time range."""
    span = df.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    cut = span.select(((F.unix_micros("low") + F.unix_micros("high")) / 2).alias("cut"))
    return df.where(F.unix_micros("ts") < cut.scalar())


@query("snapshot_new_keys", """
SELECT board_sn, component, pad, inspect_time, defect_type FROM abn_raw
EXCEPT SELECT board_sn, component, pad, inspect_time, defect_type FROM abn_raw WHERE ts < (SELECT cut FROM half_time)""")
def snapshot_new_keys(spark, sf):
    base = rows(spark, sf)
    now = R.defects(normalized(first_inspection_rows(base), ()))
    before = R.defects(normalized(first_inspection_rows(_earlier(base)), ()))
    return D.new_keys(now, before).select(*D.ABNORMAL_KEY).distinct()


@query("metric_delta", """
SELECT metric, round(c, 6) AS current, round(p, 6) AS previous, CASE WHEN c <> p THEN round(c - p, 6) END AS delta FROM (
 UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS abnormal_count, CAST(count(*) FILTER (defect_type = 'OVER') AS DOUBLE) AS over_count,
  CAST(count(*) FILTER (defect_type = 'UNDER') AS DOUBLE) AS under_count, CAST(count(DISTINCT product_name) AS DOUBLE) AS product_count FROM abn_raw)
 ON COLUMNS(*) INTO NAME metric VALUE c) a FULL JOIN (
 UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS abnormal_count, CAST(count(*) FILTER (defect_type = 'OVER') AS DOUBLE) AS over_count,
  CAST(count(*) FILTER (defect_type = 'UNDER') AS DOUBLE) AS under_count, CAST(count(DISTINCT product_name) AS DOUBLE) AS product_count
  FROM abn_raw WHERE ts < (SELECT cut FROM half_time))
 ON COLUMNS(*) INTO NAME metric VALUE p) b USING (metric)""")
def metric_delta(spark, sf):
    base = rows(spark, sf)

    def summary(df):
        found = R.defects(normalized(first_inspection_rows(df), ()))
        return found.agg(
            F.count(F.lit(1)).alias("abnormal_count"),
            F.count_if(F.col("defect_type") == "OVER").alias("over_count"),
            F.count_if(F.col("defect_type") == "UNDER").alias("under_count"),
            F.count_distinct("product_name").alias("product_count"))

    return D.metric_delta(summary(base), summary(_earlier(base)))


@query("window_scope", """
SELECT CAST(3000 AS BIGINT) AS window_boards, least(count(DISTINCT barcode), 3000) AS loaded_boards, 'spi' AS source_table,
 count(DISTINCT barcode) >= 3000 AS show_scope FROM spi""")
def window_scope(spark, sf):
    return D.window_scope(recent_boards(spi_rows(spark, sf), RECENT_BOARDS), RECENT_BOARDS, "spi")
