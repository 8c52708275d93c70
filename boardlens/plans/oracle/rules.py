"""Shared expressions for abnormals and cases."""

import boardlens.plans.oracle.base  # noqa: F401
from boardlens.plans.oracle import define

define("abn_raw", """
SELECT row_id, ts, work_order, cmodel AS product_name, barcode AS board_sn, fdate AS inspect_time, machinename AS machine,
 regexp_extract(compname, '^(.+)_[0-9]+$', 1) AS component, regexp_extract(compname, '_([0-9]+)$', 1) AS pad, total_pads,
 CASE WHEN comp_errname = 'Over Volume' OR comp_errname = 'AREAOVER' THEN 'OVER' ELSE 'UNDER' END AS defect_type,
 CASE comp_errname WHEN 'AREAOVER' THEN 'area' WHEN 'Under Height' THEN 'height' ELSE 'volume' END AS main_metric,
 CASE comp_errname WHEN 'AREAOVER' THEN comp_aadp WHEN 'Under Height' THEN comp_ahdp ELSE comp_avdp END AS deviation_percent
FROM firsts WHERE ng
""")
define("abn_no", """
SELECT *, printf('ABN%012d', row_number() OVER (ORDER BY ts, board_sn, component, pad, row_id)) AS abnormal_id FROM abn_raw
""")
define("abn_counts", """
SELECT a.*, CASE WHEN total_pads > 0 THEN (count(*) OVER (PARTITION BY board_sn)) / total_pads ELSE 0 END AS board_abnormal_ratio,
 r.repeat_count, p.pads_n
FROM abn_no a
JOIN (SELECT work_order, product_name, component, pad, defect_type, count(DISTINCT board_sn) AS repeat_count FROM abn_no GROUP BY ALL) r
  USING (work_order, product_name, component, pad, defect_type)
JOIN (SELECT board_sn, component, defect_type, count(DISTINCT pad) AS pads_n FROM abn_no GROUP BY ALL) p
  USING (board_sn, component, defect_type)
""")
define("abnormal", """
SELECT *, CASE WHEN repeat_count >= 3 THEN 'POINT_REPEAT' WHEN board_abnormal_ratio >= 0.05 THEN 'BOARD_TREND'
  WHEN pads_n >= 2 THEN 'COMPONENT_MULTI_PAD' ELSE 'SPORADIC' END AS abnormal_pattern,
 CASE WHEN repeat_count >= 3 OR board_abnormal_ratio >= 0.10 THEN 'HIGH'
  WHEN board_abnormal_ratio >= 0.05 OR pads_n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN repeat_count >= 3 OR board_abnormal_ratio >= 0.05 THEN 1 ELSE pads_n END AS affected_pad_count
FROM abn_counts
""")
define("case_rows", """
SELECT *, CASE abnormal_pattern WHEN 'POINT_REPEAT' THEN component || '/' || pad
  WHEN 'COMPONENT_MULTI_PAD' THEN board_sn || '/' || component ELSE board_sn END AS gkey
FROM abnormal WHERE risk_level <> 'LOW'
""")
define("cases", """
SELECT printf('CASE%012d', row_number() OVER (ORDER BY min(abnormal_id))) AS case_id, work_order, product_name, defect_type, abnormal_pattern, gkey,
 count(*) AS abnormal_count, min(abnormal_id) AS first_abnormal, max(abnormal_id) AS last_abnormal,
 arg_max(board_sn, abnormal_id) AS board_sn, arg_max(machine, abnormal_id) AS machine,
 CASE WHEN min(component) = max(component) THEN arg_max(component, abnormal_id) ELSE 'MULTI' END AS component,
 CASE WHEN min(pad) = max(pad) THEN arg_max(pad, abnormal_id) ELSE 'MULTI' END AS pad,
 arg_max(component, abnormal_id) AS l_component, arg_max(pad, abnormal_id) AS l_pad, arg_max(main_metric, abnormal_id) AS l_metric,
 arg_max(board_abnormal_ratio, abnormal_id) AS l_ratio, arg_max(risk_level, abnormal_id) AS risk_level,
 arg_min(inspect_time, abnormal_id) AS first_inspect_time, arg_max(inspect_time, abnormal_id) AS latest_inspect_time
FROM case_rows GROUP BY work_order, product_name, defect_type, abnormal_pattern, gkey
""")
define("worked_cases", """
SELECT *, CASE CAST(substr(case_id, 5) AS BIGINT) % 7 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'IGNORED' WHEN 2 THEN 'RECURRED' ELSE 'OPEN' END AS status,
 CASE CAST(substr(case_id, 5) AS BIGINT) % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'NG' ELSE 'NOT_RECHECKED' END AS recheck_result,
 CAST(substr(case_id, 5) AS BIGINT) % 5 = 0 AS effective FROM cases
""")
define("half_time", "SELECT min(ts) + (max(ts) - min(ts)) / 2 AS cut FROM spi")
