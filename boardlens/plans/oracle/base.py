"""Shared expressions: the inspection view and what most operators start from."""

from boardlens.plans.oracle import define

define("lines", """
SELECT l_orderkey AS k, l_quantity AS q, l_discount AS disc, l_tax AS tax,
       row_number() OVER (PARTITION BY l_orderkey
                          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pi,
       count(*) OVER (PARTITION BY l_orderkey) AS n_pads
FROM lineitem
""")
define("copies", """
SELECT *, 0 AS insp FROM lines UNION ALL SELECT *, 1 AS insp FROM lines WHERE k % 41 = 0
""")
define("flagged", """
SELECT *, (n_pads >= 10 AND k % 3 = 0) AS wide, (pi = 1 AND k % 613 BETWEEN 100 AND 104) AS burst,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(7 * k + 45 * (k // 50) + 5 * insp) AS ts
FROM copies
""")
define("judged", """
SELECT *, CASE WHEN insp = 1 AND k % 82 = 0 THEN 'PASS'
               WHEN burst THEN 'Over Volume'
               WHEN wide THEN 'Under Height'
               WHEN q >= 48 AND disc >= CAST(0.08 AS DOUBLE) THEN
                    CASE WHEN tax < CAST(0.03 AS DOUBLE) THEN 'AREAOVER'
                         WHEN tax < CAST(0.06 AS DOUBLE) THEN 'Over Volume'
                         ELSE 'Under_Volume' END
               ELSE 'PASS' END AS comp_errname
FROM flagged
""")
define("spi", """
SELECT k * 1000 + pi * 10 + insp AS row_id,
       printf('B%06d', k) AS barcode,
       'M' || (k // 500 % 3) AS cmodel,
       'W' || (k // 100) AS work_order,
       'L' || (k // 2000 % 2) AS machinename,
       ts,
       strftime(ts, '%Y/%-m/%-d %-H:%M') AS fdate,
       'C' || ((pi - 1) // 2) || '_' || ((pi - 1) % 2 + 1) AS compname,
       comp_errname,
       CAST(10 AS DOUBLE) + q / CAST(5 AS DOUBLE)
         + CASE WHEN burst THEN CAST(60 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         + CASE WHEN pi = 2 AND k % 1500 BETWEEN 1000 AND 1100
                THEN CAST(k % 1500 - 1000 AS DOUBLE) / CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
         + CASE WHEN comp_errname <> 'PASS' THEN CAST(25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS comp_avdp,
       CAST(8 AS DOUBLE) + CAST(50 AS DOUBLE) * tax
         + CASE WHEN comp_errname <> 'PASS' THEN CAST(20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS comp_aadp,
       CAST(6 AS DOUBLE) + CAST(40 AS DOUBLE) * disc AS comp_ahdp,
       CAST((pi - 1) % 4 * 10 + 5 AS DOUBLE) AS comp_px,
       CAST((pi - 1) // 4 * 10 + 5 AS DOUBLE) AS comp_py,
       CAST(40 + 5 * (k // 700 % 2) AS DOUBLE) AS printspeed_plan,
       CAST(40 + 5 * (k // 700 % 2) AS DOUBLE) + CAST(k % 7 AS DOUBLE) / CAST(100 AS DOUBLE) AS printspeed,
       CAST(k % 7 AS DOUBLE) / CAST(100 AS DOUBLE) AS diff_printspeed,
       CAST(k % 7 AS DOUBLE) / CAST(100 AS DOUBLE)
         + CASE WHEN k % 613 BETWEEN 100 AND 104 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS abs_printspeed,
       CAST(2 AS DOUBLE) AS snapoffspeed_plan,
       CAST(2 AS DOUBLE) + CAST(k % 5 AS DOUBLE) / CAST(1000 AS DOUBLE) AS snapoffspeed,
       CAST(k % 5 AS DOUBLE) / CAST(1000 AS DOUBLE) AS diff_snapoffspeed,
       CAST(k % 5 AS DOUBLE) / CAST(1000 AS DOUBLE) AS abs_snapoffspeed,
       CAST(k % 3 AS DOUBLE) AS markdeviation_plan,
       CAST(5 + k % 2 AS DOUBLE) AS frontsqgpress,
       CAST(5 AS DOUBLE) AS rearsqgpress,
       'P' || (k // 900 % 2) AS printmode,
       CAST(3 AS DOUBLE) AS cleaningfrequency,
       CAST(0 AS DOUBLE) AS temperature,
       CAST(0 AS DOUBLE) AS humidity,
       CASE WHEN k % 2 = 0 THEN 'F' ELSE 'R' END AS printdirection,
       80 + 80 * (k % 2) AS total_pads
FROM judged
""")
define("rows_ng", "SELECT *, comp_errname <> 'PASS' AS ng FROM spi")
define("insp_base", """
SELECT barcode, fdate, min(ts) AS ts, arg_min(cmodel, row_id) AS model, arg_min(machinename, row_id) AS machine,
       count(*) AS row_count, count(*) FILTER (ng) AS ng_count,
       round(avg(comp_avdp), 9) AS avg_avdp, round(avg(comp_aadp), 9) AS avg_aadp, round(avg(comp_ahdp), 9) AS avg_ahdp,
       round(avg(comp_avdp) FILTER (NOT ng), 9) AS pass_avdp, round(avg(comp_aadp) FILTER (NOT ng), 9) AS pass_aadp,
       round(avg(comp_ahdp) FILTER (NOT ng), 9) AS pass_ahdp
FROM rows_ng GROUP BY barcode, fdate
""")
define("insp", """
SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY ts NULLS FIRST, fdate) > 1 AS is_recheck FROM insp_base
""")
define("firsts", """
SELECT r.* FROM rows_ng r JOIN insp i USING (barcode, fdate) WHERE NOT i.is_recheck
""")
define("key_norm", """
SELECT *, CASE WHEN comp_errname = 'AREAOVER' THEN 'over area'
               ELSE lower(replace(comp_errname, '_', ' ')) END AS dkey FROM rows_ng
""")
define("points", """
SELECT r.*, i.is_recheck, i.b_rows, i.b_ng,
       row_number() OVER (PARTITION BY r.cmodel, r.compname ORDER BY r.ts, r.barcode, r.fdate, r.row_id) - 1 AS pos
FROM rows_ng r JOIN (
  SELECT cmodel, barcode, fdate, count(*) AS b_rows, count(*) FILTER (ng) AS b_ng,
         row_number() OVER (PARTITION BY cmodel, barcode ORDER BY min(ts), fdate) > 1 AS is_recheck
  FROM rows_ng GROUP BY cmodel, barcode, fdate) i USING (cmodel, barcode, fdate)
""")
define("limits_view", """
SELECT *, cmodel AS product_name, barcode AS board_sn,
 regexp_extract(compname, '^(.+)_[0-9]+$', 1) AS component, regexp_extract(compname, '_([0-9]+)$', 1) AS pad,
 comp_avdp AS volume, CAST(40 AS DOUBLE) AS volume_upper, CAST(10.5 AS DOUBLE) AS volume_lower,
 comp_aadp AS area, CAST(11.9 AS DOUBLE) AS area_upper, CAST(8.1 AS DOUBLE) AS area_lower,
 comp_ahdp AS height, CAST(9.9 AS DOUBLE) AS height_upper, CAST(6.1 AS DOUBLE) AS height_lower FROM spi
""")
