"""Shared expressions for the drift monitor: the walk along every series as a recursion."""

import boardlens.plans.oracle.base  # noqa: F401
import boardlens.plans.oracle.rules  # noqa: F401
from boardlens.plans.oracle import define

define("watch_rows", """
SELECT cmodel, compname, ts, barcode, fdate, row_id, ng, comp_avdp, comp_aadp, comp_ahdp FROM firsts WHERE compname <> '' AND ts IS NOT NULL
UNION ALL
SELECT cmodel, '__board__', min(ts), barcode, fdate, min(row_id), bool_or(ng), round(avg(comp_avdp), 9), round(avg(comp_aadp), 9), round(avg(comp_ahdp), 9)
FROM firsts WHERE ts IS NOT NULL GROUP BY cmodel, barcode, fdate
""")
define("watch_floor", """
SELECT ts, min(low) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor_before FROM (
 SELECT ts, min(comp_avdp) FILTER (ng AND comp_avdp > 0) AS low FROM firsts WHERE ts IS NOT NULL GROUP BY ts)
""")
define("watch", """
SELECT w.*, f.floor_before, row_number() OVER (PARTITION BY cmodel, compname ORDER BY ts, barcode, fdate, row_id) - 1 AS idx,
 count(*) OVER (PARTITION BY cmodel, compname) AS boards FROM watch_rows w JOIN watch_floor f USING (ts)
""")
define("watch_series", "SELECT cmodel, compname, row_number() OVER (ORDER BY cmodel, compname) AS sid, boards, ng_count FROM (SELECT cmodel, compname, count(*) AS boards, count(*) FILTER (ng) AS ng_count FROM watch_rows GROUP BY cmodel, compname)")
define("watch_lanes", """
SELECT sid * 3 + m AS lane, CAST(0.2 AS DOUBLE) AS lam, CAST(4 AS DOUBLE) AS width, idx, ng, v FROM (
 SELECT sid, idx, ng, unnest([0, 1, 2]) AS m, unnest([comp_avdp, comp_aadp, comp_ahdp]) AS v FROM watch JOIN watch_series USING (cmodel, compname))
""")
define("grid_lanes", """
SELECT (pair * 100000 + sid) * 3 + m AS lane, CAST(pair // 3 + 1 AS DOUBLE) / CAST(10 AS DOUBLE) AS lam, CAST(5 + pair % 3 AS DOUBLE) / CAST(2 AS DOUBLE) AS width, idx, ng, v FROM (
 SELECT sid, idx, ng, unnest([0, 1, 2]) AS m, unnest([comp_avdp, comp_aadp, comp_ahdp]) AS v FROM watch JOIN watch_series USING (cmodel, compname)), range(9) p(pair)
""")


def walk(name: str, lanes: str) -> None:
    """The recursion over one table of lanes, by position; NULL values leave a lane as it is."""
    define(name, f"""
SELECT lane, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS mu, CAST(NULL AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS lim,
 false AS above, false AS crossed, 0 AS streak, 0 AS rise, CAST(NULL AS DOUBLE) AS last, CAST([] AS DOUBLE[]) AS base, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS q
FROM (SELECT DISTINCT lane FROM {lanes})
UNION ALL
SELECT lane, idx, CASE WHEN z1 IS NULL AND enough THEN mu2 ELSE z1 END, mu2, sd2, CASE WHEN learnt AND enough THEN mu2 + width * sd2 * sqrt(lam / (2.0 - lam)) ELSE lim END,
 above1, live AND above1, streak1, rise1, last1, base2, s2, q2
FROM (SELECT *, CASE WHEN learnt AND enough THEN s2 / n2 ELSE mu END AS mu2,
  CASE WHEN learnt AND enough THEN greatest(sqrt(greatest(q2 / n2 - (s2 / n2) * (s2 / n2), 0.0)), 0.01) ELSE sd END AS sd2
 FROM (SELECT *, len(base2) AS n2, len(base2) >= 30 AS enough
  FROM (SELECT *, CASE WHEN NOT learnt THEN base WHEN len(base) >= 200 THEN list_append(base[2:], v) ELSE list_append(base, v) END AS base2,
    CASE WHEN NOT learnt THEN s WHEN len(base) >= 200 THEN s + v - base[1] ELSE s + v END AS s2,
    CASE WHEN NOT learnt THEN q WHEN len(base) >= 200 THEN q + v * v - base[1] * base[1] ELSE q + v * v END AS q2
   FROM (SELECT *, v IS NOT NULL AND NOT above1 AND NOT ng AS learnt, CASE WHEN live THEN CASE WHEN above1 THEN streak + 1 ELSE 0 END ELSE streak END AS streak1
    FROM (SELECT *, CASE WHEN live THEN z1 > lim ELSE above END AS above1
     FROM (SELECT e.* EXCLUDE (idx), l.idx, l.v, l.ng, l.lam, l.width, l.v IS NOT NULL AND e.z IS NOT NULL AS live,
       CASE WHEN l.v IS NOT NULL AND e.z IS NOT NULL THEN l.lam * l.v + (1.0 - l.lam) * e.z ELSE e.z END AS z1,
       CASE WHEN l.v IS NULL THEN e.rise WHEN coalesce(l.v > e.last, false) THEN e.rise + 1 ELSE 0 END AS rise1, coalesce(l.v, e.last) AS last1
      FROM {name} e JOIN {lanes} l ON l.lane = e.lane AND l.idx = e.idx + 1))))))
""", recursive=True)


def alarms(walked: str, prefix: str, watch: str = "watch", series: str = "watch_series") -> None:
    """Levels of crossing boards and the episodes they form, of one recursion."""
    define(f"{prefix}_levels", f"""
SELECT *, CASE WHEN (longest >= 3 OR n_metrics >= 2) AND (rising OR (volume AND coalesce(comp_avdp >= floor_before, false))) THEN 3
 WHEN longest >= 3 OR n_metrics >= 2 THEN 2 ELSE 1 END AS level
FROM (SELECT lane // 300000 AS pair, lane // 3 % 100000 AS sid, idx, count(*) AS n_metrics, max(streak) AS longest, bool_or(rise >= 3) AS rising, bool_or(lane % 3 = 0) AS volume,
  bool_or(lane % 3 = 1) AS area, bool_or(lane % 3 = 2) AS height FROM {walked} WHERE crossed GROUP BY 1, 2, 3)
JOIN (SELECT sid, cmodel, compname, boards FROM {series}) USING (sid) JOIN (SELECT cmodel, compname, idx, ts, barcode, fdate, comp_avdp, floor_before FROM {watch}) USING (cmodel, compname, idx)
""")
    define(f"{prefix}_episodes", f"""
SELECT *, 'WRN-' || sha1(length(cmodel) || ':' || cmodel || length(compname) || ':' || compname || length(start_barcode) || ':' || start_barcode
 || length(start_time) || ':' || start_time) AS warning_id, CASE WHEN boards - 1 - last_index >= 3 THEN last_index END AS end_index
FROM (SELECT pair, cmodel, compname, boards, min(idx) AS start_index, arg_min(barcode, idx) AS start_barcode, arg_min(fdate, idx) AS start_time, min(ts) AS start_ts,
  max(level) AS level, count(*) AS boards_above, max(idx) AS last_index,
  concat_ws(',', CASE WHEN bool_or(area) THEN 'comp_aadp' END, CASE WHEN bool_or(height) THEN 'comp_ahdp' END, CASE WHEN bool_or(volume) THEN 'comp_avdp' END) AS metrics,
  min(idx) FILTER (level >= 2) AS l2_index, arg_min(fdate, idx) FILTER (level >= 2) AS l2_time, min(idx) FILTER (level >= 3) AS l3_index
 FROM (SELECT *, sum(CASE WHEN idx - before <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY pair, sid ORDER BY idx) AS run FROM (
   SELECT *, lag(idx) OVER (PARTITION BY pair, sid ORDER BY idx) AS before FROM {prefix}_levels)) GROUP BY pair, sid, cmodel, compname, boards, run)
""")
    define(f"{prefix}_score", f"""
SELECT pair, count(*) AS l2, count(*) FILTER (compname <> '__board__' AND EXISTS (
 SELECT 1 FROM watch w WHERE w.ng AND w.cmodel = e.cmodel AND w.compname = e.compname AND w.idx BETWEEN e.l2_index AND e.l2_index + 50)) AS hits
FROM {prefix}_episodes e WHERE l2_index IS NOT NULL GROUP BY pair
""")


walk("walked", "watch_lanes")
walk("grid_walked", "grid_lanes")
alarms("walked", "drift")
alarms("grid_walked", "grid")


define("cut_watch", "SELECT * FROM watch WHERE ts < (SELECT cut FROM half_time)")
define("cut_series", "SELECT cmodel, compname, sid, count(*) AS boards FROM cut_watch JOIN watch_series USING (cmodel, compname) GROUP BY ALL")
define("cut_walked", "SELECT w.* FROM walked w JOIN cut_series s ON s.sid = w.lane // 3 WHERE w.idx < s.boards")
alarms("cut_walked", "cut", "cut_watch", "cut_series")


def restarted(k: int) -> None:
    """Round k of accepting: series whose active episode is accepted (here: an id whose first digit is below 8) begin there anew."""
    last, watch, series = ("drift", "watch", "watch_series") if k == 1 else (f"again{k - 1}", f"again{k - 1}_watch", f"again{k - 1}_series")
    define(f"again{k}_from", f"SELECT cmodel, compname, start_index FROM {last}_episodes WHERE end_index IS NULL AND substr(warning_id, 5, 1) < '8'")
    define(f"again{k}_watch", f"SELECT w.* REPLACE (idx - start_index AS idx) FROM {watch} w JOIN again{k}_from USING (cmodel, compname) WHERE idx >= start_index")
    define(f"again{k}_series", f"""
SELECT cmodel, compname, sid, count(*) AS boards, count(*) FILTER (w.ng) AS ng_count FROM again{k}_watch w JOIN {series} USING (cmodel, compname) GROUP BY ALL""")
    define(f"again{k}_lanes", f"""
SELECT sid * 3 + m AS lane, CAST(0.2 AS DOUBLE) AS lam, CAST(4 AS DOUBLE) AS width, idx, ng, v FROM (
 SELECT sid, idx, ng, unnest([0, 1, 2]) AS m, unnest([comp_avdp, comp_aadp, comp_ahdp]) AS v FROM again{k}_watch JOIN again{k}_series USING (cmodel, compname))""")
    walk(f"again{k}_walked", f"again{k}_lanes")
    alarms(f"again{k}_walked", f"again{k}", f"again{k}_watch", f"again{k}_series")


ROUNDS = 4
for _k in range(1, ROUNDS + 1):
    restarted(_k)
define("accepted_series", " UNION ALL ".join(f"""
SELECT {k} AS restarts, s.cmodel, s.compname, s.boards, s.ng_count, coalesce(e.n, 0) AS episodes, coalesce(e.active, 0) AS level
FROM {"watch_series" if k == 0 else f"again{k}_series"} s LEFT JOIN (
 SELECT cmodel, compname, count(*) AS n, max(CASE WHEN end_index IS NULL THEN level END) AS active FROM {"drift" if k == 0 else f"again{k}"}_episodes GROUP BY ALL) e USING (cmodel, compname)
{f"ANTI JOIN again{k + 1}_from USING (cmodel, compname)" if k < ROUNDS else ""}""" for k in range(ROUNDS + 1)))
