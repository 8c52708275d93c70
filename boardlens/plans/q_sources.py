"""Queries: sources and row-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions import scalars as S
from boardlens.functions.stats import r6
from boardlens.operators.inspections import normalized
from boardlens.operators.rules import filter_items
from boardlens.plans.registry import query, rows
from boardlens.schema import AFFECTED_TRIPLES, PARAM_SINGLES, PARAM_TRIPLES, RECENT_BOARDS
from boardlens.session import new_folder
from boardlens.sources import readers as R
from boardlens.sources.spi import limits_rows, spi_rows

_SCAN = """row_id, barcode, cmodel, work_order, machinename, fdate, compname, comp_errname,
 comp_avdp, comp_aadp, comp_ahdp, comp_px, comp_py, abs_printspeed, abs_snapoffspeed"""


@query("scan_full", f"SELECT {_SCAN}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM spi")
def scan_full(spark, sf):
    df = spi_rows(spark, sf)
    return df.select(*[c.strip() for c in _SCAN.split(",")], R.time_text("ts").alias("ts"))


@query("recent_boards", """
SELECT row_id, barcode, fdate, compname FROM spi WHERE barcode IN (
  SELECT barcode FROM spi GROUP BY barcode ORDER BY max(ts) DESC NULLS LAST, barcode LIMIT 3000)""")
def recent_boards(spark, sf):
    return R.recent_boards(spi_rows(spark, sf), RECENT_BOARDS).select("row_id", "barcode", "fdate", "compname")


@query("lowercase_columns", "SELECT barcode, cmodel, compname, comp_errname, comp_avdp FROM spi")
def lowercase_columns(spark, sf):
    mixed = spi_rows(spark, sf).select(
        F.col("barcode").alias("BarCode"), F.col("cmodel").alias("cModel"),
        F.col("compname").alias("CompName"), F.col("comp_errname").alias("Comp_errName"),
        F.col("comp_avdp").alias("Comp_AVDP"),
    )
    return R.lowercase_columns(mixed)


_LIMIT_COLS = ("x", "y", "volume", "volume_upper", "volume_lower", "area", "area_upper", "area_lower",
               "height", "height_upper", "height_lower")


@query("csv_scan", """
SELECT work_order, product_name, board_sn, strftime(ts, '%Y-%m-%d %H:%M:%S') AS inspect_time, component, pad, raw_side AS side,
 round(comp_px, 4) AS x, round(comp_py, 4) AS y, round(volume, 4) AS volume, volume_upper, volume_lower,
 round(area, 4) AS area, area_upper, area_lower, round(height, 4) AS height, height_upper, height_lower
FROM (SELECT *, 'TOP' AS raw_side FROM limits_view)""")
def csv_scan(spark, sf):
    spi = spi_rows(spark, sf)
    folder = new_folder(spark, "limits-csv")
    px = spi.select("row_id", F.col("comp_px").alias("x"), F.col("comp_py").alias("y"))
    contract = limits_rows(spi.drop("x", "y")).join(px, "row_id")
    contract.select(
        "work_order", "product_name", "board_sn", "inspect_time", "machine", "side", "component", "pad",
        *_LIMIT_COLS,
    ).write.csv(folder, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    df = R.read_limits_csv(spark, folder)
    return df.select(
        "work_order", "product_name", "board_sn", R.time_text("inspect_time").alias("inspect_time"),
        "component", "pad", "side", *[F.col(c).cast("double").alias(c) for c in _LIMIT_COLS],
    )


@query("ingest_export", """
SELECT barcode, compname, CASE WHEN comp_errname = 'PASS' THEN NULL ELSE comp_errname END AS comp_errname,
 comp_avdp, comp_px AS col_1st_x,
 CAST(round((CAST(epoch(ts) AS DOUBLE) / CAST(86400 AS DOUBLE) + CAST(25569 AS DOUBLE) - CAST(25569 AS DOUBLE))
      * CAST(86400000000 AS DOUBLE)) AS BIGINT) AS fdate_micros
FROM spi""")
def ingest_export(spark, sf):
    folder = new_folder(spark, "export-csv")
    serial = F.unix_timestamp("ts").cast("double") / F.lit(86400.0) + F.lit(25569.0)
    spi_rows(spark, sf).select(
        F.col("barcode").alias("BarCode"), F.col("compname").alias(" CompName "),
        F.when(F.col("comp_errname") != "PASS", F.col("comp_errname")).alias("Comp errName"),
        F.col("comp_avdp").cast("string").alias("Comp-AVDP"),
        F.col("comp_px").cast("string").alias("1st X"),
        serial.cast("string").alias("FDate"),
    ).write.csv(folder, header=True, nullValue="")
    df = R.ingest_export(spark, folder, new_folder(spark, "export-table"))
    return df.select(
        "barcode", "compname", "comp_errname", "comp_avdp", "col_1st_x",
        F.unix_micros("fdate").alias("fdate_micros"),
    )


@query("defect_subset_scan", """
SELECT fdate, machinename, cmodel, barcode, compname, comp_errname, comp_avdp, comp_aadp, comp_ahdp, comp_px, comp_py,
 printspeed_plan, printspeed, diff_printspeed, CAST(NULL AS DOUBLE) AS frontsqgpress_plan, frontsqgpress,
 CAST(NULL AS DOUBLE) AS diff_frontsqgpress, CAST(NULL AS DOUBLE) AS rearsqgpress_plan, rearsqgpress,
 CAST(NULL AS DOUBLE) AS diff_rearsqgpress, snapoffspeed_plan, snapoffspeed, diff_snapoffspeed,
 CAST(NULL AS DOUBLE) AS cleaningfrequency_plan, cleaningfrequency, CAST(NULL AS DOUBLE) AS diff_cleaningfrequency FROM spi
WHERE comp_errname IN ('Under Volume','Under Area','Under Height','Over Volume','Over Height','AREAOVER')
ORDER BY ts, barcode, compname""")
def defect_subset_scan(spark, sf):
    return R.defect_subset(spi_rows(spark, sf))


@query("source_fingerprint",
       "SELECT count(*) || '|' || coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '') AS fingerprint FROM spi")
def source_fingerprint(spark, sf):
    return R.source_fingerprint(spi_rows(spark, sf))


@query("cumulative_stats", """
SELECT count(*) AS row_count, count(DISTINCT barcode) AS board_count, count(*) FILTER (ng) AS ng_row_count,
 count(DISTINCT barcode) FILTER (ng) AS ng_board_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_time FROM rows_ng""")
def cumulative_stats(spark, sf):
    return R.cumulative_stats(spi_rows(spark, sf))


@query("source_probe",
       "SELECT count(*) AS row_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_time FROM spi")
def source_probe(spark, sf):
    return R.source_probe(spi_rows(spark, sf))


@query("warning_ack_log", """
SELECT 'WRN-' || sha1(length(cmodel) || ':' || cmodel || length(compname) || ':' || compname || length(barcode) || ':' || barcode) AS warning_id,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS accepted_at FROM rows_ng WHERE ng GROUP BY 1""")
def warning_ack_log(spark, sf):
    folder = new_folder(spark, "acks")
    acks = rows(spark, sf).where("ng").select(
        S.stable_id("WRN-", "cmodel", "compname", "barcode").alias("warning_id"),
        F.col("ts").alias("accepted_at"), (F.col("row_id") % 2).alias("batch"),
    )
    for batch in (0, 1):
        R.append_acks(acks.where(F.col("batch") == batch), folder)
    return R.read_acks(spark, folder).withColumn("accepted_at", R.time_text("accepted_at"))


@query("parse_time", """
SELECT row_id, strftime(coalesce(try_strptime(trim(t), '%Y/%m/%d %H:%M:%S'), try_strptime(trim(t), '%Y/%m/%d %H:%M'),
  try_strptime(trim(t), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(t), '%Y-%m-%d %H:%M')), '%Y-%m-%d %H:%M:%S') AS parsed
FROM (SELECT row_id, CASE row_id // 10 % 6 WHEN 0 THEN fdate WHEN 1 THEN replace(fdate, '/', '-')
  WHEN 2 THEN fdate || ':30' WHEN 3 THEN ' ' || replace(fdate, '/', '-') || ':05 ' WHEN 4 THEN 'bad ' || barcode ELSE '' END AS t FROM spi)""")
def parse_time(spark, sf):
    variants = F.expr("""CASE row_id div 10 % 6 WHEN 0 THEN fdate WHEN 1 THEN replace(fdate, '/', '-')
        WHEN 2 THEN concat(fdate, ':30') WHEN 3 THEN concat(' ', replace(fdate, '/', '-'), ':05 ')
        WHEN 4 THEN concat('bad ', barcode) ELSE '' END""")
    return spi_rows(spark, sf).select(
        "row_id", F.date_format(S.parse_time(variants), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query("safe_float", """
SELECT row_id, CASE row_id // 10 % 5 WHEN 0 THEN comp_avdp WHEN 1 THEN comp_px END AS parsed FROM spi""")
def safe_float(spark, sf):
    variants = F.expr("""CASE row_id div 10 % 5 WHEN 0 THEN CAST(comp_avdp AS STRING)
        WHEN 1 THEN concat(' ', CAST(comp_px AS STRING), ' ') WHEN 2 THEN concat(CAST(comp_px AS STRING), 'd')
        WHEN 3 THEN '' ELSE barcode END""")
    return spi_rows(spark, sf).select("row_id", S.safe_float(variants).alias("parsed"))


@query("is_ng", """
SELECT row_id, coalesce(trim(e) <> '' AND upper(trim(e)) <> 'PASS', false) AS ng FROM (
 SELECT row_id, CASE row_id // 10 % 4 WHEN 0 THEN comp_errname WHEN 1 THEN ' ' || lower(comp_errname) || ' ' WHEN 2 THEN '' END AS e FROM spi)""")
def is_ng(spark, sf):
    variants = F.expr("""CASE row_id div 10 % 4 WHEN 0 THEN comp_errname
        WHEN 1 THEN concat(' ', lower(comp_errname), ' ') WHEN 2 THEN '' END""")
    return spi_rows(spark, sf).select("row_id", S.is_ng(variants).alias("ng"))


_DEFECT_SQL = """
CASE replace(k0, ' ', '') WHEN 'areaover' THEN 'over area' WHEN 'volumeover' THEN 'over volume'
 WHEN 'heightover' THEN 'over height' WHEN 'areaunder' THEN 'under area' WHEN 'volumeunder' THEN 'under volume'
 WHEN 'heightunder' THEN 'under height' ELSE k0 END"""
_VARIANT_SQL = """(SELECT *, trim(regexp_replace(lower(replace(replace(trim(v), '_', ' '), '-', ' ')), '\\s+', ' ', 'g')) AS k0 FROM (
 SELECT row_id, CASE row_id // 10 % 4 WHEN 0 THEN comp_errname WHEN 1 THEN '  ' || replace(comp_errname, ' ', '-') || ' '
  WHEN 2 THEN CASE WHEN comp_avdp > 15 THEN 'Height__Under' ELSE 'Bridge ' || cmodel END ELSE '' END AS v FROM spi))"""
_VARIANT = """CASE row_id div 10 % 4 WHEN 0 THEN comp_errname WHEN 1 THEN concat('  ', replace(comp_errname, ' ', '-'), ' ')
  WHEN 2 THEN CASE WHEN comp_avdp > 15 THEN 'Height__Under' ELSE concat('Bridge ', cmodel) END ELSE '' END"""


@query("normalize_defect", f"SELECT row_id, {_DEFECT_SQL} AS defect_key FROM {_VARIANT_SQL}")
def normalize_defect(spark, sf):
    return spi_rows(spark, sf).select("row_id", S.normalize_defect(F.expr(_VARIANT)).alias("defect_key"))


@query("defect_direction", f"""
SELECT row_id, CASE WHEN dk LIKE 'over%' THEN 'OVER' WHEN dk LIKE 'under%' THEN 'UNDER'
 WHEN dk = '' THEN 'OTHER:UNKNOWN' ELSE 'OTHER:' || dk END AS direction
FROM (SELECT row_id, {_DEFECT_SQL} AS dk FROM {_VARIANT_SQL})""")
def defect_direction(spark, sf):
    return spi_rows(spark, sf).select("row_id", S.defect_direction(F.expr(_VARIANT)).alias("direction"))


@query("split_component_pad", """
SELECT row_id, CASE WHEN regexp_matches(v, '^.+_[0-9]+$') THEN regexp_extract(v, '^(.+)_[0-9]+$', 1) ELSE v END AS component,
 CASE WHEN regexp_matches(v, '^.+_[0-9]+$') THEN regexp_extract(v, '_([0-9]+)$', 1) ELSE '1' END AS pad
FROM (SELECT row_id, CASE row_id // 10 % 5 WHEN 0 THEN compname WHEN 1 THEN 'U_' || compname WHEN 2 THEN '_7'
 WHEN 3 THEN cmodel ELSE '' END AS v FROM spi)""")
def split_component_pad(spark, sf):
    v = F.expr("""CASE row_id div 10 % 5 WHEN 0 THEN compname WHEN 1 THEN concat('U_', compname)
        WHEN 2 THEN '_7' WHEN 3 THEN cmodel ELSE '' END""")
    return spi_rows(spark, sf).select(
        "row_id", S.component_of(v).alias("component"), S.pad_of(v).alias("pad"))


@query("defect_metric_lookup", f"""
SELECT row_id, CASE dk WHEN 'over area' THEN 'comp_aadp' WHEN 'under area' THEN 'comp_aadp' WHEN 'over height' THEN 'comp_ahdp'
  WHEN 'under height' THEN 'comp_ahdp' ELSE 'comp_avdp' END AS metric,
 CASE dk WHEN 'over area' THEN '面积偏差' WHEN 'under area' THEN '面积偏差' WHEN 'over height' THEN '高度偏差'
  WHEN 'under height' THEN '高度偏差' ELSE '体积偏差' END AS metric_label,
 CASE dk WHEN 'over volume' THEN '多锡' WHEN 'under volume' THEN '少锡' WHEN 'over area' THEN '多锡(面积)'
  WHEN 'under area' THEN '少锡(面积)' WHEN 'over height' THEN '多锡(高度)' WHEN 'under height' THEN '少锡(高度不足)' ELSE v END AS defect_name
FROM (SELECT row_id, v, {_DEFECT_SQL} AS dk FROM {_VARIANT_SQL})""")
def defect_metric_lookup(spark, sf):
    v = F.expr(_VARIANT)
    metric = S.defect_metric(v)
    return spi_rows(spark, sf).select(
        "row_id", metric.alias("metric"), S.metric_label(metric).alias("metric_label"),
        S.defect_name(v).alias("defect_name"))


_NORM_SQL = """row_id, work_order, cmodel AS product_name, barcode AS board_sn, fdate AS inspect_time,
 machinename AS machine, '' AS side, regexp_extract(compname, '^(.+)_[0-9]+$', 1) AS component,
 regexp_extract(compname, '_([0-9]+)$', 1) AS pad, comp_px AS x, comp_py AS y, comp_errname AS raw_ng_type,
 comp_avdp AS volume_deviation_percent, comp_aadp AS area_deviation_percent, comp_ahdp AS height_deviation_percent"""


_PARAMETERS = [c for n in PARAM_TRIPLES for c in (f"{n}_plan", n, f"diff_{n}")]
_PARAMETERS += [c for c in PARAM_SINGLES if c not in _PARAMETERS]
# What the test view has of them; the contract's other columns are NULL there.
_IN_VIEW = {
    "printspeed_plan", "printspeed", "diff_printspeed", "snapoffspeed_plan", "snapoffspeed", "diff_snapoffspeed",
    "markdeviation_plan", "frontsqgpress", "rearsqgpress", "printmode", "cleaningfrequency", "temperature", "humidity",
    "printdirection",
}
_TEXT_SINGLES = {"printmode_plan", "printmode", "printdirection", "pcbsize"}
_PARAMETER_SQL = ", ".join(
    c if c in _IN_VIEW else f"CAST(NULL AS {'VARCHAR' if c in _TEXT_SINGLES else 'DOUBLE'}) AS {c}" for c in _PARAMETERS)


@query("normalize_spi", f"SELECT {_NORM_SQL}, {_PARAMETER_SQL} FROM spi")
def normalize_spi(spark, sf):
    df = normalized(spi_rows(spark, sf), PARAM_TRIPLES, PARAM_SINGLES)
    return df.select(
        "row_id", "work_order", "product_name", "board_sn", "inspect_time", "machine", "side", "component", "pad",
        "x", "y", "raw_ng_type", "volume_deviation_percent", "area_deviation_percent", "height_deviation_percent",
        *_PARAMETERS)


@query("normalize_affected", f"""
SELECT {_NORM_SQL}, printspeed_plan, printspeed, diff_printspeed, CAST(NULL AS DOUBLE) AS frontsqgpress_plan, frontsqgpress,
 CAST(NULL AS DOUBLE) AS diff_frontsqgpress, CAST(NULL AS DOUBLE) AS rearsqgpress_plan, rearsqgpress,
 CAST(NULL AS DOUBLE) AS diff_rearsqgpress, snapoffspeed_plan, snapoffspeed, diff_snapoffspeed,
 CAST(NULL AS DOUBLE) AS cleaningfrequency_plan, cleaningfrequency, CAST(NULL AS DOUBLE) AS diff_cleaningfrequency FROM spi""")
def normalize_affected(spark, sf):
    return normalized(spi_rows(spark, sf), AFFECTED_TRIPLES).drop("ts", "total_pads")


@query("deviation_percent", """
SELECT row_id, round(CASE WHEN (u + l) / 2 <> 0 THEN (comp_avdp - (u + l) / 2) / ((u + l) / 2) * 100 END, 2) AS deviation
FROM (SELECT row_id, comp_avdp, CASE row_id // 10 % 5 WHEN 0 THEN NULL WHEN 1 THEN comp_px ELSE comp_aadp END AS u,
 CASE row_id // 10 % 5 WHEN 1 THEN -comp_px ELSE comp_ahdp END AS l FROM spi)""")
def deviation_percent(spark, sf):
    df = spi_rows(spark, sf).select(
        "row_id", "comp_avdp",
        F.expr("CASE row_id div 10 % 5 WHEN 0 THEN NULL WHEN 1 THEN comp_px ELSE comp_aadp END").alias("u"),
        F.expr("CASE row_id div 10 % 5 WHEN 1 THEN -comp_px ELSE comp_ahdp END").alias("l"))
    return df.select("row_id", S.deviation_percent(F.col("comp_avdp"), F.col("u"), F.col("l")).alias("deviation"))


@query("stable_id", """
SELECT row_id, 'TRG-' || sha1(length(cmodel) || ':' || cmodel || length(compname) || ':' || compname || length(barcode) || ':' || barcode || length(fdate) || ':' || fdate) AS trigger_id,
 'WRN-' || sha1(length(cmodel) || ':' || cmodel || length(compname) || ':' || compname || length(barcode) || ':' || barcode || length(fdate) || ':' || fdate) AS warning_id FROM spi""")
def stable_id(spark, sf):
    key = ("cmodel", "compname", "barcode", "fdate")
    return spi_rows(spark, sf).select(
        "row_id", S.stable_id("TRG-", *key).alias("trigger_id"), S.stable_id("WRN-", *key).alias("warning_id"))


@query("direction_matches", """
SELECT row_id, contains(lower(d), 'over') AS over_hit,
 contains(lower(d), 'insufficient') OR contains(lower(d), 'less') OR contains(lower(d), 'under') AS under_hit, false AS other_hit
FROM (SELECT row_id, CASE row_id // 10 % 4 WHEN 3 THEN 'Insufficient' WHEN 2 THEN 'Solder LESS' ELSE comp_errname END AS d FROM spi)""")
def direction_matches(spark, sf):
    d = F.expr("CASE row_id div 10 % 4 WHEN 3 THEN 'Insufficient' WHEN 2 THEN 'Solder LESS' ELSE comp_errname END")
    return spi_rows(spark, sf).select(
        "row_id", S.direction_matches(d, F.lit("OVER")).alias("over_hit"),
        S.direction_matches(d, F.lit("UNDER")).alias("under_hit"),
        S.direction_matches(d, F.lit("OTHER:x")).alias("other_hit"))


@query("defect_by_label", """
SELECT row_id, CASE WHEN n IN ('under volume','under area','under height') THEN 'UNDER'
  WHEN n IN ('over volume','over area','areaover','over height') THEN 'OVER' END AS direction,
 CASE WHEN n LIKE '%volume' THEN 'volume' WHEN n IN ('under area','over area','areaover') THEN 'area'
  WHEN n LIKE '%height' THEN 'height' END AS metric,
 CASE WHEN n LIKE '%volume' THEN comp_avdp WHEN n IN ('under area','over area','areaover') THEN comp_aadp
  WHEN n LIKE '%height' THEN comp_ahdp END AS deviation
FROM (SELECT *, lower(replace(comp_errname, '_', ' ')) AS n FROM spi)""")
def defect_by_label(spark, sf):
    direction, metric = S.label_defect("comp_errname")
    value = (F.when(metric == "volume", F.col("comp_avdp")).when(metric == "area", F.col("comp_aadp"))
             .when(metric == "height", F.col("comp_ahdp")))
    return spi_rows(spark, sf).select(
        "row_id", direction.alias("direction"), metric.alias("metric"), value.alias("deviation"))


@query("defect_by_limits", """
SELECT row_id, CASE WHEN volume > volume_upper THEN 'OVER' WHEN volume < volume_lower THEN 'UNDER'
 WHEN area > area_upper THEN 'SUSPECT_OVER' WHEN area < area_lower THEN 'SUSPECT_UNDER'
 WHEN height > height_upper THEN 'SUSPECT_OVER' WHEN height < height_lower THEN 'SUSPECT_UNDER' END AS defect,
 CASE WHEN volume > volume_upper OR volume < volume_lower THEN 'volume' WHEN area > area_upper OR area < area_lower THEN 'area'
 WHEN height > height_upper OR height < height_lower THEN 'height' END AS metric FROM limits_view""")
def defect_by_limits(spark, sf):
    found = S.limit_defect()
    return limits_rows(spi_rows(spark, sf)).select(
        "row_id", found["defect"].alias("defect"), found["metric"].alias("metric"))


@query("filter_items", """
SELECT abnormal_id, board_sn, component, pad, defect_type, risk_level FROM abnormal
WHERE defect_type LIKE '%UNDER' AND risk_level = 'HIGH'
 AND contains(lower(work_order || ' ' || product_name || ' ' || board_sn || ' ' || machine || ' ' || component || ' ' || pad || ' ' || '' || ' ' || abnormal_pattern), 'm1')""")
def filter_items_query(spark, sf):
    from boardlens.plans.q_rules import abnormal_results

    return filter_items(abnormal_results(spark, sf), defect="UNDER", risk="HIGH", keyword="M1").select(
        "abnormal_id", "board_sn", "component", "pad", "defect_type", "risk_level")
