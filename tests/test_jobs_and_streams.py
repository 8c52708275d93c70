"""The snapshot job, raw tables, and continuous queries against their batch forms."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from boardlens.operators import drift as D
from boardlens.operators import events as E
from boardlens.operators import rules as R
from boardlens.operators.inspections import first_inspection_rows, flagged_points, keyed
from boardlens.plans import q_jobs
from boardlens.plans.registry import rows
from boardlens.session import shared_dir
from boardlens.sources import readers
from boardlens.streaming import streams as S

FOLDER = "/root/testdata/sf0.001"
LIMITS = """work_order,product_name,board_sn,inspect_time,machine,side,component,pad,x,y,volume,volume_upper,volume_lower,area,area_upper,area_lower,height,height_upper,height_lower
W1,P,B1,2026-01-05 08:00:00,L1,TOP,R1,1,1,1,42,100,60,75,120,70,18,30,20
W1,P,B2,2026-01-05 08:01:00,L1,TOP,R1,1,1,1,41,100,60,74,120,70,17,30,20
W1,P,B3,2026-01-05 08:02:00,L1,TOP,R1,1,1,1,40,100,60,73,120,70,17,30,20
W1,P,B3,2026-01-05 08:02:01,L1,TOP,C2,1,2,1,132,100,60,135,120,70,34,30,20
W1,P,B3,2026-01-05 08:02:02,L1,TOP,C2,2,2,1,136,100,60,138,120,70,35,30,20
W1,P,B4,2026-01-05 08:03:00,L1,TOP,U1,5,3,1,45,100,60,76,120,70,19,30,20
W1,P,B5,2026-01-05 08:04:00,L1,TOP,R2,1,4,1,44,100,60,72,120,70,18,30,20
W1,P,B5,2026-01-05 08:04:01,L1,TOP,R3,1,4,2,43,100,60,71,120,70,18,30,20
W1,P,B5,2026-01-05 08:04:02,L1,TOP,R4,1,4,3,42,100,60,70,120,70,18,30,20
W1,P,B5,2026-01-05 08:04:03,L1,TOP,R5,1,4,4,41,100,60,69,120,70,17,30,20
W1,P,B5,2026-01-05 08:04:04,L1,TOP,R6,1,4,5,40,100,60,68,120,70,17,30,20
"""


def test_limits_file_gives_eleven_abnormals_and_three_cases(spark, tmp_path):
    (tmp_path / "limits.csv").write_text(LIMITS)
    found = R.abnormals(readers.limits_contract(readers.read_limits_csv(spark, f"file://{tmp_path}/limits.csv")))
    totals = spark.createDataFrame([(f"B{k}", 80) for k in range(1, 6)], "board_sn string, total_pads bigint")
    results = R.classified(found, totals)
    assert results.count() == 11
    cases = {(r.defect_type, r.abnormal_pattern) for r in R.quality_cases(results).collect()}
    assert cases == {("UNDER", "POINT_REPEAT"), ("OVER", "COMPONENT_MULTI_PAD"), ("UNDER", "BOARD_TREND")}
    assert results.where("component = 'U1'").first().abnormal_pattern == "SPORADIC"


def test_raw_table_is_prepared(spark, tmp_path):
    raw = spark.createDataFrame([("2024/1/9 3:12", "B1", "C1_1", "1.5"), ("2024/1/9 3:05", "B2", "C1_1", "x"), (None, "B3", "C1_1", None)],
                                "FDATE string, Barcode string, compname string, comp_avdp string")
    raw.write.parquet(str(tmp_path / "t"))
    path = f"file://{tmp_path}/t"
    out = {r.barcode: r for r in readers.prepared(readers.read_table(spark, path)).collect()}
    assert out["B1"].ts == dt.datetime(2024, 1, 9, 3, 12) and out["B1"].comp_avdp == 1.5 and out["B2"].comp_avdp is None
    assert sorted(r.row_id for r in out.values()) == [1, 2, 3] and out["B3"].row_id == 1
    assert {r.barcode for r in readers.read_table(spark, path, window_boards=1).collect()} == {"B1"}


def test_a_failing_stage_leaves_the_others(spark, tmp_path):
    def broken(spark, sf):
        raise ValueError("no data")

    read = spark.createDataFrame([(1, ["a"])], "n int, l array<string>")
    seen = []

    def good(spark, sf):
        from boardlens.session import settled
        table = settled(read, "intermediate")
        seen.extend(table.inputFiles())
        return {"t": table}

    job = q_jobs.snapshot(f"file://{tmp_path}/s", {"a": good, "b": broken, "c": good, "d": good}, "json")
    status = {r.stage: r for r in job.run(spark, FOLDER, "1").collect()}
    assert [status[s].ok for s in "abcd"] == [True, False, True, True] and "no data" in status["b"].error
    assert job.read(spark, "c", "t").first().l == ["a"]
    assert seen and not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in seen)
    job.run(spark, FOLDER, "2")
    assert {r.version for r in job.published(spark).collect()} == {"2"}


@pytest.fixture(scope="module")
def inspections(spark):
    return rows(spark, FOLDER)


def in_files(df, folder, parts, key="ts"):
    """The rows cut into files by time, to arrive one after another."""
    cuts = df.select(F.percentile_approx(F.unix_micros(key), [k / parts for k in range(1, parts)])).first()[0]
    part = sum(((F.unix_micros(key) > c).cast("int") for c in cuts), F.lit(0))
    for k in range(parts):
        df.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(stream, tmp_path, name, spark, mode="append"):
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-check")
             .trigger(availableNow=True).start(f"{tmp_path}/{name}-out"))
    query.awaitTermination()
    return query


def reader(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_of_events_equals_batch(spark, inspections, tmp_path):
    boards = E.direction_boards(inspections).select("model", "machine", "direction", "ts", "barcode", "ng_count", "ng_share")
    folder = in_files(boards, f"{tmp_path}/boards", 3)
    late = boards.withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS")).limit(1)
    late.coalesce(1).write.mode("append").parquet(folder)  # a heartbeat flushes what is open
    query = run(S.stream_ng_events(reader(spark, boards, folder)), tmp_path, "events", spark)
    got = spark.read.parquet(f"{tmp_path}/events-out").select("model", "direction", "start_ts", "board_count", "ng_record_count")
    members = E.event_boards(E.direction_boards(inspections))
    want = E.ng_events(members).select("model", "direction", F.col("ts").alias("start_ts"), "board_count", "ng_record_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert query.lastProgress is not None
    old = boards.limit(1)
    old.coalesce(1).write.mode("append").parquet(folder)
    query = run(S.stream_ng_events(reader(spark, boards, folder)), tmp_path, "events", spark)
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1


def test_stream_of_first_inspections_equals_batch(spark, inspections, tmp_path):
    slim = inspections.select("row_id", "barcode", "fdate", "ts", "ng")
    folder = in_files(slim, f"{tmp_path}/rows", 3)
    run(S.stream_first_inspection(reader(spark, slim, folder), keep="900 days"), tmp_path, "first", spark)
    got = {r.row_id for r in spark.read.parquet(f"{tmp_path}/first-out").where("NOT is_recheck").collect()}
    assert got == {r.row_id for r in first_inspection_rows(inspections).select("row_id").collect()}
    assert spark.read.parquet(f"{tmp_path}/first-out").count() == slim.count()


def test_stream_of_drift_equals_batch_and_survives_a_restart(spark, inspections, tmp_path):
    points = D.watched_points(inspections).select(*D.SERIES, "ts", "barcode", "fdate", "row_id", "ng", "comp_avdp", "comp_aadp", "comp_ahdp").cache()
    whole = in_files(points, f"{tmp_path}/all", 4)
    files = sorted(glob.glob(f"{whole}/*.parquet"), key=lambda f: spark.read.parquet(f).agg(F.min("ts")).first()[0])
    seen = f"{tmp_path}/seen"
    spark.read.parquet(*files[:2]).coalesce(1).write.parquet(seen)
    run(S.stream_ewma(reader(spark, points, seen)), tmp_path, "ewma", spark)
    for f in files[2:]:  # the query ended; it goes on from its checkpoint
        spark.read.parquet(f).coalesce(1).write.mode("append").parquet(seen)
        run(S.stream_ewma(reader(spark, points, seen)), tmp_path, "ewma", spark)
    columns = [*D.SERIES, "idx", "barcode", "ewma", "upper", "crossed", "streak", "start"]
    got = spark.read.parquet(f"{tmp_path}/ewma-out")
    want = D.walked(points)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    # A point older than the last one walked is counted, not walked.
    spark.read.parquet(files[0]).limit(1).coalesce(1).write.mode("append").parquet(seen)
    run(S.stream_ewma(reader(spark, points, seen)), tmp_path, "ewma", spark)
    assert spark.read.parquet(f"{tmp_path}/ewma-out").count() == points.count()
    points.unpersist()


def test_a_repeated_batch_adds_no_alert(spark, tmp_path):
    write = S.new_alerts_sink(f"file://{tmp_path}/alerts")
    first = spark.createDataFrame([("a",), ("b",), ("b",)], "warning_id string")
    second = spark.createDataFrame([("b",), ("c",)], "warning_id string")
    for number, batch in ((0, first), (1, second), (1, second), (0, first)):
        write(batch, number)
    got = sorted((r.warning_id, r.batch_id) for r in spark.read.parquet(f"file://{tmp_path}/alerts").collect())
    assert got == [("a", 0), ("b", 0), ("c", 1)]


def test_new_rows_refresh_the_snapshot(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(3).write.parquet(source)
    versions = []
    stream = spark.readStream.schema("id bigint").parquet(source)
    for _ in range(2):
        S.watch_and_refresh(stream, f"{tmp_path}/watch", lambda _, v: versions.append(v)).awaitTermination()
    spark.range(2).coalesce(1).write.mode("append").parquet(source)
    S.watch_and_refresh(stream, f"{tmp_path}/watch", lambda _, v: versions.append(v)).awaitTermination()
    assert versions == ["000000000000", "000000000001"]


def test_rechecks_of_unsettled_rows(spark, inspections):
    assert flagged_points(keyed(inspections)).where("is_recheck").count() > 0 and shared_dir(spark)
