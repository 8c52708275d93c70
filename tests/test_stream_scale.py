"""Continuous queries with many keys, and with many rows of one key in a micro-batch."""

import datetime as dt

from pyspark.sql import functions as F

from boardlens.operators import drift as D
from boardlens.streaming import streams as S
from tests.test_drift import SCHEMA, noise, points
from tests.test_jobs_and_streams import reader, run

START = dt.datetime(2024, 1, 9)


def arrive(spark, folder, made, schema):
    df = spark.createDataFrame(made, schema)
    df.coalesce(1).write.mode("append").parquet(folder)
    return df


def test_boards_share_a_few_states(spark, tmp_path):
    schema = "row_id long, barcode string, fdate string, ts timestamp"
    at = lambda minute: START + dt.timedelta(minutes=minute)
    first = [(k, f"B{k}", "t1", at(1)) for k in range(300)] + [(1000 + k, f"B{k}", "t0", at(0)) for k in range(0, 300, 7)]
    again = [(2000 + k, f"B{k}", "t2", at(2)) for k in range(0, 600, 3)] + [(3000, "B5", "t1", at(1)), (3001, None, "t9", at(2))]
    folder = f"{tmp_path}/rows"
    df = arrive(spark, folder, first, schema)
    stream = lambda: S.stream_first_inspection(reader(spark, df, folder), keep="900 days", groups=16)
    run(stream(), tmp_path, "few", spark)
    arrive(spark, folder, again, schema)
    query = run(stream(), tmp_path, "few", spark)
    got = {r.row_id: r.is_recheck for r in spark.read.parquet(f"{tmp_path}/few-out").collect()}
    want = {k: k % 7 == 0 for k in range(300)} | {1000 + k: False for k in range(0, 300, 7)}
    want |= {2000 + k: k < 300 for k in range(0, 600, 3)} | {3000: False, 3001: False}
    assert got == want
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 16


def test_a_board_is_forgotten_when_its_time_is_over(spark, tmp_path):
    schema = "row_id long, barcode string, fdate string, ts timestamp"
    folder = f"{tmp_path}/rows"
    days = [[(1, "A", 0), (2, "B", 0)], [(3, "C", 40)], [(4, "D", 41)], [(5, "A", 42), (6, "C", 42)]]
    for part in days:
        df = arrive(spark, folder, [(n, b, f"d{d}", START + dt.timedelta(days=d)) for n, b, d in part], schema)
        run(S.stream_first_inspection(reader(spark, df, folder), keep="30 days", groups=1), tmp_path, "old", spark)
    got = {r.row_id: r.is_recheck for r in spark.read.parquet(f"{tmp_path}/old-out").collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_a_series_of_one_micro_batch_is_walked_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 50)
    df = points(spark, noise(230) + [30.0] * 20).unionByName(points(spark, noise(60, 2), pad="C2_1")).orderBy(F.rand(3))
    folder = f"{tmp_path}/points"
    df.write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    run(S.stream_ewma(stream), tmp_path, "pieces", spark)
    columns = [*D.SERIES, "ts", "barcode", "row_id", "idx", "ewma", "upper", "crossed", "streak", "start"]
    got = spark.read.parquet(f"{tmp_path}/pieces-out")
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, D.walked(df).select(*columns).collect()))
    assert {r.late for r in got.collect()} == {0}
