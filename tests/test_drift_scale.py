"""What the drift monitor keeps and how fast it walks."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boardlens.operators import drift as D
from boardlens.operators import inspections as I
from boardlens.schema import METRICS
from tests.test_drift import START, noise, points

SHIFTED = noise(100) + [30.0] * 10 + noise(60, 3) + [30.0] * 4


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_marked_points_give_grades_totals_and_last_state_of_the_whole_trace(spark):
    df = points(spark, SHIFTED, ng={3, 120}).unionByName(points(spark, noise(90, 4), pad="C2_1"))
    trace, marks = D.walked(df, D.GRID), D.marked(df, D.GRID)
    assert rows_of(D.graded(trace, D.GRID)) == rows_of(D.graded(marks, D.GRID))
    totals = D.series_totals(marks)
    assert rows_of(totals) == rows_of(D.series_totals(trace)) and {r.boards for r in totals.collect()} == {len(SHIFTED), 90}
    last = [F.max_by(F.struct("ewma", "center", "sigma", "upper"), "idx")]
    assert rows_of(trace.groupBy(*D.SERIES).agg(*last)) == rows_of(marks.groupBy(*D.SERIES).agg(*last))
    assert D.marked(df).count() < df.count() / 3


def test_marked_points_over_batch_borders(spark):
    df = points(spark, SHIFTED, ng={3}).unionByName(points(spark, noise(40, 4), pad="C2_1"))
    want = rows_of(D.marked(df).select(*D.SERIES, "idx", "crossed", "streak", "rising", "start"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            assert rows_of(D.marked(df).select(*D.SERIES, "idx", "crossed", "streak", "rising", "start")) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_long_series_is_walked_quickly():
    n = 30_000
    values = np.random.default_rng(3).normal(10, 1, (len(METRICS), n))
    rows = pa.RecordBatch.from_pydict({**{m: values[k] for k, m in enumerate(METRICS)}, "ng": pa.array([False] * n)})
    began = time.process_time()
    D.Monitor(D.DEFAULT).walk(rows)
    assert time.process_time() - began < 1.5


def test_first_inspections_are_found_without_shuffling_the_rows(spark):
    made = [(f"B{k}", f"t{j}", k * 10 + j, "C1_1", "M") for k in range(50) for j in range(2 if k % 9 == 0 else 1)]
    df = spark.createDataFrame(made, "barcode string, fdate string, row_id long, compname string, cmodel string").withColumn(
        "ts", F.lit(START) + F.make_dt_interval(mins=F.col("row_id").cast("int")))
    first = I.first_inspection_rows(df)
    assert "Exchange hashpartitioning" not in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.row_id for r in first.collect()) == [k * 10 for k in range(50)]


def test_rechecks_of_owners_with_a_missing_time(spark):
    made = [("a", None, 1), ("a", "t1", 2), ("b", "t1", 3), ("b", "t1", 4), (None, "t1", 5), (None, "t2", 6), ("c", "t2", 7), ("c", "t1", 8)]
    df = spark.createDataFrame(made, "barcode string, fdate string, row_id long").withColumn(
        "ts", F.when(F.col("fdate").isNotNull(), F.lit(START)))
    assert sorted(r.row_id for r in I.first_inspection_rows(df).collect()) == [1, 3, 4, 5, 6, 8]
