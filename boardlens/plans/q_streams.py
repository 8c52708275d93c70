"""Queries: the continuous operators, run once over what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions.stats import r6
from boardlens.jobs import Snapshot
from boardlens.operators import drift as D
from boardlens.operators import events as E
from boardlens.plans import q_drift
from boardlens.plans.registry import query, rows
from boardlens.session import new_folder
from boardlens.streaming import streams as S


def _arrived(df, *later):
    """A folder the rows lie in, and a stream over it that takes a file at a time, ``later`` ones last."""
    folder = new_folder(df.sparkSession, "arrivals")
    df.write.parquet(folder)
    for more in later:
        more.coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def _result(stream):
    """The rows a stream gives when it has taken all there is."""
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, "stream-out"), new_folder(spark, "stream-checkpoint")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_ng_events", """
SELECT model, machine, direction, ts AS start_ts, last_ts AS end_ts, board_count, ng_record_count FROM event_heads""")
def stream_ng_events(spark, sf):
    boards = E.direction_boards(rows(spark, sf)).select("model", "machine", "direction", "ts", "ng_count", "ng_share")
    # A row of a later time closes the last events; it opens one that stays open.
    beat = boards.agg(*[F.first(c).alias(c) for c in ("model", "machine", "direction")], (F.max("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts"),
                      F.first("ng_count").alias("ng_count"), F.first("ng_share").alias("ng_share"))
    return _result(S.stream_ng_events(_arrived(boards, beat))).drop("max_ng_share")


@query("stream_first_inspection", "SELECT row_id FROM firsts")
def stream_first_inspection(spark, sf):
    slim = rows(spark, sf).select("row_id", "barcode", "fdate", "ts")
    return _result(S.stream_first_inspection(_arrived(slim), keep="36500 days")).where("NOT is_recheck").select("row_id")


@query("stream_ewma", """
SELECT cmodel, compname, idx, ['comp_avdp', 'comp_aadp', 'comp_ahdp'][lane % 3 + 1] AS metric, round(z, 6) AS ewma, round(lim, 6) AS upper, crossed
FROM walked JOIN watch_series ON sid = lane // 3 WHERE idx >= 0""")
def stream_ewma(spark, sf):
    points = q_drift.watched(spark, sf)
    out = D.metric_trace(_result(S.stream_ewma(_arrived(points))))
    return out.select(*D.SERIES, "idx", "metric", r6("ewma").alias("ewma"), r6("upper").alias("upper"), "crossed")


@query("stream_new_alerts", "SELECT warning_id FROM drift_episodes")
def stream_new_alerts(spark, sf):
    """Warnings that arrive twice, in two deliveries, are kept once."""
    ids = q_drift.found(spark, sf)[1].select("warning_id")
    folder, checkpoint = new_folder(spark, "alerts"), new_folder(spark, "alerts-checkpoint")
    sink = S.new_alerts_sink(folder)
    _arrived(ids, ids).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("warning_id string").parquet(folder).select("warning_id")


@query("watch_and_refresh", "SELECT '000000000000' AS version, 'totals' AS stage, true AS ok, count(*) AS board_rows FROM spi")
def watch_and_refresh(spark, sf):
    """Rows that arrive refresh the published totals; a second look without new rows changes nothing."""
    slim = rows(spark, sf).select("barcode", "ts")
    stream = _arrived(slim)
    job = Snapshot(new_folder(spark, "watched"), {"totals": lambda s, f: {"probe": rows(s, f).agg(F.count(F.lit(1)).alias("board_rows"))}})
    checkpoint = new_folder(spark, "watch-checkpoint")
    for _ in range(2):
        S.watch_and_refresh(stream, checkpoint, lambda s, version: job.run(s, sf, version)).awaitTermination()
    total = job.read(spark, "totals", "probe")
    return job.published(spark).select("version", "stage", "ok").withColumn("board_rows", total.scalar())
