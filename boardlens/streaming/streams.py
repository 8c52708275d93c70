"""Inspection operators as continuous queries.

Streams of inspection rows carry ``ts`` as TIMESTAMP. Operators whose result
depends on earlier rows keep a state per key; the others are windowed aggregates.
Each gives, once flushed, the rows of its batch counterpart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boardlens.operators.drift import DEFAULT, SERIES, TRACE, Monitor
from boardlens.operators.inspections import SERIES_ORDER
from boardlens.schema import EVENT_GAP_MINUTES, METRICS


def stream_ng_events(boards: DataFrame, delay: str = "1 day", gap_minutes: int = EVENT_GAP_MINUTES) -> DataFrame:
    """Failure events as session windows over failing boards (``events.direction_boards`` rows).

    An event is emitted when the watermark has passed its gap; rows later than
    ``delay`` are dropped and counted in the query's progress. A gap of exactly
    ``gap_minutes`` still merges, as in the batch form.
    """
    session = F.session_window("ts", f"{gap_minutes} minutes")
    return boards.withWatermark("ts", delay).groupBy(session.alias("w"), "model", "machine", "direction").agg(
        F.count(F.lit(1)).alias("board_count"), F.sum("ng_count").alias("ng_record_count"), F.max("ng_share").alias("max_ng_share"),
    ).select(
        "model", "machine", "direction", F.col("w.start").alias("start_ts"),
        (F.col("w.end") - F.expr(f"INTERVAL {gap_minutes} MINUTES")).alias("end_ts"), "board_count", "ng_record_count", "max_ng_share")


def _with_columns(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    return T.StructType([*schema.fields, *added])


# So many points of a series are walked before their trace is given.
PIECE = 10_000


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


# Boards share a state by the hash of their barcode: one call of Python for many boards.
BOARD_GROUPS = 2048
_STATE_COLUMNS = ("barcode", "ts", "fdate", "until")


def stream_first_inspection(rows: DataFrame, keep: str = "30 days", delay: str = "1 day", groups: int = BOARD_GROUPS) -> DataFrame:
    """Rows with ``is_recheck``: whether their inspection is not the first one of the board seen so far.

    The first (time, time text) of a board is kept until the watermark is ``keep``
    past it; within a micro-batch the earliest one wins. Boards are dealt to
    ``groups`` by their barcode, and a group's boards are one state; its rows of one
    micro-batch are held together.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    schema = _with_columns(rows.schema, [T.StructField("is_recheck", T.BooleanType())])

    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = pd.DataFrame(dict(zip(_STATE_COLUMNS, state.get, strict=True))) if state.exists else pd.DataFrame(
            {"barcode": [], "ts": [], "fdate": [], "until": []}).astype({"barcode": object, "ts": "int64", "fdate": object, "until": "int64"})
        held = [] if state.hasTimedOut else [c for c in chunks if len(c)]
        if held:
            times = pd.concat([pd.DataFrame({"barcode": c["barcode"], "ts": _micros(c["ts"]), "fdate": c["fdate"]}) for c in held])
            here = times.sort_values(["ts", "fdate"]).drop_duplicates("barcode")
            fresh = here[~here["barcode"].isin(kept["barcode"])]
            seen = kept["barcode"].isin(here["barcode"])
            kept = pd.concat([kept[(kept["until"] >= now) | seen], fresh.assign(until=0)], ignore_index=True)
            met = kept["barcode"].isin(here["barcode"])
            kept.loc[met, "until"] = (kept["ts"] // 1000 + keep_ms).clip(lower=now + 1)
            first = kept.set_index("barcode")
        else:
            kept = kept[kept["until"] >= now]
        if len(kept):
            state.update(tuple(kept[c].tolist() for c in _STATE_COLUMNS))
            state.setTimeoutTimestamp(max(int(kept["until"].min()), now + 1))
        else:
            state.remove()
        for chunk in held:
            at = first.loc[chunk["barcode"]]
            again = (_micros(chunk["ts"]).to_numpy() != at["ts"].to_numpy()) | (chunk["fdate"].to_numpy() != at["fdate"].to_numpy())
            yield chunk.drop(columns="_group").assign(is_recheck=again)

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("barcode"), F.lit(groups)))
    return dealt.withWatermark("ts", delay).groupBy("_group").applyInPandasWithState(
        judge, schema, "barcode array<string>, ts array<bigint>, fdate array<string>, until array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def _compact(chunks: Iterator[pd.DataFrame], schema: pa.Schema) -> dict[str, pa.Array]:
    """The columns of ``schema`` of all chunks as flat arrays, with ``ts`` in microseconds."""
    parts: dict[str, list[pa.Array]] = {n: [] for n in schema.names}
    for chunk in chunks:
        flat = chunk[schema.names].assign(ts=_micros(chunk["ts"]))
        batch = pa.RecordBatch.from_pandas(flat, schema, preserve_index=False)
        for n in schema.names:
            parts[n].append(batch.column(n))
    return {n: pa.concat_arrays(parts.pop(n)) for n in schema.names}


def _not_after(columns: dict[str, pa.Array], last: tuple) -> int:
    """How many rows do not come after ``last`` in the order of a series."""
    after, tied = False, True
    for name, value in zip(SERIES_ORDER, last, strict=True):
        after = pc.or_(after, pc.and_(tied, pc.greater(columns[name], value)))
        tied = pc.and_(tied, pc.equal(columns[name], value))
    return len(after) - (pc.sum(after).as_py() or 0)


def stream_ewma(points: DataFrame, delay: str = "1 day") -> DataFrame:
    """The drift monitor's trace, continued from micro-batch to micro-batch.

    The state of a series is that of the batch walk, plus its last point's place in
    the order. Points of a micro-batch are sorted; one that comes after a later point
    of its series has been walked is left out and counted in ``late``, as a chart
    cannot be rewound. A micro-batch's points of a series are held as flat arrays; its
    trace, several times as large, is given piece by piece.
    """
    added = points.sparkSession.createDataFrame([], TRACE).schema
    columns = [*SERIES, *SERIES_ORDER]
    schema = T.StructType([*[points.schema[c] for c in columns], *added.fields, T.StructField("late", T.LongType())])
    names = [f.name for f in added.fields]
    inputs = pa.schema([
        ("ts", pa.int64()), ("barcode", pa.large_string()), ("fdate", pa.large_string()), ("row_id", pa.int64()),
        *[(m, pa.float64()) for m in METRICS], ("ng", pa.bool_())])

    def walk(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _compact((c for c in chunks if len(c)), inputs)
        data, *last, late = state.get if state.exists else (None, None, 0)
        monitor, behind = (Monitor.load(data), _not_after(rows, last)) if state.exists else (Monitor(DEFAULT), 0)
        late += behind
        order = pc.sort_indices(pa.table(rows), [(c, "ascending") for c in SERIES_ORDER])[behind:]
        for at in range(0, len(order), PIECE):
            piece = pa.RecordBatch.from_arrays([rows[n].take(order[at:at + PIECE]) for n in inputs.names], inputs.names)
            trace = monitor.walk(piece)
            out = piece.select(list(SERIES_ORDER)).to_pandas()
            last = [piece.column(c)[len(piece) - 1].as_py() for c in SERIES_ORDER]
            yield out.assign(**dict(zip(SERIES, key, strict=True)), ts=out["ts"].astype("datetime64[us]"),
                             **{n: trace[n].to_pylist() for n in names}, late=late)[schema.names]
        state.update((monitor.dump() if len(order) else data, *last, late))

    return points.groupBy(*SERIES).applyInPandasWithState(
        walk, schema, "data binary, ts bigint, barcode string, fdate string, row_id bigint, late bigint", "append", GroupStateTimeout.NoTimeout)


def new_alerts_sink(folder: str, key: str = "warning_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps every alert once.

    A batch's alerts lie in a folder of its number and are compared with all other
    batches, so a batch that is run again replaces its own and adds none.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema(f"{key} string, batch_id bigint").option("pathGlobFilter", "*.parquet").parquet(folder).where(
            F.col("batch_id") != number) if _exists(spark, folder) else spark.createDataFrame([], f"{key} string, batch_id bigint")
        fresh = batch.dropDuplicates([key]).join(seen.select(key).distinct(), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch_id={number}")

    return write


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def watch_and_refresh(rows: DataFrame, checkpoint: str, refresh: Callable[[object, str], None], once: bool = True):
    """Start a query that calls ``refresh(spark, version)`` after every micro-batch of new rows.

    The version is the batch's number, so a repeated batch publishes the same one.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            refresh(batch.sparkSession, f"{number:012d}")

    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
