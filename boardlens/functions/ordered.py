"""Ordered computations that never put one series into one task.

A window over ``partitionBy(model, pad)`` sends a hot series to a single task,
and a window without keys sends everything there. The helpers here cut time into
chunks, run the window inside (keys, chunk), reduce every chunk to one summary
row, and carry the summaries forward with a second window over those rows only.
A chunk is a function of the timestamp alone, so the result does not depend on
Spark's partitioning and survives task retries without materialising anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.session import settled

CHUNK_SECONDS = 86_400
CHUNK = "_chunk"


def time_chunk(ts: str = "ts", seconds: int = CHUNK_SECONDS) -> Column:
    """Time slice number; rows without a time form the slice before all others."""
    return F.coalesce(F.expr(f"unix_micros({ts}) div {seconds * 1_000_000}"), F.lit(-1 << 62))


def _carry_window(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)


def on_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL; NULL meets NULL, left columns stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, match).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counters: dict[str, Column],
    ts: str = "ts",
    before_ts: bool = False,
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add running sums (one per counter) along ``order`` within ``keys``.

    With ``before_ts`` the sum covers only rows whose time is strictly earlier,
    whatever the order among equal times.
    """
    keys = list(keys)
    cut = df.withColumn(CHUNK, time_chunk(ts, seconds))
    if before_ts:
        local = (
            Window.partitionBy(*keys, CHUNK)
            .orderBy(F.expr(f"unix_micros({ts})"))
            .rangeBetween(Window.unboundedPreceding, -1)
        )
    else:
        local = (
            Window.partitionBy(*keys, CHUNK)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
    inside = cut.select(
        "*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_i_{n}") for n, c in counters.items()]
    )
    totals = cut.groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in counters.items()])
    earlier = _carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        CHUNK,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in counters],
    )
    joined = on_equal(inside, carried, [*keys, CHUNK])
    return joined.select(
        *df.columns, *[(F.col(f"_i_{n}") + F.col(f"_c_{n}")).alias(n) for n in counters]
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    name: str = "prev",
    ts: str = "ts",
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add a struct of ``values`` taken from the preceding row of the series."""
    keys = list(keys)
    cut = df.withColumn(CHUNK, time_chunk(ts, seconds))
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    inside = cut.withColumn("_in", F.lag(F.struct(*values)).over(local))
    last = cut.groupBy(*keys, CHUNK).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    carried = last.select(*keys, CHUNK, F.lag("_last").over(_carry_window(keys)).alias("_carry"))
    return on_equal(inside, carried, [*keys, CHUNK]).select(
        *df.columns, F.coalesce("_in", "_carry").alias(name)
    )


def running_min_before(
    df: DataFrame, value: str, name: str, ts: str = "ts", seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Smallest ``value`` among all rows with a strictly earlier time."""
    cut = df.withColumn(CHUNK, time_chunk(ts, seconds))
    local = (
        Window.partitionBy(CHUNK)
        .orderBy(F.expr(f"unix_micros({ts})"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    inside = cut.withColumn("_in", F.min(value).over(local))
    lows = cut.groupBy(CHUNK).agg(F.min(value).alias("_low"))
    carried = lows.select(
        CHUNK,
        F.min("_low").over(_carry_window([]).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
    )
    return inside.join(carried, CHUNK).select(*df.columns, F.least("_in", "_carry").alias(name))


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the position, from 1, of every row along ``order`` over the whole table.

    Rows are range-partitioned on the whole order, so equal and missing times are
    split as well. The partitioned copy is written, for the slices must not change
    between counting and numbering; the prefix sums cover one row per slice.
    """
    cut = settled(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ranked")
    inside = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
    slices = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        "_slice", F.coalesce(F.sum("_n").over(slices), F.lit(0)).alias("_before"))
    return inside.join(offsets, "_slice").select(
        *df.columns, (F.col("_in") + F.col("_before")).cast("bigint").alias(name))


def range_join(
    windows: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    position: str,
    width: int,
) -> DataFrame:
    """Join every [low, high] interval to the points whose position lies in it.

    Positions are cut into buckets of ``width``; an interval is copied only to the
    buckets it touches, so this is an equi-join on (keys, bucket), never a
    product of a series with itself.
    """
    left = windows.withColumn(
        "_bucket", F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"{high} div {width}")))
    )
    right = points.withColumn("_bucket", F.expr(f"{position} div {width}"))
    return (
        on_equal(left, right, [*keys, "_bucket"])
        .where(F.col(position).between(F.col(low), F.col(high)))
        .drop("_bucket")
    )
