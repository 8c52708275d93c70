"""Process dimensions: do board means depend on cleaning, stops or print direction?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.functions.ordered import ranked
from boardlens.schema import EFFECT_MIN, EFFECT_NOISE_RATIO, MIN_FIRST_BOARDS, STOP_GAP_MINUTES


def in_order(boards: DataFrame) -> DataFrame:
    """Production boards with their position in time, from 0."""
    return ranked(boards, ("ts", "barcode", "fdate"), "place").withColumn("place", F.col("place") - 1)


def _noise() -> Column:
    return F.when(F.count("mean_avdp") >= 2, F.stddev_pop("mean_avdp"))


def _threshold(noise: Column) -> Column:
    return F.greatest(F.lit(EFFECT_MIN), EFFECT_NOISE_RATIO * F.coalesce(noise, F.lit(0.0)))


def noise(boards: DataFrame) -> DataFrame:
    """Spread of board means and the smallest difference that counts as an effect."""
    return boards.agg(_noise().alias("noise_sd")).withColumn("threshold", _threshold(F.col("noise_sd")))


def _with_threshold(found: DataFrame, boards: DataFrame) -> DataFrame:
    """Adds the one-row threshold to a one-row result."""
    return found.withColumn("threshold", noise(boards).select("threshold").scalar())


def _effect(size: Column) -> Column:
    return F.when(size >= F.col("threshold"), "effect").otherwise("no_effect")


def cleaning_frequency(boards: DataFrame) -> DataFrame:
    """Most frequent non-zero cleaning frequency, the smallest among equals; one row."""
    counts = boards.where("cleaningfrequency <> 0").groupBy("cleaningfrequency").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("cleaningfrequency", F.struct(-F.col("n"), "cleaningfrequency")).cast("bigint").alias("frequency"))


def cleaning_profile(placed: DataFrame) -> DataFrame:
    """Mean and count per position inside the cleaning cycle."""
    cycle = placed.withColumn("frequency", cleaning_frequency(placed).scalar())
    return (
        cycle.where("frequency >= 2 AND mean_avdp IS NOT NULL")
        .groupBy("frequency", (F.col("place") % F.col("frequency")).alias("position"))
        .agg(F.round(F.avg("mean_avdp"), 2).alias("mean"), F.count(F.lit(1)).alias("boards"))
    )


def cleaning_cycle(placed: DataFrame) -> DataFrame:
    """One row: the verdict on the cleaning cycle and its amplitude."""
    found = cleaning_profile(placed).agg(
        F.count(F.lit(1)).alias("positions"), (F.max("mean") - F.min("mean")).alias("amplitude"))
    found = _with_threshold(found, placed).withColumn("frequency", cleaning_frequency(placed).scalar())
    enough = F.col("positions") >= 2
    return found.select(
        F.when(F.col("frequency").isNull(), "not_collected")
        .when(F.col("frequency") < 2, "no_effect")
        .when(~enough, "insufficient")
        .otherwise(_effect(F.col("amplitude"))).alias("verdict"),
        "frequency", "positions", F.when(enough, F.col("amplitude")).alias("amplitude"), "threshold",
    )


def first_board_effect(placed: DataFrame, gap_minutes: int = STOP_GAP_MINUTES) -> DataFrame:
    """One row: boards that follow a stop against all others.

    The board before is found by its position, so no window has to hold a series.
    """
    before = placed.select((F.col("place") + 1).alias("place"), F.col("ts").alias("before"))
    after_stop = F.unix_micros("ts") - F.unix_micros("before") >= gap_minutes * 60_000_000
    boards = placed.where("mean_avdp IS NOT NULL").join(before, "place", "left").withColumn(
        "first", F.coalesce(after_stop, F.lit(False)))
    first, failed = F.col("first"), F.col("ng_count") > 0
    found = boards.agg(
        F.count_if(first).alias("first_boards"), F.count_if(~first).alias("other_boards"),
        F.count_if(first & failed).alias("first_ng_boards"), F.count_if(~first & failed).alias("other_ng_boards"),
        F.avg(F.when(first, F.col("mean_avdp"))).alias("first_mean"),
        F.avg(F.when(~first, F.col("mean_avdp"))).alias("other_mean"),
    ).withColumn("delta", F.col("first_mean") - F.col("other_mean"))
    found = _with_threshold(found, placed)
    return found.select(
        F.when((F.col("first_boards") < MIN_FIRST_BOARDS) | (F.col("other_boards") == 0), "insufficient")
        .otherwise(_effect(F.col("delta"))).alias("verdict"),
        "first_boards", "other_boards", "first_ng_boards", "other_ng_boards", "first_mean", "other_mean", "delta", "threshold",
    )


def print_direction_effect(placed: DataFrame) -> DataFrame:
    """One row: the range of means per direction, or a proxy where none is recorded.

    Without two directions the difference of odd and even boards is reported, and
    whether the pressures vary; neither is a verdict.
    """
    named = placed.where("printdirection <> ''")
    groups = named.groupBy("printdirection").agg(F.round(F.avg("mean_avdp"), 2).alias("mean"))
    found = groups.agg(
        F.count(F.lit(1)).alias("directions"), (F.max("mean") - F.min("mean")).alias("delta"))
    odd = F.col("place") % 2 == 1
    proxy = placed.agg(
        (F.avg(F.when(odd, F.col("mean_avdp"))) - F.avg(F.when(~odd, F.col("mean_avdp")))).alias("proxy"))
    pressures = (
        placed.where("frontsqgpress IS NOT NULL OR rearsqgpress IS NOT NULL")
        .groupBy("frontsqgpress", "rearsqgpress").agg(F.lit(1)).agg((F.count(F.lit(1)) > 1).alias("varies")))
    found = _with_threshold(found, placed).withColumns({
        "odd_even_proxy": proxy.scalar(), "pressure_varies": pressures.scalar()})
    two = F.col("directions") >= 2
    return found.select(
        F.when(two, _effect(F.col("delta"))).otherwise("not_collected").alias("verdict"),
        "directions", F.when(two, F.col("delta")).alias("delta"), "threshold", "odd_even_proxy", "pressure_varies",
    )
