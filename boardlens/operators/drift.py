"""Drift monitor: a control chart per series and metric whose baseline freezes while in alarm.

Deviations are magnitudes, so only an upper limit is watched. Every metric of a
series keeps an exponentially weighted mean, the last 200 clean values as its
baseline, and a limit from their mean and spread. Whether a value is clean depends
on the alarm it may raise, so the walk is sequential along a series and parallel
over series; several (weight, limit) pairs are walked in the same pass. Grading,
episodes and scores are plain aggregates of the walk's trace.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions.fold import ordered_fold
from boardlens.functions.ordered import range_join, ranked
from boardlens.functions.scalars import stable_id
from boardlens.operators.inspections import SERIES_ORDER, board_mean_points, monitor_points
from boardlens.schema import (
    BOARD_SERIES, EWMA_LAMBDA, EWMA_LIMIT, EWMA_MIN_CLEAN, EWMA_WINDOW, HIT_HORIZON, L2_METRICS, L2_STREAK, L3_RISE, METRICS,
    PAGE_LEVEL, RECOVERY_BOARDS, SERIES_CONTEXT, SIGMA_BAND, SIGMA_FLOOR, STALE_BOARDS,
)
from boardlens.session import settled

SERIES = ["cmodel", "compname"]
DEFAULT = ((EWMA_LAMBDA, EWMA_LIMIT),)
# The grid of weights and limits that a back-test compares.
GRID = tuple((lam, limit) for lam in (0.1, 0.2, 0.3) for limit in (2.5, 3.0, 3.5))
_LANES = ("ewma", "center", "sigma", "upper")
TRACE = (
    "idx bigint, " + ", ".join(f"{c} array<double>" for c in _LANES)
    + ", crossed array<boolean>, streak array<int>, rising array<boolean>, start array<bigint>")


class Lane:
    """State of one metric under one (weight, limit) pair."""

    def __init__(self, weight: float, width: float):
        self.weight, self.width, self.width_of = weight, width, math.sqrt(weight / (2.0 - weight))
        self.ring, self.place, self.learnt, self.total, self.squares = [0.0] * EWMA_WINDOW, 0, 0, 0.0, 0.0
        self.ewma = self.center = self.sigma = self.upper = math.nan
        self.above, self.streak = False, 0

    def walk(self, values: list[float], failing: list[bool], full: bool) -> tuple[list[int], ...]:
        """Consecutive boards: move, compare, then learn if clean. The alarm's length after each; with ``full`` mean, centre, spread and limit too.

        A loop over plain numbers: arrays of three lanes are too short for their overhead.
        """
        w, rest, width, width_of, ring, sqrt = self.weight, 1.0 - self.weight, self.width, self.width_of, self.ring, math.sqrt
        place, learnt, total, squares = self.place, self.learnt, self.total, self.squares
        z, mean, sigma, upper, above, streak = self.ewma, self.center, self.sigma, self.upper, self.above, self.streak
        streaks, means, centers, sigmas, uppers = [], [], [], [], []
        for v, bad in zip(values, failing, strict=True):
            if v == v:  # a value is there
                if z == z:
                    z = w * v + rest * z
                    above = z > upper
                    streak = streak + 1 if above else 0
                if not (above or bad):
                    old = ring[place]  # 0 until the window is full
                    ring[place] = v
                    total = total + v - old
                    squares = squares + v * v - old * old
                    place += 1
                    if place == EWMA_WINDOW:
                        place = 0
                    if learnt < EWMA_WINDOW:
                        learnt += 1
                    if learnt >= EWMA_MIN_CLEAN:
                        mean = total / learnt
                        spread = squares / learnt - mean * mean
                        if spread > 0.0:
                            sigma = sqrt(spread)
                            if sigma < SIGMA_FLOOR:
                                sigma = SIGMA_FLOOR
                        else:
                            sigma = SIGMA_FLOOR if spread <= 0.0 else spread
                        upper = mean + width * sigma * width_of
                        if z != z:
                            z = mean
            streaks.append(streak)
            if full:
                means.append(z)
                centers.append(mean)
                sigmas.append(sigma)
                uppers.append(upper)
        self.place, self.learnt, self.total, self.squares = place, learnt, total, squares
        self.ewma, self.center, self.sigma, self.upper, self.above, self.streak = z, mean, sigma, upper, above, streak
        return streaks, means, centers, sigmas, uppers


class Monitor:
    """State of one series: a lane for every (weight, limit) pair and metric, pair by pair."""

    def __init__(self, pairs: Sequence[tuple[float, float]]):
        self.pairs, self.index = len(pairs), 0
        self.lanes = [Lane(float(lam), float(limit)) for lam, limit in pairs for _ in METRICS]
        self.last, self.rise = [math.nan] * len(METRICS), [0] * len(METRICS)
        self.before, self.start = [None] * len(pairs), [-1] * len(pairs)  # last crossing, and where its episode began

    def _rises(self, k: int, values: list[float]) -> list[bool]:
        """Whether a metric has risen often enough in a row, at each board."""
        last, rise, out = self.last[k], self.rise[k], []
        for v in values:
            if v == v:
                rise = rise + 1 if v > last else 0
                last = v
            out.append(rise >= L3_RISE)
        self.last[k], self.rise[k] = last, rise
        return out

    def _starts(self, pair: int, crossed: np.ndarray) -> np.ndarray:
        """Where the episode began of every crossing board, -1 for the others: crossings until so many quiet boards."""
        out = np.full(len(crossed), -1, np.int64)
        at = np.flatnonzero(crossed)
        if len(at):
            index = at + self.index
            before = self.before[pair]
            new = np.diff(index, prepend=index[0] if before is None else before) > RECOVERY_BOARDS
            new[0] |= before is None
            begun = np.where(new, index, -1)
            begun[0] = begun[0] if new[0] else self.start[pair]
            out[at] = np.maximum.accumulate(begun)
            self.before[pair], self.start[pair] = int(index[-1]), int(out[at[-1]])
        return out

    def walk(self, rows: pa.RecordBatch, full: bool = True) -> dict[str, pa.Array]:
        """The trace of consecutive boards; if not ``full``, means and limits are given at the last of them only."""
        n, lanes, m = len(rows), len(self.lanes), len(METRICS)
        table = np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in METRICS])
        values, seen = table.T.tolist(), ~np.isnan(table)
        failing = rows.column("ng").to_pylist()
        shown = n if full else 1
        kept = {c: np.empty((shown, lanes)) for c in _LANES}
        rising = np.empty((n, lanes), bool)
        streak, start = np.empty((n, lanes), np.int32), np.empty((n, self.pairs), np.int64)
        for k, lane in enumerate(self.lanes):
            streak[:, k], *moved = lane.walk(values[k % m], failing, full)
            for c, column in zip(_LANES, moved, strict=True):
                kept[c][:, k] = column if full else getattr(lane, c)
        crossed = (streak > 0) & np.tile(seen, (1, self.pairs))
        for k in range(m):
            rising[:, k::m] = np.array(self._rises(k, values[k]))[:, None]
        for p in range(self.pairs):
            start[:, p] = self._starts(p, crossed[:, p * m:(p + 1) * m].any(axis=1))
        first = self.index
        self.index += n

        def lists(table: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
            flat = pa.array(table.ravel(), mask=None if missing is None else missing.ravel())
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), flat)
            return out if len(out) == n else pa.concat_arrays([pa.nulls(n - len(out), out.type), out])

        return {
            "idx": pa.array(np.arange(first, first + n)), **{c: lists(t, np.isnan(t)) for c, t in kept.items()},
            "crossed": lists(crossed), "streak": lists(streak), "rising": lists(rising), "start": lists(start, start < 0)}

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def load(cls, data: bytes) -> Monitor:
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(data))
        return out


def ng_floors(firsts: DataFrame) -> DataFrame:
    """Per distinct time: the smallest positive failing volume at strictly earlier times, and ``floor``, up to and at it.

    ``firsts`` are first-inspection rows. Times are reduced to a row each before they
    are cut into range slices, whose minima are carried forward in a row a slice.
    """
    lows = firsts.where("ts IS NOT NULL").groupBy("ts").agg(
        F.min(F.when(F.col("ng") & (F.col("comp_avdp") > 0), F.col("comp_avdp"))).alias("low"))
    cut = settled(lows.repartitionByRange("ts").withColumn("slice", F.spark_partition_id()), "floor-slices")
    earlier = Window.partitionBy("slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    slices = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("slice").agg(F.min("low").alias("least")).select("slice", F.min("least").over(slices).alias("carried"))
    return cut.withColumn("inside", F.min("low").over(earlier)).join(carried, "slice").select(
        "ts", F.least("inside", "carried").alias("floor_before"), F.least("inside", "carried", "low").alias("floor"))


def watched_points(rows: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Points of all pads and the board means of every model; of a time without points of pads there are none.

    ``floors``, if at hand, tell the times.
    """
    columns = [*SERIES, *SERIES_ORDER, "ng", *METRICS]
    points, means = monitor_points(rows).select(*columns), board_mean_points(rows)
    times = (points if floors is None else floors).select("ts").distinct()
    unnamed = means.where("NOT named").join(times, "ts", "left_semi")
    return points.unionByName(means.where("named").unionByName(unnamed).select(*columns))


def with_floors(points: DataFrame, floors: DataFrame) -> DataFrame:
    """``points`` with the floor before their time."""
    return points.join(floors.select("ts", "floor_before"), "ts", "left")


def walked(points: DataFrame, pairs: Sequence[tuple[float, float]] = DEFAULT) -> DataFrame:
    """The trace of every series: arrays with a place for each (pair, metric), ``start`` for each pair."""
    pairs = tuple(pairs)
    return ordered_fold(points, SERIES, SERIES_ORDER, lambda: Monitor(pairs), Monitor.walk, TRACE)


def _noted(rows: pa.RecordBatch) -> np.ndarray:
    starts = rows.column("start")
    begun = starts.values.slice(starts.offsets[0].as_py(), len(starts.flatten())).is_valid().to_numpy(zero_copy_only=False)
    return begun.reshape(len(rows), -1).any(axis=1) | rows.column("ng").to_numpy(zero_copy_only=False)


def marked(points: DataFrame, pairs: Sequence[tuple[float, float]] = DEFAULT) -> DataFrame:
    """The part of the trace that grades, totals and health are made of: crossing and failing points, and every series' last one.

    A series' last point has its means and limits, most others have NULL there. The
    whole trace is several times as large as the points and is not written.
    """
    pairs = tuple(pairs)
    return ordered_fold(
        points, SERIES, SERIES_ORDER, lambda: Monitor(pairs), lambda state, rows: state.walk(rows, full=False), TRACE, keep=_noted)


def metric_trace(trace: DataFrame) -> DataFrame:
    """A row per point and metric of a one-pair trace: mean, centre, spread, limit and the alarm's length."""
    return trace.select(*SERIES, "idx", "barcode", "fdate", F.posexplode(F.arrays_zip(*_LANES, "crossed", "streak")).alias("k", "l")).select(
        *SERIES, "idx", "barcode", "fdate", F.element_at(F.array(*[F.lit(m) for m in METRICS]), F.col("k") + 1).alias("metric"),
        *[F.col(f"l.{c}").alias(c) for c in (*_LANES, "crossed", "streak")])


def graded(trace: DataFrame, pairs: Sequence[tuple[float, float]] = DEFAULT) -> DataFrame:
    """A row per crossing board and pair with its level (1 to 3) and metrics.

    Level 2 from three boards in a row or two metrics at once; level 3 if, besides, a
    crossing metric has risen three times in a row or the volume has reached the
    smallest failing one seen before.
    """
    m = len(METRICS)
    lanes = [F.struct(F.lit(float(lam)).alias("lam"), F.lit(float(limit)).alias("limit"), F.get("start", F.lit(k)).alias("start"), *[
        F.slice(c, k * m + 1, m).alias(c) for c in ("crossed", "streak", "rising")]) for k, (lam, limit) in enumerate(pairs)]
    rows = trace.select(
        *SERIES, "ts", "barcode", "fdate", "row_id", "idx", "comp_avdp", "floor_before", F.explode(F.array(*lanes)).alias("p")
    ).where("p.start IS NOT NULL").select("*", "p.*").drop("p")

    def of(name: str, k: int) -> Column:
        return F.get(name, F.lit(k))

    count = sum((of("crossed", k).cast("int") for k in range(m)), F.lit(0))
    longest = F.greatest(*[F.when(of("crossed", k), of("streak", k)).otherwise(0) for k in range(m)])
    second = (longest >= L2_STREAK) | (count >= L2_METRICS)
    band = of("crossed", 0) & F.coalesce(F.col("comp_avdp") >= F.col("floor_before"), F.lit(False))
    third = band
    for k in range(m):
        third = third | (of("crossed", k) & of("rising", k))
    return rows.withColumns({
        "n_metrics": count, "longest": longest, "level": F.when(second & third, 3).when(second, 2).otherwise(1)})


def series_totals(points: DataFrame) -> DataFrame:
    """Boards and failing boards of every series, and the position of the first failing one; of a trace or its marked points."""
    return points.groupBy(*SERIES).agg(
        (F.max("idx") + 1).alias("boards"), F.count_if("ng").alias("ng_count"),
        F.min(F.when(F.col("ng"), F.struct("idx", "barcode", "fdate"))).alias("first_ng"))


def episodes(grades: DataFrame, totals: DataFrame) -> DataFrame:
    """Crossings of a series until three quiet boards, as one row each; ``end_index`` is NULL while it lasts."""
    board = F.struct("ts", "barcode", "fdate", "row_id")
    m = range(len(METRICS))
    second, third = (F.min(F.when(F.col("level") >= k, F.struct("idx", "fdate"))) for k in (2, 3))
    found = grades.groupBy(*SERIES, "lam", "limit", "start").agg(
        F.min_by(board, "idx").alias("at"), F.max("level").alias("level"), F.count(F.lit(1)).alias("boards_above"),
        F.max("idx").alias("last_index"), second.alias("second"), third.alias("third"),
        *[F.bool_or(F.get("crossed", F.lit(k))).alias(f"m{k}") for k in m])
    names = F.array_compact(F.array(*[F.when(F.col(f"m{k}"), F.lit(METRICS[k])) for k in m]))
    sized = totals.select(*[F.col(c).alias(f"_{c}") for c in SERIES], "boards")
    return found.join(sized, [F.col(c) == F.col(f"_{c}") for c in SERIES]).select(
        stable_id("WRN-", *SERIES, "at.barcode", "at.fdate").alias("warning_id"), *SERIES, "lam", "limit",
        F.col("start").alias("start_index"), "at", F.col("at.barcode").alias("start_barcode"), F.col("at.fdate").alias("start_time"),
        "level", "boards_above", F.array_sort(names).alias("metrics"), "last_index", F.col("second.idx").alias("l2_index"),
        F.col("second.fdate").alias("l2_time"), F.col("third.idx").alias("l3_index"),
        F.when(F.col("boards") - 1 - F.col("last_index") >= RECOVERY_BOARDS, F.col("last_index")).alias("end_index"))


def hits(found: DataFrame, points: DataFrame, horizon: int = HIT_HORIZON) -> DataFrame:
    """Pad episodes of level 2 that a failure of the same pad follows within ``horizon`` boards."""
    episode = [*SERIES, "lam", "limit", "start_index"]
    spans = found.where((F.col("compname") != BOARD_SERIES) & F.col("l2_index").isNotNull()).select(
        *episode, F.col("l2_index").alias("low"), (F.col("l2_index") + horizon).alias("high"))
    failing = points.where(F.col("ng") & (F.col("compname") != BOARD_SERIES)).select(*SERIES, "idx")
    return range_join(spans, failing, SERIES, "low", "high", "idx", horizon).select(*episode).distinct()


def _pairs(pairs: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(lam)).alias("lam"), F.lit(float(limit)).alias("limit")) for lam, limit in pairs])


def outcomes(
    found: DataFrame, totals: DataFrame, pairs: Sequence[tuple[float, float]] = DEFAULT, horizon: int = HIT_HORIZON
) -> DataFrame:
    """Per failing pad and pair: the boards between the last level 2 before its first failure and that failure."""
    pads = totals.where(F.col("first_ng").isNotNull() & (F.col("compname") != BOARD_SERIES)).select(
        *SERIES, F.col("first_ng.idx").alias("first_index"), F.col("first_ng.barcode").alias("first_ng_barcode"),
        F.col("first_ng.fdate").alias("first_ng_time"))
    early = found.where("l2_index IS NOT NULL").join(pads, SERIES).where("l2_index <= first_index").groupBy(
        *SERIES, "lam", "limit").agg(F.max("l2_index").alias("warned"))
    every = pads.select("*", F.explode(_pairs(pairs)).alias("p")).select("*", "p.*").drop("p")
    lead = F.col("first_index") - F.col("warned")
    return every.join(early, [*SERIES, "lam", "limit"], "left").select(
        *SERIES, "lam", "limit", "first_ng_barcode", "first_ng_time", lead.alias("lead_boards"),
        F.coalesce(lead <= horizon, F.lit(False)).alias("warned_within_horizon"))


def backtest(
    found: DataFrame, points: DataFrame, totals: DataFrame, pairs: Sequence[tuple[float, float]] = DEFAULT
) -> DataFrame:
    """Per pair: episodes of level 2, how many a failure followed, and false ones per hundred boards.

    ``total_boards`` is the length of the longest board series.
    """
    hit = hits(found, points).groupBy("lam", "limit").agg(F.count(F.lit(1)).alias("hits"))
    warned = found.where("l2_index IS NOT NULL").groupBy("lam", "limit").agg(F.count(F.lit(1)).alias("l2"))
    every = totals.where(F.col("compname") == BOARD_SERIES).agg(F.coalesce(F.max("boards"), F.lit(0)).alias("total_boards"))
    l2, hit_count = (F.coalesce(c, F.lit(0)) for c in ("l2", "hits"))
    return every.select("total_boards", F.explode(_pairs(pairs)).alias("p")).select("total_boards", "p.*").join(
        warned, ["lam", "limit"], "left").join(hit, ["lam", "limit"], "left").select(
        "lam", "limit", "total_boards", l2.alias("l2_episode_count"), hit_count.alias("hit_count"), (l2 - hit_count).alias("false_count"),
        F.when(F.col("total_boards") > 0, (l2 - hit_count) / F.col("total_boards") * 100).alias("false_per_100_boards"))


def pad_health(trace: DataFrame, found: DataFrame, totals: DataFrame, floors: DataFrame) -> DataFrame:
    """Per series its last state: distance of the volume's mean to the smallest failing value, in three spreads, and the active level."""
    last = trace.groupBy(*SERIES).agg(F.max_by(F.struct(*[F.get(c, F.lit(0)).alias(c) for c in _LANES]), "idx").alias("s"))
    active = found.where("end_index IS NULL").select(*SERIES, "level", F.lit(True).alias("episode_active"))
    joined = totals.join(last, SERIES).join(active, SERIES, "left").withColumn("ng_floor", floors.agg(F.min("floor")).scalar())
    return joined.select(
        *SERIES, (F.col("compname") == BOARD_SERIES).alias("is_board_series"), "boards", "ng_count",
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("episode_active", F.lit(False)).alias("episode_active"),
        *[F.col(f"s.{c}").alias(c) for c in ("ewma", "center", "upper")],
        ((F.col("ng_floor") - F.col("s.ewma")) / (SIGMA_BAND * F.col("s.sigma"))).alias("margin"))


def health_tone(health: DataFrame) -> DataFrame:
    """The colour of a series: danger in alarm or past the floor, warn close to it, muted without a margin."""
    return health.withColumn(
        "tone",
        F.when(F.col("episode_active") | F.coalesce(F.col("margin") < 0, F.lit(False)), "danger")
        .when(F.col("margin") < 0.5, "warn").when(F.col("margin").isNull(), "muted").otherwise("ok"))


def warnings(found: DataFrame) -> DataFrame:
    """Episodes as warnings: those in alarm for a hundred boards await acceptance, other active ones of level 3 page."""
    active = F.col("end_index").isNull()
    pending = active & (F.col("boards_above") >= STALE_BOARDS)
    return found.withColumns({
        "status": F.when(active, "active").otherwise("recovered"), "pending_new_baseline": pending,
        "page_alert": active & (F.col("level") >= PAGE_LEVEL) & ~pending})


def report(warned: DataFrame) -> DataFrame:
    """Warnings with their place in the report: pages first, then active ones, by time."""
    keyed = warned.withColumns({"_a": ~F.col("page_alert"), "_b": F.col("status") != "active", "_ts": F.col("at.ts")})
    return ranked(keyed, ["_a", "_b", "_ts", "warning_id"], "place").drop("_a", "_b", "_ts")


def warning_summary(warned: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of counts."""
    pads = totals.agg(F.count_if(F.col("compname") != BOARD_SERIES).alias("n"))
    return warned.agg(
        F.count_if(F.col("status") == "active").alias("active_episodes"), F.count_if("page_alert").alias("page_alerts"),
        F.count_if("pending_new_baseline").alias("pending_new_baseline")).withColumn("pads_monitored", pads.scalar())


def warning_series(found: DataFrame, trace: DataFrame, totals: DataFrame, context: int = SERIES_CONTEXT) -> DataFrame:
    """Points from ``context`` boards before an episode to its end (or the series' end)."""
    spans = found.join(totals.select(*SERIES, "boards"), SERIES).select(
        "warning_id", *SERIES, F.greatest(F.col("start_index") - context, F.lit(0)).alias("low"),
        F.coalesce("end_index", F.col("boards") - 1).alias("high"))
    points = trace.select(*SERIES, "idx", "barcode", "fdate", "ng", "comp_avdp", F.get("ewma", F.lit(0)).alias("ewma"), F.get("upper", F.lit(0)).alias("upper"))
    return range_join(spans, points, SERIES, "low", "high", "idx", 10 * context).drop(*SERIES, "low", "high")


def with_accepted(points: DataFrame, accepted: DataFrame, floors: DataFrame | None = None, walk: Callable = walked) -> DataFrame:
    """The trace of every series after all accepted warnings, with the number of ``restarts``.

    ``walk`` may be ``marked`` where the marked points of the trace are enough. Floors
    are taken from ``floors``, or the points have them.

    A series whose active episode is in ``accepted`` (warning_id) begins anew at that
    episode's first board, so the shifted level becomes its baseline. Only such
    series are walked again, until none is left: each restart is later than the
    last, so this ends, and there is no limit on rounds.
    """
    final, restarts = None, 0
    while True:
        trace = walk(points)
        trace = settled(trace if floors is None else with_floors(trace, floors), "drift-trace")
        found = episodes(graded(trace), series_totals(trace))
        active = settled(found.where("end_index IS NULL").select("warning_id", *SERIES, F.col("at").alias("from")), "active")
        # A series has one active episode at most; the accepted ids may be many and stay where they are.
        met = accepted.join(F.broadcast(active.select("warning_id")), "warning_id").select("warning_id").distinct()
        again = settled(active.join(met, "warning_id", "left_semi").drop("warning_id"), "restarts")
        ended = trace.join(again, SERIES, "left_anti").withColumn("restarts", F.lit(restarts))
        final = ended if final is None else final.unionByName(ended)
        if again.isEmpty():
            return final
        points = settled(points.join(again, SERIES).where(F.struct(*SERIES_ORDER) >= F.col("from")).drop("from"), "watched")
        restarts += 1
