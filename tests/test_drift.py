"""The drift monitor on small made-up series."""

import datetime as dt
import math
import random
from collections import deque

import numpy as np
import pytest

from boardlens.operators import drift as D
from boardlens.operators import parameters as P

SCHEMA = ("cmodel string, compname string, ts timestamp, barcode string, fdate string, row_id bigint, ng boolean, "
          "comp_avdp double, comp_aadp double, comp_ahdp double, floor_before double")
START = dt.datetime(2024, 1, 9)


def points(spark, values, pad="C1_1", ng=(), floor=None, parts=4):
    """A row per board; a value is a number for the volume or a triple."""
    rows = []
    for k, v in enumerate(values):
        v = v if isinstance(v, tuple) else (v, 10.0 + k % 2, 10.0 + k % 3)
        rows.append(("M", pad, START + dt.timedelta(minutes=k), f"B{k:05d}", f"t{k:05d}", k, k in ng, *v, floor))
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain_walk(values, ng, lam=0.2, width=4.0):
    """The chart of one metric, written as a loop."""
    base, out = deque(), []
    z = mu = sd = limit = None
    above = False
    for k, v in enumerate(values):
        if v is not None:
            if z is not None:
                z = lam * v + (1 - lam) * z
                above = z > limit
            if not above and k not in ng:
                base.append(v)
                if len(base) > 200:
                    base.popleft()
                if len(base) >= 30:
                    mu = sum(base) / len(base)
                    sd = max(math.sqrt(max(sum(x * x for x in base) / len(base) - mu * mu, 0)), 0.01)
                    limit = mu + width * sd * math.sqrt(lam / (2 - lam))
                    z = mu if z is None else z
        out.append((z, limit))
    return out


def noise(n, seed=1):
    pick = random.Random(seed)
    return [10 + pick.choice((-1, 0, 0, 1)) + pick.random() for _ in range(n)]


@pytest.mark.parametrize("batch", [7, 100_000])
def test_trace_equals_a_plain_loop_over_batch_borders(spark, batch):
    values = noise(260) + [10 + 0.4 * k for k in range(40)] + noise(60, 2)
    gaps = {5, 120, 300}
    df = points(spark, [(None if k in gaps else v, 10.0, None) for k, v in enumerate(values)], ng={40, 41})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = D.walked(df).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = plain_walk([None if k in gaps else v for k, v in enumerate(values)], {40, 41})
    for r, (z, limit) in zip(rows, want, strict=True):
        assert (r.ewma[0] is None) == (z is None) and (z is None or math.isclose(r.ewma[0], z, rel_tol=1e-9))
        assert limit is None or math.isclose(r.upper[0], limit, rel_tol=1e-9)
        assert r.ewma[2] is None


def test_limit_stands_still_while_in_alarm(spark):
    rows = D.walked(points(spark, noise(200) + [30.0] * 60)).orderBy("idx").collect()
    high = [r for r in rows if r.crossed[0]]
    assert len(high) > 50 and len({r.upper[0] for r in high}) == 1


def test_levels_and_episodes(spark):
    values = noise(100) + [30.0] * 10 + noise(60, 3) + [30.0] * 4
    walk = D.walked(points(spark, values))
    totals = D.series_totals(walk)
    found = D.episodes(D.graded(walk), totals).orderBy("start_index").collect()
    assert [f.end_index is None for f in found] == [False, True]
    assert found[0].start_index == 100 and found[0].l2_index == 102 and found[0].metrics == ["comp_avdp"]


def test_three_rises_make_level_three(spark):
    # Volumes rise four times in a row, or the smallest failing volume is reached.
    for tail, floor, level in (([30.0, 31.0, 32.0, 33.0], None, 3), ([30.0] * 4, None, 2), ([30.0] * 4, 29.0, 3), ([30.0] * 4, 31.0, 2)):
        walk = D.walked(points(spark, noise(100) + tail, floor=floor))
        assert max(r.level for r in D.graded(walk).collect()) == level


def test_grid_equals_single_pairs(spark):
    df = points(spark, noise(300) + [10 + 0.1 * k for k in range(80)])
    together = D.walked(df, D.GRID).orderBy("idx").collect()
    for k in (0, 4, 8):
        alone = D.walked(df, [D.GRID[k]]).orderBy("idx").collect()
        assert all(np.allclose([x or 0 for x in a.ewma], [x or 0 for x in t.ewma[3 * k:3 * k + 3]]) for a, t in zip(alone, together, strict=True))


def test_floors_are_read_strictly_before(spark):
    rows = [(START + dt.timedelta(minutes=m), ng, v) for m, ng, v in [(0, True, 50.0), (0, True, 40.0), (1, False, 1.0), (2, True, 0.0), (3, True, 60.0), (4, True, 30.0), (5, False, 2.0)]]
    got = D.ng_floors(spark.createDataFrame([*rows, (None, True, 3.0)], "ts timestamp, ng boolean, comp_avdp double")).orderBy("ts").collect()
    assert [r.floor_before for r in got] == [None, 40.0, 40.0, 40.0, 40.0, 30.0]


def test_every_accepted_level_becomes_the_baseline(spark):
    """Eight steps, each accepted: more rounds than any fixed number the series might have been given."""
    steps = [v + 20 * level for level in range(8) for v in noise(60, level)]
    df = points(spark, steps)
    ids = df.select(D.stable_id("WRN-", "cmodel", "compname", "barcode", "fdate").alias("warning_id"))
    walk = D.with_accepted(df, ids)
    rows = walk.orderBy("idx").collect()
    assert {r.restarts for r in rows} == {7} and 55 <= len(rows) <= 60
    none = D.with_accepted(df, ids.where("false")).collect()
    assert {r.restarts for r in none} == {0} and len(none) == len(steps)


def test_backtest_counts_hits_and_false_alarms(spark):
    pad = points(spark, noise(100) + [30.0] * 5 + noise(30, 3) + [40.0], ng={135})
    board = points(spark, [(10.0, 10.0, 10.0)] * 136, pad="__board__")
    walk = D.walked(pad.unionByName(board))
    totals = D.series_totals(walk)
    found = D.episodes(D.graded(walk), totals)
    score = D.backtest(found, walk, totals).first()
    assert (score.l2_episode_count, score.hit_count, score.total_boards) == (1, 1, 136)
    lead = D.outcomes(found, totals).first()
    assert lead.lead_boards == 135 - 102 and lead.warned_within_horizon


ROWS = "barcode string, cmodel string, abs_speed double, abs_gap double"


def check(spark, rows, groups):
    df = spark.createDataFrame(rows, ROWS)
    members = spark.createDataFrame(groups, "group_id string, cmodel string, barcode string")
    return {(r.group_id, r.parameter): (r.group_max, r.baseline_max, r.drifted, r.cross_model) for r in P.parameter_check(df, members).collect()}


def test_parameter_check_leaves_the_group_out(spark):
    rows = [("a", "M", 5.0, 1.0), ("b", "M", 9.0, None), ("c", "M", 4.0, None), ("d", "M", 3.0, 2.0), ("a", "M", 6.0, None)]
    got = check(spark, rows, [("g", "M", "a"), ("g", "M", "b"), ("h", "M", "c"), ("h", "M", "c")])
    assert got[("g", "speed")] == (9.0, 4.0, True, False) and got[("g", "gap")] == (1.0, 2.0, False, False)
    assert got[("h", "speed")] == (4.0, 9.0, False, False) and got[("h", "gap")] == (None, 2.0, False, False)


def test_parameter_check_falls_back_to_other_models(spark):
    rows = [("a", "M", 5.0, 1.0), ("x", "N", 4.0, None), ("y", "N", 7.0, None)]
    got = check(spark, rows, [("g", "M", "a")])
    assert got[("g", "speed")] == (5.0, 7.0, False, True) and got[("g", "gap")] == (1.0, None, True, True)


def test_parameter_check_equals_brute_force(spark):
    pick = random.Random(8)
    rows = [(f"b{pick.randrange(60)}", pick.choice("MN"), pick.choice((None, float(pick.randrange(30)))), float(pick.randrange(30))) for _ in range(150)]
    groups = [(f"g{g}", pick.choice("MN"), f"b{b}") for g in range(12) for b in pick.sample(range(60), pick.choice((1, 5, 50)))]
    groups = [(g, "M" if g < "g5" else "N", b) for g, _, b in groups]
    got = check(spark, rows, groups)
    for g in {x[0] for x in groups}:
        boards, model = {x[2] for x in groups if x[0] == g}, next(x[1] for x in groups if x[0] == g)
        same = [r for r in rows if r[0] not in boards and r[1] == model]
        others = same or [r for r in rows if r[0] not in boards]
        for k, name in ((2, "speed"), (3, "gap")):
            inside = [r[k] for r in rows if r[0] in boards and r[k] is not None]
            usual = max([r[k] for r in others if r[k] is not None], default=None)
            if any(r[0] in boards for r in rows):
                top = max(inside, default=None)
                assert got[(g, name)] == (top, usual, top is not None and (usual is None or top > usual), not same)
