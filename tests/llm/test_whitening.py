"""Whitening against numpy's eigenvectors, with exact integers, and its edge cases."""

import math

import numpy as np
import pytest

from boardlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept}
    return n, values[::-1], vectors[:, ::-1], {i: (np.array(x) * n - np.array(sums)) / n for i, x in kept}, deviation


def check(spark, rows, components=None):
    n, values, vectors, centred, deviation = expected(rows)
    k = components or int(min(16, (values > 1e-9 * values[0]).sum()))
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == k * len(centred)
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        want = {i: x @ vectors[:, c - 1] / math.sqrt(values[c - 1]) for i, x in centred.items()}
        have = {i: by[i, c].whitened for i in centred}
        far = max(want, key=lambda i: abs(want[i]))
        sign = math.copysign(1, want[far] * have[far])
        assert max(abs(want[i] * sign - have[i]) for i in want) < 1e-7
        assert {by[i, c].explained for i in centred} == {by[far, c].explained}
        assert abs(by[far, c].explained - values[c - 1] / values.sum()) < 1e-9
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9 for r in got)


def test_equals_eigenvectors(spark):
    table = np.random.default_rng(5).standard_normal((300, 24)) @ np.diag(1 / np.arange(1, 25))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(table)]
    check(spark, [*rows, *[(1000 + i, rows[0][1]) for i in range(200)]])


def test_few_vectors_give_few_components(spark):
    table = np.random.default_rng(6).standard_normal((5, 20))
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(table)])


def test_equal_deviations_are_all_found(spark):
    # Axis pairs of three lengths: three eigenvalues, each of a plane or more.
    rows = []
    for d in range(8):
        for sign in (1, -1):
            rows.append((len(rows), [float(sign * (1 + d // 3)) if j == d else 0.0 for j in range(8)]))
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    explained = sorted({(r.component, round(r.explained, 9)) for r in got})
    total = 3 * 1 + 3 * 4 + 2 * 9
    assert [e for _, e in explained] == [round(x / total, 9) for x in (9, 9, 4, 4, 4, 1, 1, 1)]
    assert all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    rows = [(1, [1.0, 2.0, 4.5]), (2, [0.5, 7.0, 1.0]), (2, [0.5, 7.0, 1.0]), (None, [3.0, 1.0, 1.0]), (3, None), (4, [1.0, None, 2.0]),
            (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [1.0, 2.0]), (9, [-3.0, 2.5, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: df["vec_id"] for c in ("x", "n", "block", "component", "i", "v")})
    got = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, c) for i in ("1", "2", "2", "None", "9") for c in (1, 2, 3))
    assert {r.n for r in got} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_deviation(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [1e10 * (i % 3), float(i), 0.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and all(r.identity_error < 1e-4 for r in got)
