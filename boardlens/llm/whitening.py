"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers; the distinct vectors, centred on their mean, are the
rows of X. Starting from a fixed direction v, each step takes the products u = Xv
and X'u over the distributed rows and keeps only small vectors: with full
reorthogonalisation of both sides, X V = U B for an upper bidiagonal B, and after as
many steps as there are dimensions B has exactly the singular values of X. The SVD
of that small matrix gives the components and their deviations.

A left vector is as long as the table, so none is stored: each is Xg for a small g,
and a task forms the ones it needs from its rows. So one pass over the rows serves
both products and the inner products of reorthogonalisation; partial sums are added
up by a grouping, and the driver sees a few numbers a step. A step whose product
vanishes starts anew from another direction, so equal deviations are all found.

Defined cases: vectors that are NULL or hold NULL, non-finite or too large entries
(beyond a long) are dropped, and so are those whose length is not the most frequent
one (the greatest of equally frequent ones); directions without deviation give no
component; a table without vectors, or with equal ones only, gives no rows; repeated
rows count once in the fit and come back each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null
from boardlens.session import settled

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
VANISHED = 1e-12
_LIMIT = 1 << 62


class Fit(NamedTuple):
    """What the fit list gives: n, sums and, by falling eigenvalue, unit components (rows) and eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the vector in whole numbers; rows without a usable vector are dropped."""
    entries = columns_or_null(embeddings, vec_id="bigint", embedding="array<double>")
    scaled = F.transform("embedding", lambda c: F.floor(c * SCALE + 0.0))
    usable = F.size("embedding") > 0
    sound = F.forall("embedding", lambda c: F.coalesce(F.abs(c) < 2.0**50, F.lit(False)))
    rows = entries.where(usable & sound).select(
        "vec_id", F.transform(scaled, lambda c: c.cast("bigint") + SHIFT).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dims")).count()
    usual = lengths.agg(F.max_by("dims", F.struct("count", "dims")))
    return rows.where(F.size("x") == usual.scalar())


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as blocks of rows: their number, whole values, and exact sums of values and squares."""
    for batch in batches:
        for a in range(0, len(batch), BLOCK_ROWS):
            part = _matrix(batch.column("x").slice(a, BLOCK_ROWS))
            wide = part.astype(object)
            yield pa.RecordBatch.from_pydict({
                "rows": pa.array([len(part)], pa.int64()), "block": [part.tobytes()],
                "sums": pa.array([[str(s) for s in wide.sum(axis=0)]], pa.list_(pa.string())),
                "squares": pa.array([[str(s) for s in (wide * wide).sum(axis=0)]], pa.list_(pa.string()))})


def _centred(block: bytes, n: int, sums: list[int]) -> np.ndarray:
    """Rows less their mean: the exact n*x - S, then divided, so nothing cancels."""
    x = np.frombuffer(block, np.int64).reshape(-1, len(sums))
    mean = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - int(m)) for s, m in zip(sums, mean, strict=True)])
    return (x - mean) - rest


def _summed(blocks: DataFrame, partial, size: int) -> np.ndarray:
    """Sum over all blocks of a vector that ``partial(block, rows)`` gives for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.column("block"):
                total += partial(block.as_buffer())
        yield pa.RecordBatch.from_pydict({"i": np.arange(size, dtype=np.int32), "v": total})

    found = blocks.select("block").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r.i] = r.v
    return out


def _unit(vector: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """Orthogonal to all of ``against`` (twice, which is enough), of length 1."""
    for _ in range(2):
        for v in against:
            vector = vector - v * (v @ vector)
    return vector / np.linalg.norm(vector)


def _start(dims: int, step: int, against: list[np.ndarray]) -> np.ndarray:
    return _unit(np.random.default_rng(1000 + step).standard_normal(dims), against)


def bidiagonalised(blocks: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """V (columns) and B with X V = U B, B upper bidiagonal, one pass over the rows a step."""
    dims = len(sums)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # g of each u = Xg
    images: list[np.ndarray] = []  # X'u of each u
    alphas, betas = [], []
    v, beta, top = _start(dims, 0, []), 0.0, 0.0
    for step in range(dims):
        g = v - beta * left[-1] if step and beta else v
        known = np.column_stack(left) if left else np.zeros((dims, 0))

        def partial(block, g=g, known=known):
            x = _centred(block, n, sums)
            u = x @ g
            return np.concatenate((x.T @ u, (x @ known).T @ u, [u @ u]))

        out = _summed(blocks, partial, dims + len(left) + 1)
        image, along, square = out[:dims], out[dims:-1], out[-1]
        # u less its part along earlier left vectors; its image and length follow from theirs.
        for h, other, its in zip(along, left, images, strict=True):
            g, image = g - h * other, image - h * its
        alpha = float(np.sqrt(max(square - along @ along, 0.0)))
        top = max(top, alpha)
        right.append(v)
        betas.append(beta)
        if alpha <= VANISHED * top:
            # Nothing deviates along v: a zero row, and a new direction.
            alphas.append(0.0)
            left.append(np.zeros(dims))
            images.append(np.zeros(dims))
            beta = 0.0
        else:
            alphas.append(alpha)
            left.append(g / alpha)
            images.append(image / alpha)
            w = images[-1] - alpha * v
            for _ in range(2):
                for r in right:
                    w = w - r * (r @ w)
            beta = float(np.linalg.norm(w))
        if step + 1 < dims:
            if beta <= VANISHED * top:
                beta, v = 0.0, _start(dims, step + 1, right)
            else:
                v = w / beta
    matrix = np.diag(alphas)
    for k in range(1, dims):
        matrix[k - 1, k] = betas[k]
    return np.column_stack(right), matrix


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame] | None:
    """The components of the distinct vectors of ``whole_vectors``, and the distinct vectors in blocks."""
    blocks = settled(
        vectors.select("x").distinct().mapInArrow(_pack, "rows bigint, block binary, sums array<string>, squares array<string>"), "fit-list")
    exact = blocks.select("rows", F.posexplode(F.arrays_zip("sums", "squares")).alias("i", "s")).groupBy("i").agg(
        F.sum("rows").alias("n"), F.sum(F.col("s.sums").cast("decimal(38,0)")).alias("sum"),
        F.sum(F.col("s.squares").cast("decimal(38,0)")).alias("square")).orderBy("i").collect()
    if not exact:
        return None
    n, sums = int(exact[0]["n"]), [int(r["sum"]) for r in exact]
    trace = sum(Fraction(n * int(r["square"]) - int(r["sum"]) ** 2, n * n) for r in exact)
    if not trace:
        return None
    right, matrix = bidiagonalised(blocks, n, sums)
    _, deviations, turned = np.linalg.svd(matrix)
    found = int(min(components, (deviations > VANISHED * deviations[0]).sum()))
    eigenvalues = deviations[:found] ** 2 / n
    vectors_ = np.ascontiguousarray((right @ turned.T)[:, :found].T)
    vectors_ /= np.linalg.norm(vectors_, axis=1, keepdims=True)
    return Fit(n, sums, vectors_, eigenvalues, eigenvalues / float(trace)), blocks


def identity_error(blocks: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.eigenvalues)
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def partial(block):
        w = _centred(block, model.n, model.sums) @ turn
        return (w.T @ w).ravel()

    return float(np.abs(_summed(blocks, partial, k * k).reshape(k, k) / model.n - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component.

    vec_id, component, n, deviation (sum of squares of n*x - S, exact, NULL beyond a
    long), whitened, explained, and identity_error, the same for all rows.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings)
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    fitted = fit(vectors, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    model, blocks = fitted
    error = identity_error(blocks, model)
    k = len(model.eigenvalues)
    turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                x = _matrix(batch.column("x").slice(a, BLOCK_ROWS))
                whitened = _centred(x.tobytes(), model.n, model.sums) @ turn
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column("vec_id").slice(a, BLOCK_ROWS).to_pandas(), k), pa.int64(), from_pandas=True),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n)), pa.array([d for d in _deviations(x, model) for _ in range(k)], pa.int64()),
                    pa.array(whitened.ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ], [c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(run, schema)


def _deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Exact sums of squares of n*x - S; long arithmetic where it must fit, Python's numbers else."""
    sums, dims = model.sums, len(model.sums)
    low, high = x.min(axis=0), x.max(axis=0)
    most = max(max(abs(model.n * int(a) - s), abs(model.n * int(b) - s)) for a, b, s in zip(low, high, sums, strict=True))
    largest = model.n * max(abs(int(low.min())), abs(int(high.max())))
    if most * most * dims < _LIMIT and largest < _LIMIT and max(map(abs, sums)) < _LIMIT:
        d = model.n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [d if d < 1 << 63 else None for d in exact]
