"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every position, a polynomial of the code
points before it modulo 2^61 - 1. Two of its entries give the hash of the span
between them, so span equality costs two differences, and the longest common
extension of two positions a binary search.

A fingerprint is a sparse prefix array. Its positions, called anchors, depend on
content: a position whose backward window of 16 code points hashes to ``level``
trailing zeros is an anchor of that level, and the lowest level that leaves at most
32 distinct windows is taken. Any two anchors still give the hash of the text
between them. To compare two fingerprints, the finer one drops anchors below the
other's level; common blocks are found by their span hash and extended over as many
blocks as a binary search finds equal. Likeness is twice the matched length over
both lengths: 1 for equal texts, 0 where no block is shared.

Defined cases: NULL text is empty; two empty texts are alike; documents are ordered
by doc_id, NULL first, and by a hash of the text among equal ids; repeated rows each
get a result, one of them as the next of the other; other columns are ignored. Long
texts are read in segments, so arrays stay of a fixed size.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlens.llm.text import columns_or_null, text_of
from boardlens.llm.tokens import mix
from boardlens.session import settled

WINDOW = 16
ANCHORS = 64
SEGMENT = 1 << 19
SAMPLE_A_SLICE = 20
MODULUS = (1 << 61) - 1
BASE = 0x0B7D2F3A91C64E55
_LAST = 63
_P, _M31, _M30, _M29 = (np.uint64((1 << b) - 1) for b in (61, 31, 30, 29))
_ANCHOR = np.dtype([("at", "<u4"), ("level", "u1"), ("hash", "<u8")])
_INVERSE = pow(BASE, -1, MODULUS)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2^61 - 1 of values below it, in halves of 31 bits."""
    s31, s30 = np.uint64(31), np.uint64(30)
    a1, a0, b1, b0 = a >> s31, a & _M31, b >> s31, b & _M31
    cross = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (cross >> s30) + ((cross & _M30) << s31) + a0 * b0)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n at least; kept and doubled on demand, up to a segment and its window."""
    table = _TABLES.get(base, np.ones(1, np.uint64))
    while len(table) <= n:
        table = np.concatenate((table, _times(table, np.uint64(pow(base, len(table), MODULUS)))))
    _TABLES[base] = table
    return table


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix array of code points: entry k is the sum of (c_j + 1) * BASE^j over j < k."""
    n = len(codes)
    value = codes.astype(np.uint64) + np.uint64(1)
    power = _powers(BASE, n)[:n]
    cross = (power >> np.uint64(31)) * value
    term = _reduced((cross >> np.uint64(30)) + ((cross & _M30) << np.uint64(31)) + (power & _M31) * value)
    low = np.cumsum(term & np.uint64(0xFFFFFFFF))
    high = np.cumsum(term >> np.uint64(32))
    out = np.zeros(n + 1, np.uint64)
    out[1:] = _reduced((high >> np.uint64(29)) + ((high & _M29) << np.uint64(32)) + low)
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, the same wherever a span stands."""
    return _times(_less(prefix[end], prefix[start]), _powers(_INVERSE, len(prefix))[start])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _lowest_level(n: np.ndarray) -> np.ndarray:
    """Level at which four times too many anchors are expected; lower ones are not looked at."""
    return np.maximum(np.floor(np.log2(np.maximum(n, 1) / ANCHORS)).astype(np.int64) - 2, 0)


def _candidates(codes: np.ndarray, first: np.ndarray, lowest: np.ndarray, context: int = 0):
    """Anchors of several texts that lie one after another: text, position in it, level, window, prefix hash.

    ``first`` bounds the texts, ``lowest`` is their lowest level; the first
    ``context`` code points only serve as windows of those after them.
    """
    prefix = prefix_hashes(codes)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    end = np.arange(1, len(codes) + 1)
    start = np.maximum(end - WINDOW, first[:-1][text])
    window = mix(span_hashes(prefix, start, end), 31)
    mask = (np.uint64(1) << lowest.astype(np.uint64)) - np.uint64(1)
    hit = np.flatnonzero((window & mask[text]) == 0)
    hit = hit[hit >= context]
    lowest_bit = window[hit] & (~window[hit] + np.uint64(1))
    level = np.where(lowest_bit == 0, _LAST - 1, np.minimum(np.frexp(lowest_bit.astype(np.float64))[1] - 1, _LAST - 1))
    origin = first[:-1][text[hit]]
    return text[hit], end[hit] - origin, level, window[hit], span_hashes(prefix, origin, end[hit]), prefix


def _chosen(text, at, level, window, value, count: int, lowest: np.ndarray) -> list[np.ndarray]:
    """Per text its anchors: of equal windows the first, of the lowest level that leaves at most ANCHORS."""
    order = np.lexsort((at, window, text))
    text, at, level, window, value = (x[order] for x in (text, at, level, window, value))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (window[1:] != window[:-1])
    text, at, level, value = text[new], at[new], level[new], value[new]
    table = np.bincount(text * (_LAST + 1) + level, minlength=count * (_LAST + 1)).reshape(count, _LAST + 1)
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1]
    fits = (above <= ANCHORS) & (np.arange(_LAST + 1) >= lowest[:, None])
    keep = level >= fits.argmax(axis=1)[text]
    text, at, level, value = text[keep], at[keep], level[keep], value[keep]
    order = np.lexsort((at, text))
    found = np.zeros(len(text), _ANCHOR)
    found["at"], found["level"], found["hash"] = at[order], level[order], value[order]
    return np.split(found, np.searchsorted(text[order], np.arange(1, count)))


def _ended(anchors: np.ndarray, n: int, whole: int) -> np.ndarray:
    """With the end of the text as last anchor, of every level."""
    end = np.array([(n, _LAST, whole)], _ANCHOR)
    return np.concatenate((anchors[anchors["at"] < n], end))


def _of_long(text: str) -> np.ndarray:
    n, lowest = len(text), _lowest_level(np.array([len(text)]))
    parts, at, before = [], 0, 0
    while at < n:
        context = min(at, WINDOW)
        origin = at - context
        codes = _codes(text[origin:at + SEGMENT])
        _, pos, level, window, value, prefix = _candidates(codes, np.array([0, len(codes)]), lowest, context)
        shift = np.uint64(pow(BASE, origin, MODULUS))
        parts.append((pos + origin, level, window, _reduced(_times(value, shift) + np.uint64(before))))
        at += SEGMENT
        if at < n:
            step = int(prefix[at - WINDOW - origin])
            before = (before + pow(BASE, origin, MODULUS) * step) % MODULUS
        else:
            whole = (before + pow(BASE, origin, MODULUS) * int(prefix[-1])) % MODULUS
    pos, level, window, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _ended(_chosen(np.zeros(len(pos), np.int64), pos, level, window, value, 1, lowest)[0], n, whole)


def _of_short(texts: list[str]) -> list[np.ndarray]:
    size = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(size)))
    lowest = _lowest_level(size)
    *found, prefix = _candidates(_codes("".join(texts)), first, lowest)
    whole = span_hashes(prefix, first[:-1], first[1:])
    chosen = _chosen(*found, len(texts), lowest)
    return [_ended(a, int(n), int(w)) for a, n, w in zip(chosen, size, whole, strict=True)]


def anchor_lists(texts: list[str]) -> list[np.ndarray]:
    """Fingerprints of texts as arrays of anchors; short texts are hashed together."""
    out: list[np.ndarray] = []
    held: list[str] = []
    total = 0
    for text in texts:
        if held and total + len(text) > SEGMENT:
            out += _of_short(held)
            held, total = [], 0
        if len(text) > SEGMENT:
            out.append(_of_long(text))
        else:
            held.append(text)
            total += len(text)
    return out + (_of_short(held) if held else [])


def encoded(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _ANCHOR)


class _Blocks:
    """A fingerprint at some level: positions and prefix hashes, from the start of the text to its end."""

    def __init__(self, anchors: np.ndarray, level: int):
        kept = anchors[anchors["level"] >= level]
        self.at = [0, *kept["at"].tolist()]
        self.hash = [0, *kept["hash"].tolist()]
        if self.at[-1] == 0:
            self.at, self.hash = [0], [0]
        self.back = [pow(_INVERSE, a, MODULUS) for a in self.at]

    def __len__(self) -> int:
        return len(self.at) - 1

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.at[b] - self.at[a], (self.hash[b] - self.hash[a]) * self.back[a] % MODULUS


def _own_level(anchors: np.ndarray) -> int:
    return int(anchors["level"].min())


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the length of common blocks over both lengths."""
    n, m = int(a["at"][-1]), int(b["at"][-1])
    if n == m and a["hash"][-1] == b["hash"][-1]:
        return 1.0
    if not n or not m:
        return 0.0
    level = max(_own_level(a), _own_level(b))
    left, right = _Blocks(a, level), _Blocks(b, level)
    places: dict[tuple[int, int], list[int]] = {}
    for j in range(len(right)):
        places.setdefault(right.span(j, j + 1), []).append(j)
    taken = [False] * len(right)
    matched = i = 0
    while i < len(left):
        j = next((j for j in places.get(left.span(i, i + 1), ()) if not taken[j]), None)
        if j is None:
            i += 1
            continue
        most = 1
        while j + most < len(right) and i + most < len(left) and not taken[j + most]:
            most += 1
        # Longest common extension: equality of spans over 1, 2, ... blocks ends once and for all.
        steps = bisect_left(range(2, most + 1), True, key=lambda k: left.span(i, i + k) != right.span(j, j + k)) + 1
        taken[j:j + steps] = [True] * steps
        matched += left.at[i + steps] - left.at[i]
        i += steps
    return min(1.0, 2 * matched / (n + m))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Likeness of two fingerprint columns, from 0 to 1; NULL if one is NULL."""

    @F.pandas_udf(T.DoubleType())
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else alike(decoded(p), decoded(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return of(a, b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([encoded(a) for a in anchor_lists(texts)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    rows = columns_or_null(docs, doc_id="bigint", text="string").withColumn("text", text_of())
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def common_extensions(pairs: DataFrame) -> DataFrame:
    """Adds ``common``: how many code points of ``left`` from ``left_at`` equal those of ``right`` from ``right_at``.

    A span of some length is equal where ``common`` reaches it. Positions outside
    the text have nothing in common.
    """
    schema = pairs.withColumn("common", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for a, b, i, j in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "left_at", "right_at")), strict=True):
                a, b = a or "", b or ""
                if i is None or j is None or not (0 <= i <= len(a) and 0 <= j <= len(b)):
                    common.append(0)
                    continue
                x, y = prefix_hashes(_codes(a)), prefix_hashes(_codes(b))

                def differs(k, x=x, y=y, i=i, j=j):
                    one = np.array([i]), np.array([i + k])
                    return bool(span_hashes(x, *one)[0] != span_hashes(y, np.array([j]), np.array([j + k]))[0])

                common.append(bisect_left(range(1, min(len(a) - i, len(b) - j) + 1), True, key=differs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(common, pa.int64())], [*batch.schema.names, "common"])

    return pairs.mapInArrow(run, schema)


def _slice_bounds(keys: DataFrame, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all slices but the last, from a sample of fixed size; they decide on balance only."""
    sample = keys.orderBy(F.xxhash64("o", "h"), "o", "h").limit(SAMPLE_A_SLICE * slices).collect()
    found = sorted({(r.o, r.h) for r in sample})
    cuts = [found[len(found) * k // slices] for k in range(1, slices)] if found else []
    cuts = sorted(set(cuts))
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def _slice_of(o: np.ndarray, h: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of bounds at or below (o, h)."""
    low, high = np.searchsorted(bounds[0], o, "left"), np.searchsorted(bounds[0], o, "right")
    out = high.copy()
    tied = np.flatnonzero(low < high)
    for value in np.unique(o[tied]):
        at = tied[o[tied] == value]
        a, b = low[at[0]], high[at[0]]
        out[at] = a + np.searchsorted(bounds[1][a:b], h[at], "right")
    return out


def in_slices(docs: DataFrame) -> DataFrame:
    """Rows dealt into slices of the order by (doc_id, text hash), each slice in order in one task,
    followed as a ``guest`` by the row after its last one (after the very last: the first).

    A text is shuffled once. The driver learns a bound and a first key per slice.
    """
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = columns_or_null(docs, doc_id="bigint", text="string").withColumn("text", text_of()).withColumns(
        {"o": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    keys = settled(rows.select("o", "h"), "document-keys")
    bounds = _slice_bounds(keys, slices)

    @F.pandas_udf("int")
    def slice_of(o: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_slice_of(o.to_numpy(), h.to_numpy(), bounds))

    firsts = keys.withColumn("slice", slice_of("o", "h")).groupBy("slice").agg(F.min(F.struct("o", "h")).alias("k")).orderBy("slice").collect()
    hosts: dict[tuple[int, int], int] = {(r.k.o, r.k.h): firsts[k - 1].slice for k, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(o: pd.Series, h: pd.Series) -> pd.Series:
        own = _slice_of(o.to_numpy(), h.to_numpy(), bounds)
        return pd.Series([[s] if (host := hosts.get(k)) is None else [s, -1 - host] for s, k in zip(own.tolist(), zip(o, h, strict=True), strict=True)])

    dealt = rows.withColumn("place", F.explode(places("o", "h"))).select(
        "doc_id", "text", "o", "h", (F.col("place") < 0).alias("guest"),
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("slice"))
    return dealt.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "guest", "o", "h").drop("o", "h")


_RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest", "slice")), strict=True))
        rows = [held, *rows] if held else rows
        if not rows:
            continue
        held = rows[-1]
        pairs = [(k, r) for k, r in enumerate(rows[:-1]) if not r[2]]
        if not pairs:
            continue
        prints = anchor_lists([r[1] for r in rows])
        edited = [_edited(r[1], rows[k + 1][1]) for k, r in pairs]
        changed = anchor_lists(edited)
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for _, r in pairs], pa.int64()), pa.array([len(r[1]) for _, r in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([encoded(prints[k]) for k, _ in pairs], pa.string()), pa.array([encoded(c) for c in changed], pa.string()),
            pa.array([alike(prints[k], c) for (k, _), c in zip(pairs, changed, strict=True)], pa.float64()),
            pa.array([alike(prints[k], prints[k + 1]) for k, _ in pairs], pa.float64()),
        ], [c.split()[0] for c in _RESULT.split(", ")])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document beside an edited copy, whose last quarter is the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, and the likeness of
    the fingerprint to the copy's (near_edited) and the next document's (near_next).
    """
    return in_slices(docs).mapInArrow(_compare, _RESULT)
