"""Words of whole texts as numpy arrays, for work inside Arrow batches.

A batch's texts lie one after another in one byte buffer. Words are found on
those bytes at once (every gap character is ASCII, so UTF-8 sequences stay
whole) and hashed to 64 bits. Batches are handed on in pieces of about
``PIECE_BYTES``; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000
HASH_BYTES = 500_000
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values: a fixed xor-multiply-shift finaliser."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256), 11)
_PLACE = mix(np.arange(1 << 16), 12) | np.uint64(1)


def _places(longest: int) -> np.ndarray:
    return _PLACE if longest <= len(_PLACE) else mix(np.arange(longest), 12) | np.uint64(1)


class Words:
    """Words of several texts: byte ``start`` and ``end``, owning text ``doc``, ``first`` word per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = _GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([True], gap[:-1])) if len(data) else gap
        after = np.concatenate((gap[1:], [True])) if len(data) else gap
        self.start = np.flatnonzero(~gap & (before | edge[:-1]))
        self.end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z lower-cased if asked)."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        data = _LOWER[self.data] if lower else self.data
        places = _places(int(size.max()))
        upto = np.cumsum(size)
        total = np.empty(len(self), np.uint64)
        # A few arrays of 8 bytes for every byte are needed, so it is done block by block.
        cuts = np.searchsorted(upto, np.arange(HASH_BYTES, upto[-1], HASH_BYTES))
        edges = np.unique(np.concatenate(([0], cuts, [len(self)])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            length = size[a:b]
            head = np.cumsum(length) - length
            place = np.arange(length.sum()) - np.repeat(head, length)
            byte = data[np.repeat(self.start[a:b], length) + place]
            total[a:b] = np.add.reduceat(_BYTE[byte] * places[place], head)
        return mix(total + size.astype(np.uint64), 13)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) of one text, joined by one blank."""
        return b" ".join(self.data[self.start[a]:self.end[b - 1]].tobytes().split()) if b > a else b""


def pieces(
    column: pa.Array, limit: int = PIECE_BYTES, table: np.ndarray | None = None
) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words); NULL is an empty text. ``table`` maps each byte first."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        part = data[offsets[a]:offsets[b]]
        yield a, b, Words(part if table is None else table[part], offsets[a:b + 1] - offsets[a])
        a = b


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` consecutive words inside a text, and the word each starts at."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - size + 1, np.uint64)
    odd = mix(np.arange(size), seed) | np.uint64(1)
    for k in range(size):
        total += hashes[k:n - size + 1 + k] * odd[k]
    fits = np.zeros(n - size + 1, bool)
    count = np.diff(first)
    for a, c in zip(first[:-1], count, strict=True):
        if c >= size:
            fits[a:a + c - size + 1] = True
    at = np.flatnonzero(fits)
    return mix(total[at], seed), at


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows that agree in ``keys``, by which they come sorted, stay together."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None and len(held):
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        edges = _edges(batch, keys)
        if edges[-1]:
            yield batch.slice(0, edges[-1])
        held = batch.slice(edges[-1])
    if held is not None and len(held):
        yield held


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One batch per group of rows that agree in ``keys``, from batches sorted by them."""
    for batch in whole_groups(batches, keys):
        edges = np.append(_edges(batch, keys), len(batch))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def _edges(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(len(batch) - 1, bool)
    for key in keys:
        column = batch.column(key).to_numpy(zero_copy_only=False)
        change |= column[1:] != column[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))
