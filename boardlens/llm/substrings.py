"""Removal of repeated passages by super-k-mer partitioning.

A window is 35 consecutive words of one text. The smallest hash among a window's
five-word grams is its minimiser; consecutive windows with one minimiser form a
super-k-mer. Equal windows have equal minimisers, so a super-k-mer whose
minimiser occurs nowhere else holds no repeat and stays where it is. The others
travel as one packed string (their words joined by a blank) to the minimiser's
bucket, where sorting the windows' 128-bit hashes counts them. Buckets of a very
common minimiser are split by the windows' hashes, so none outgrows a task; what
returns is one bit per window. Each distinct text is worked on once, whatever
its number of copies; a text with copies repeats in full.

NULL and blank texts and texts under 35 words lose nothing; repeated rows count
as copies of each other; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, text_of
from boardlens.llm.tokens import Words, pieces, whole_groups, windows
from boardlens.session import settled

WINDOW = 35
GRAM = 5
SPAN = WINDOW - GRAM + 1  # grams in a window, and the most windows of a super-k-mer
BUCKET = 1024  # super-k-mers of one minimiser that go to one bucket


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of several texts: first word, number of windows, minimiser, owning text."""
    hashes = words.hashes()
    none = np.zeros(0, np.int64)
    count = words.count
    if not (count >= WINDOW).any():
        return none, none, none, none
    grams = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    value, at = windows(hashes, words.first, GRAM, seed=31)
    grams[at] = value
    low, place, width = grams, np.arange(len(grams)), 1
    while 2 * width <= SPAN:
        low, place = _lower(low, place, width)
        width *= 2
    low, place = _lower(low, place, SPAN - width)
    starts = np.concatenate([np.arange(a, a + c - WINDOW + 1) for a, c in zip(words.first, count, strict=False) if c >= WINDOW])
    low, place = low[starts], place[starts]
    # A run ends where the minimiser's place changes, so equal windows never share one.
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    length = np.diff(np.append(head, len(starts)))
    first = starts[head]
    return first, length, low[head].view(np.int64), words.doc[first]


def _lower(low: np.ndarray, place: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of each value and the one ``by`` further on, and its place; the first if equal."""
    left = low[:-by] <= low[by:]
    return np.where(left, low[:-by], low[by:]), np.where(left, place[:-by], place[by:])


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in pieces(batch.column("text")):
            _, _, minimiser, owner = _runs(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content").slice(a, b - a), _lists(minimiser, owner, b - a)], ["content", "anchors"])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers named in ``wanted`` (number, bucket splits), equal ones of a piece once with all their places.

    A row goes to each of the minimiser's buckets that owns one of its windows.
    """
    for batch in batches:
        wanted, contents = batch.column("wanted"), batch.column("content")
        for a, b, words in pieces(batch.column("text")):
            first, length, minimiser, owner = _runs(words)
            own = wanted.slice(a, b - a)
            want = own.flatten()
            numbers, splits = (want.field(f).to_numpy(zero_copy_only=False) for f in ("no", "splits"))
            text = np.repeat(np.arange(b - a), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            runs = np.searchsorted(owner, text) + numbers
            window = None
            if len(splits) and splits.max() > 1:
                window = np.zeros(len(words), np.uint64)
                value, at = windows(words.hashes(), words.first, WINDOW, seed=41)
                window[at] = value
            rows: dict[tuple[int, bytes], tuple[int, np.ndarray | None, list, list]] = {}
            ids = contents.slice(a, b - a).to_pylist()
            for run, split, t in zip(runs.tolist(), splits.tolist(), text.tolist(), strict=True):
                s, n = int(first[run]), int(length[run])
                key = int(minimiser[run]), words.text(s, s + n + WINDOW - 1)
                if key not in rows:
                    subs = np.unique(window[s:s + n] % np.uint64(split)) if split > 1 else None
                    rows[key] = split, subs, [], []
                rows[key][2].append(ids[t])
                rows[key][3].append(s - int(words.first[t]))
            out: list[list] = [[], [], [], [], [], []]
            for (low, pack), (split, subs, where, starts) in rows.items():
                for sub in (0,) if subs is None else subs.tolist():
                    for column, value in zip(out, (low, sub, split, where, starts, pack), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.list_(pa.binary())), pa.array(out[4], pa.list_(pa.int32())),
                 pa.array(out[5], pa.binary()).cast(pa.string())],
                ["minimiser", "sub", "splits", "contents", "starts", "pack"])


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of whole buckets: a bit per window that occurs twice or more among them."""
    n = len(batch)
    rows, places, one, two = [], [], [], []
    for a, _, words in pieces(batch.column("pack"), 8_000_000):
        hashes = words.hashes()
        h1, at = windows(hashes, words.first, WINDOW, seed=41)
        h2, _ = windows(hashes, words.first, WINDOW, seed=43)
        owner = words.doc[at]
        rows.append(owner + a)
        places.append(at - words.first[owner])
        one.append(h1)
        two.append(h2)
    row, place, h1, h2 = (np.concatenate(x) for x in (rows, places, one, two))
    splits = np.asarray(batch.column("splits"))[row].astype(np.uint64)
    here = h1 % splits == np.asarray(batch.column("sub"))[row].astype(np.uint64)
    row, place, h1, h2 = row[here], place[here], h1[here], h2[here]
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    places = batch.column("contents").value_lengths().to_numpy(zero_copy_only=False)
    twice = places[row[order]] > 1
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    bits = np.zeros(n, np.int64)
    np.bitwise_or.at(bits, row[hit], np.int64(1) << place[hit].astype(np.int64))
    keep = pa.array(np.flatnonzero(bits))
    out = batch.select(["contents", "starts"]).take(keep)
    return pa.RecordBatch.from_arrays(
        [out.column("contents").flatten(), out.column("starts").flatten(), pa.array(np.repeat(bits[keep], places[keep]), pa.int64())],
        ["content", "start", "bits"])


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for buckets in whole_groups(batches, ["minimiser", "sub"]):
        yield _count(buckets)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copies = np.asarray(batch.column("copies"))
        marks = batch.column("marks")
        for a, b, words in pieces(batch.column("text")):
            out = [], [], []
            rows = marks.slice(a, b - a).to_pylist()
            for text in range(b - a):
                lo, n = int(words.first[text]), int(words.count[text])
                gone = np.zeros(n + 1, np.int32)
                if n >= WINDOW and copies[a + text] > 1:
                    gone[0] = 1
                else:
                    for mark in rows[text] or ():
                        bits = mark["bits"]
                        at = np.array([i for i in range(SPAN) if bits >> i & 1]) + mark["start"]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, np.minimum(at + WINDOW, n), -1)
                stays = np.concatenate(([False], np.cumsum(gone)[:n] == 0, [False]))
                turns = np.flatnonzero(stays[1:] != stays[:-1]).reshape(-1, 2)
                kept = b" ".join(words.text(lo + p, lo + q) for p, q in turns)
                out[0].append(n)
                out[1].append(n - int(stays.sum()))
                out[2].append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content").slice(a, b - a), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.binary()).cast(pa.string())],
                ["content", "n_words", "n_removed", "kept"])


def content_key():
    return F.unhex(F.md5(text_of().cast("binary")))


def cleaned_texts(docs: DataFrame) -> DataFrame:
    """content, n_words, n_removed, kept (the words left, joined by a blank) per distinct text."""
    texts = columns_or_null(docs, text="string").select(content_key().alias("content"), text_of().alias("text"))
    anchors = settled(
        texts.mapInArrow(_anchors, "content binary, anchors array<bigint>")
        .groupBy("content").agg(F.first("anchors").alias("anchors")), "anchors")
    runs = anchors.select("content", F.posexplode("anchors").alias("no", "minimiser"))
    common = settled(
        runs.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            "minimiser", F.ceil(F.col("n") / BUCKET).cast("int").alias("splits")), "minimisers")
    wanted = runs.join(common, "minimiser").groupBy("content").agg(
        F.collect_list(F.struct("no", "splits")).alias("wanted"))
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    packs = distinct.join(wanted, "content").select("content", "text", "copies", "wanted").mapInArrow(
        _packs, "minimiser bigint, sub int, splits int, contents array<binary>, starts array<int>, pack string")
    marks = (
        packs.repartition("minimiser", "sub").sortWithinPartitions("minimiser", "sub")
        .mapInArrow(_count_buckets, "content binary, start int, bits bigint")
        .groupBy("content").agg(F.collect_list(F.struct("start", "bits")).alias("marks")))
    return distinct.join(marks, "content", "left").select("content", "text", "copies", "marks").mapInArrow(
        _cleaned, "content binary, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept text (or its SHA-256 as ``kept_sha256``) per row."""
    clean = cleaned_texts(docs)
    if digest:
        clean = clean.select("content", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    clean = settled(clean, "kept-texts")
    ids = columns_or_null(docs, doc_id="bigint", text="string").select("doc_id", content_key().alias("content"))
    return ids.join(clean, "content").drop("content")


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """The same by a plain dictionary of windows, for tests."""
    import re
    from collections import Counter

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + WINDOW]) for w in split for i in range(len(w) - WINDOW + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - WINDOW + 1) if seen[tuple(w[i:i + WINDOW])] > 1 for j in range(i, i + WINDOW)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
