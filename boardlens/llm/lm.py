"""Language-model scores from a weighted backoff automaton, distributed by arcs.

The model is a bigram automaton over all training words. Its states are the words, the
begin of a text and the empty state. From state u a word w seen after it leads on by an
arc of weight log10((c(u w) + M p(w)) / (c(u) + M)); every other word takes the failure
arc of weight log10(M / (c(u) + M)) to the empty state and then its unigram arc
log10 p(w). Words never seen in training share p of a count of 0. p is the add-half
unigram estimate over all training tokens, M (``STRENGTH``) its weight in every state.

The weight parts into log10(c(u w) + M p(w)), taken where the arc is owned, and
-log10(c(u) + M), taken where the count of u is known. Counts of the frequent words (at
most ``VOCABULARY``) are broadcast; all arcs of a rarer word are owned by the partition of
that word, which counts it. So the limit bounds what is broadcast and changes no score.

Each text is traversed once from left to right; the steps it takes go, packed per piece
of about 4 MB of text, to the partition that owns the arc. There the arc's count is taken
over all training texts, its weight computed and added up for the texts that walk it.
What returns is a sum per text and partition.

NULL text is empty (one end token); NULL doc_id is trained on (crc32 of the
empty string); repeated rows are texts of their own; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, text_of
from boardlens.llm.tokens import mix, pieces

VOCABULARY = 1 << 17
STRENGTH = 200.0
FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES = 4_000_000
ARCS = 500_000  # training tokens per bucket of arcs
SUMS_BYTES = 32_000_000  # sums of texts that a task holds before it hands them on
BINS = 64  # per power of two, to find the count from which words are frequent


def held_out():
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in pieces(batch.column("text"), CHUNK_BYTES):
            word, count = np.unique(words.hashes(lower=True), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "count"])


class Model:
    """The bounded part of the model: frequent words, their counts, and totals.

    Ids: 0..k-1 frequent words in order of their hash, then rare (any other word), begin, end.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, types: int, texts: int, strength: float):
        order = np.argsort(words)
        self.words, self.k = words[order], len(words)
        self.rare, self.begin, self.end = self.k, self.k + 1, self.k + 2
        self.tokens, self.types, self.strength = tokens, types, strength
        self.total = tokens + 0.5 * (types + 1)
        own = counts[order].astype(float)
        rare_tokens = tokens - texts - own.sum()
        rare_types = types - self.k - (texts > 0)
        self.state = np.concatenate((own, [rare_tokens, texts, 0.0]))
        self.p = np.concatenate(((own + 0.5) / self.total, [
            (rare_tokens + 0.5 * (rare_types + 1)) / self.total, 0.0, (texts + 0.5) / self.total]))
        self.end_known = texts > 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.k:
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.words, hashes), self.k - 1)
        return np.where(self.words[at] == hashes, at, self.rare)

    def log_unigram(self, count):
        return np.log10((count + 0.5) / self.total)


def fit(docs: DataFrame, vocabulary: int = VOCABULARY, strength: float = STRENGTH) -> Model:
    """Counts of the training texts; only totals and the frequent words come to the driver."""
    from boardlens.session import settled

    train = columns_or_null(docs, doc_id="bigint", text="string").where(~held_out())
    counts = settled(
        train.select(text_of().alias("text")).mapInArrow(_word_counts, "word bigint, count bigint")
        .groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    texts = train.count()
    totals = counts.agg(F.sum("count"), F.count(F.lit(1))).first()
    bins = counts.groupBy(F.floor(F.log2("count") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    taken, least = 0, None
    for row in sorted(bins, key=lambda r: -r.bin):
        if taken + row.n > vocabulary:
            break
        taken, least = taken + row.n, row.bin
    frequent = (
        counts.where(F.floor(F.log2("count") * BINS) >= least).toPandas() if least is not None else None)
    words = frequent["word"].to_numpy().view(np.uint64) if taken else np.zeros(0, np.uint64)
    own = frequent["count"].to_numpy() if taken else np.zeros(0, np.int64)
    return Model(words, own, (totals[0] or 0) + texts, totals[1] + (texts > 0), texts, strength)


def _pack(key: np.ndarray, doc: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as differences, then text numbers and counts."""
    step = np.diff(key, prepend=key[:1] * 0)
    small = len(step) and int(step.max()) < 1 << 32
    return b"".join((
        np.array([len(key), small], np.int64).tobytes(), step.astype(np.uint32 if small else np.uint64).tobytes(),
        doc.astype(np.uint32).tobytes() if len(doc) and doc.max() > 65535 else doc.astype(np.uint16).tobytes(),
        count.astype(np.uint32 if len(count) and count.max() > 255 else np.uint8).tobytes()))


def _unpack(data: bytes, wide_doc: bool, wide_count: bool):
    n, small = np.frombuffer(data, np.int64, 2)
    at = 16
    step = np.frombuffer(data, np.uint32 if small else np.uint64, n, at)
    at += step.nbytes
    doc = np.frombuffer(data, np.uint32 if wide_doc else np.uint16, n, at)
    at += doc.nbytes
    count = np.frombuffer(data, np.uint32 if wide_count else np.uint8, n, at)
    return np.cumsum(step.astype(np.uint64)), doc.astype(np.int64), count.astype(np.int64)


def _pack_rare(word: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, hashed: bool) -> bytes:
    """Hashes of words, the word before each (id, or hash if that is rare too), the id of what follows, text numbers."""
    return b"".join((
        np.array([len(word)], np.int64).tobytes(), word.tobytes(), before.astype(np.uint64 if hashed else np.uint32).tobytes(),
        after.astype(np.uint32).tobytes(),
        doc.astype(np.uint32).tobytes() if doc.max() > 65535 else doc.astype(np.uint16).tobytes()))


def _unpack_rare(data: bytes, hashed: bool, wide_doc: bool):
    n, at, parts = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in (np.uint64, np.uint64 if hashed else np.uint32, np.uint32, np.uint32 if wide_doc else np.uint16):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    word, before, after, doc = parts
    return word, before.astype(np.uint64), np.full(n, hashed), after.astype(np.int64), doc.astype(np.int64)


_STEPS = (
    "kind int, bucket int, chunk bigint, wide int, payload binary, doc_id bigint, held_out boolean, n_tokens bigint, "
    "n_known bigint, base double, score double")
#: kinds: 0 a text, 1 steps between frequent words, 2 rare words after a frequent one, 3 after a rare one


def _steps(model: Model, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("wide", pa.int32()),
                        ("payload", pa.binary()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    log_p = np.log10(np.maximum(model.p, 1e-300))
    # What leaving a state adds; a rare word's owner adds that of its own.
    leave = -np.log10(model.state + model.strength)
    leave[model.rare] = 0.0
    width = np.uint64(model.k + 3)

    def edges_of(bucket: np.ndarray):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        return zip(edges[:-1], edges[1:], strict=True)

    for batch in batches:
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        for a, b, words in pieces(batch.column("text"), CHUNK_BYTES):
            chunk += 1
            n = b - a
            hashes = words.hashes(lower=True)
            ids = model.ids(hashes)
            known = ids != model.rare
            base = np.bincount(words.doc[known], log_p[ids[known]], n) + model.log_unigram(model.state[model.begin])
            n_known = np.bincount(words.doc[known], minlength=n) + int(model.end_known)
            # One step into every word and one into the end, from the word before or the begin.
            total = len(ids) + n
            after = np.full(total, model.end)
            place = np.arange(len(ids)) + words.doc
            after[place] = ids
            before = np.empty(total, np.int64)
            before[1:] = after[:-1]
            before[words.first[:-1] + np.arange(n)] = model.begin
            doc = np.repeat(np.arange(n), words.count + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, chunk)),
                pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.binary()), batch.column("doc_id").slice(a, n),
                batch.column("held_out").slice(a, n), pa.array(words.count + 1), pa.array(n_known), pa.array(base),
                pa.array(np.bincount(doc, leave[before], n))], schema=schema)
            train = np.where(held[a:b], 0, 1)
            rows: list[tuple] = []
            plain = (before != model.rare) & (after != model.rare)
            key, own = before[plain].astype(np.uint64) * width + after[plain].astype(np.uint64), doc[plain]
            if len(key):
                bucket = (mix(key, 83) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((own, key, bucket))
                key, own, bucket = key[order], own[order], bucket[order]
                new = np.flatnonzero(np.concatenate(
                    ([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))))
                count = np.diff(np.append(new, len(key)))
                key, own, bucket = key[new], own[new], bucket[new]
                own = own * 2 + train[own]
                for lo, hi in edges_of(bucket):
                    wide = int(own[lo:hi].max() > 65535) + 2 * int(count[lo:hi].max() > 255)
                    rows.append((1, bucket[lo], wide, _pack(key[lo:hi], own[lo:hi], count[lo:hi])))
            at = np.flatnonzero(~known)
            last = before[place[at]]
            for kind, mine in ((2, last != model.rare), (3, last == model.rare)):
                word = at[mine]
                if not len(word):
                    continue
                bucket = (mix(hashes[word], 83) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, word = bucket[order], word[order]
                prior = last[mine][order] if kind == 2 else hashes[word - 1]
                own = words.doc[word] * 2 + train[words.doc[word]]
                follow = after[place[word] + 1]
                for lo, hi in edges_of(bucket):
                    part = slice(lo, hi)
                    rows.append((kind, bucket[lo], int(own[part].max() > 65535), _pack_rare(
                        hashes[word[part]], prior[part], follow[part], own[part], kind == 3)))
            if rows:
                m = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([int(r[1]) for r in rows], pa.int32()),
                    pa.array(np.full(m, chunk)), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.binary()), *[pa.nulls(m, f.type) for f in list(schema)[5:]]], schema=schema)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key))


def _arcs_between(model: Model, rows: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Steps between frequent words, row by row: chunk, text of each, what it adds to the score."""
    keys, counts, size = [], [], 0
    for _, _, wide, payload in rows:
        key, doc, count = _unpack(payload, bool(wide & 1), bool(wide & 2))
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        keys.append(key[head])
        counts.append(np.add.reduceat(count * (doc & 1), head).astype(float))
        size += len(head)
        if size > 2 * ARCS + len(keys[0]):
            keys, counts = ([x] for x in _added(keys, counts))
            size = len(keys[0])
    arcs, trained = _added(keys, counts)
    weight = np.log10(trained + model.strength * model.p[(arcs % np.uint64(model.k + 3)).astype(np.int64)])
    for _, chunk, wide, payload in rows:
        key, doc, count = _unpack(payload, bool(wide & 1), bool(wide & 2))
        yield chunk, doc >> 1, weight[np.searchsorted(arcs, key)] * count


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows alike in all columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), np.int64)
    for column in columns:
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _rare_words(model: Model, rows: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rare words, row by row: chunk, text of each, what it adds to the score, to the base, whether it is known.

    All occurrences of a word are here, so its count and those of the steps into it
    are, and of its steps to frequent words; a rare word after it has that step itself.
    """
    parts = [_unpack_rare(payload, kind == 3, bool(wide)) for kind, _, wide, payload in rows]
    first = np.cumsum([0, *[len(x[0]) for x in parts]])
    word, before, hashed, after, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    trained = (doc & 1).astype(float)
    doc >>= 1
    at = np.unique(word, return_inverse=True)[1]
    count = np.bincount(at, trained)[at]
    p = (count + 0.5) / model.total
    arc = _numbered(before, hashed, at)
    score = np.log10(np.bincount(arc, trained)[arc] + model.strength * p) - np.log10(count + model.strength)
    arc = _numbered(after, at)
    out = np.log10(np.bincount(arc, trained)[arc] + model.strength * np.maximum(model.p[after], 1e-300))
    score += np.where(after == model.rare, 0.0, out)
    base, known = np.log10(p), (count > 0).astype(float)
    for i, row in enumerate(rows):
        mine = slice(first[i], first[i + 1])
        yield row[1], doc[mine], score[mine], base[mine], known[mine]


def _arc_sums(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by bucket: sums per text over the arcs of this task, packed per chunk."""
    sums: dict[int, np.ndarray] = {}
    size = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for chunk, held in sums.items():
            at = np.flatnonzero((held != 0).any(axis=0))
            sparse = 6 * len(at) < 5 * held.shape[1]
            own = held[:, at] if sparse else held
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([held.shape[1]], pa.int32()),
                 pa.array([at.astype(np.uint32).tobytes() if sparse else None], pa.binary()),
                 pa.array([own[0].tobytes()], pa.binary()), pa.array([own[1].tobytes()], pa.binary()),
                 pa.array([own[2].tobytes()], pa.binary())],
                ["chunk", "n", "at", "score", "base", "known"])
        sums.clear()
        size = 0

    def settle(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for walk, own in ((_arcs_between, [r for r in group if r[0] == 1]), (_rare_words, [r for r in group if r[0] > 1])):
            if not own:
                continue
            for chunk, doc, *values in walk(model, own):
                n = int(doc.max()) + 1
                held = sums.get(chunk)
                if held is None or held.shape[1] < n:
                    grown = np.zeros((3, n))
                    if held is not None:
                        grown[:, :held.shape[1]] = held
                        size -= held.nbytes
                    held = sums[chunk] = grown
                    size += held.nbytes
                for j, value in enumerate(values):
                    held[j, :n] += np.bincount(doc, value, n)
                if size > SUMS_BYTES:
                    yield from handed_on()

    group: list[tuple] = []
    bucket = None
    for batch in batches:
        for kind, own, chunk, wide, payload in zip(
            *(batch.column(c).to_pylist() for c in ("kind", "bucket", "chunk", "wide", "payload")), strict=True):
            if own != bucket:
                yield from settle(group)
                group, bucket = [], own
            group.append((kind, chunk, wide, payload))
    yield from settle(group)
    yield from handed_on()


def _text_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by chunk: the sums of all its arcs, one row per text."""
    chunk, total = None, np.zeros((3, 0))

    def out():
        n = total.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(x) for x in total]],
            ["chunk", "at", "score", "base_rare", "known_rare"])

    for batch in batches:
        for own, n, at, *sums in zip(
            *(batch.column(c).to_pylist() for c in ("chunk", "n", "at", "score", "base", "known")), strict=True):
            if own != chunk:
                if chunk is not None:
                    yield out()
                chunk, total = own, np.zeros((3, n))
            if total.shape[1] < n:
                total = np.concatenate((total, np.zeros((3, n - total.shape[1]))), axis=1)
            where = slice(n) if at is None else np.frombuffer(at, np.uint32)
            for j, x in enumerate(sums):
                total[j, where] += np.frombuffer(x)
    if chunk is not None:
        yield out()


def score(docs: DataFrame, vocabulary: int = VOCABULARY, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    from boardlens.session import settled

    model = fit(docs, vocabulary, strength)
    rows = columns_or_null(docs, doc_id="bigint", text="string").select(
        "doc_id", held_out().alias("held_out"), text_of().alias("text"))
    buckets = max(1, -(-model.tokens // ARCS))
    steps = settled(rows.mapInArrow(functools.partial(_steps, model, buckets), _STEPS), "steps")
    sums = (
        steps.where("kind > 0").select("kind", "bucket", "chunk", "wide", "payload")
        .repartition("bucket").sortWithinPartitions("bucket", "kind", "chunk")
        .mapInArrow(functools.partial(_arc_sums, model), "chunk bigint, n int, at binary, score binary, base binary, known binary")
        .repartition("chunk").sortWithinPartitions("chunk")
        .mapInArrow(_text_sums, "chunk bigint, at int, score double, base_rare double, known_rare double"))
    texts = steps.where("kind = 0").select(
        "chunk", F.col("wide").alias("at"), "doc_id", "held_out", "n_tokens", "n_known", "base",
        F.col("score").alias("left"))
    return texts.join(sums, ["chunk", "at"], "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce(F.round("known_rare"), F.lit(0.0)).cast("bigint")).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        (F.col("left") + F.coalesce("score", F.lit(0.0))).alias("score"))
