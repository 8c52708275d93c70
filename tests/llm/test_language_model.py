"""Scores of the bigram model over rows made here, whatever part of the words is broadcast."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from boardlens.llm import lm, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = random.Random(11)
    names = [f"w{i}" for i in range(300)] + ["Été", "é", "the", "The"]
    out = [(None, "the null one"), (7, None), (7, None), (8, ""), (9, "only here " * 3)]
    for i in range(10, 150):
        out.append((i, " ".join(names[min(int(rng.paretovariate(0.4)) - 1, len(names) - 1)] for _ in range(rng.randint(0, 60)))))
    return [*out, out[20]]


def plain(data):
    words = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in data]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in data]
    train = [w for w, h in zip(words, held, strict=True) if not h]
    count = Counter(w for x in train for w in x)
    total = sum(count.values()) + 0.5 * (len(count) + 1)
    pair = Counter(p for x in train for p in zip([0, *x], x, strict=False))
    state = Counter(a for x in train for a in [0, *x[:-1]])
    out = []
    for (i, _), x, h in zip(data, words, held, strict=True):
        score = sum(
            math.log10((pair[a, b] + lm.STRENGTH * (count[b] + 0.5) / total) / (state[a] + lm.STRENGTH))
            for a, b in zip([0, *x], x, strict=False))
        out.append((-1 if i is None else i, h, len(x), sum(w in count for w in x), sum(count.values()), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [0, 3, 40, lm.VOCABULARY])
def test_scores_do_not_depend_on_the_words_broadcast(spark, vocabulary):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6))
        for r in lm.score(docs, vocabulary).collect())
    want = plain(data)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], abs_tol=2e-6) for a, b in zip(got, want, strict=True))


def test_sums_handed_on_early_add_up(monkeypatch):
    model = lm.Model(np.arange(4, dtype=np.uint64), np.full(4, 5), 40, 9, 6, 200.0)
    rng = np.random.default_rng(2)
    packs = []
    for bucket in range(6):
        for chunk in range(5):
            key = np.sort(rng.integers(0, 4, 40) * 7 + rng.integers(0, 4, 40)).astype(np.uint64)
            packs.append((1, bucket, chunk, 0, lm._pack(key, rng.integers(0, 60, 40), np.ones(40, int))))
            word = rng.integers(100, 110, 6).astype(np.uint64)
            packs.append((2, bucket, chunk, 0, lm._pack_rare(
                word, rng.integers(0, 4, 6), rng.integers(0, 5, 6), rng.integers(0, 400, 6), False)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c) for c in zip(*packs, strict=True)], ["kind", "bucket", "chunk", "wide", "payload"])

    def texts():
        sums = pa.Table.from_batches(lm._arc_sums(model, iter([batch])))
        out = pa.Table.from_batches(lm._text_sums(iter(sums.sort_by("chunk").to_batches()))).to_pylist()
        return len(sums), {(r["chunk"], r["at"]): r for r in out}

    few, whole = texts()
    monkeypatch.setattr(lm, "SUMS_BYTES", 3000)
    many, parts = texts()
    assert few == 5 < many and whole.keys() == parts.keys()
    assert all(math.isclose(whole[k][c], parts[k][c], abs_tol=1e-9) for k in whole for c in ("score", "base_rare", "known_rare"))


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    column = pa.array(["", "One two  three", None, "x" * 50 + " é", " four\tfive " * 9])
    whole = [w.hashes(lower=True).tolist() for _, _, w in tokens.pieces(column)]
    for size in (1, 2, 7, 49, 50, 51):
        monkeypatch.setattr(tokens, "HASH_BYTES", size)
        assert [w.hashes(lower=True).tolist() for _, _, w in tokens.pieces(column)] == whole
