"""Operators that SQL cannot state, against plain Python over the smallest documents."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from boardlens.llm import decontam, jaccard, lines, lm, pii, quality, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_repeated_windows(docs, texts):
    want = dict(zip(texts, substrings.brute_force(list(texts.values())), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, digest=True).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_near_duplicate_classes_and_links(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = defaultdict(int), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (find(i), links[i]) for i in ids}


def test_language_model_scores(docs, texts):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for i in train for w in tokens[i])
    total, base = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    pair, state = Counter(), Counter()
    for i in train:
        for a, b in zip(["<s>", *tokens[i]], tokens[i], strict=False):
            pair[a, b] += 1
            state[a] += 1
    for r in lm.score(docs).collect():
        own = tokens[r.doc_id]
        known = [w if w in count else "<rare>" for w in own]
        want = sum(
            math.log10((pair[a, b] + lm.STRENGTH * (count[b] + 0.5) / base) / (state[a] + lm.STRENGTH))
            for a, b in zip(["<s>", *known], known, strict=False))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / base) for w in own), rel_tol=1e-9)
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_small_vocabulary_is_still_a_distribution(docs):
    model = lm.fit(docs, vocabulary=50)
    assert model.k <= 50 and math.isclose(model.p.sum(), 1.0, rel_tol=1e-9)


def test_plain_counts_and_ratio(spark, docs, texts):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    rows = quality.judge(docs.select("doc_id", "text"), labels).collect()
    for r in rows:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        with_words = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(with_words) - len(set(with_words)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


def test_leaks_by_every_alignment(spark, docs, texts):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    want = set()
    for i, t in texts.items():
        d = words(t)
        have = defaultdict(list)
        for k, w in enumerate(d):
            have[w].append(k)
        for item, b in items.items():
            size = min(20, len(b))
            allowed = size // 5 if size >= 15 else int(size >= 10)
            for start, n in Counter(k - j for j, w in enumerate(b) for k in have[w]).items():
                if n >= size - allowed and any(
                    0 <= start + a and start + a + size <= len(d)
                    and sum(d[start + a + k] == b[a + k] for k in range(size)) >= size - allowed
                    for a in range(len(b) - size + 1)
                ):
                    want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert got == want and want


def test_base_spans_by_plain_patterns(texts):
    rules = (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        (1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (2, r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and pii._luhn(re.sub(r"\D", "", m))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    )
    odd = ["a@b.c.@d.e", "@x.y a@@b.c", "1.2.3.4.5.6.7.8", "+1 (2) 3-4.5 678 90 +12", "4111 1111 1111 1111", "x@y", "%@a.b-"]
    for t in [*texts.values(), *odd]:
        want = sorted((m.start(), k, m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m.group()))
        assert pii.base_spans(t) == want


def test_edit_distance_by_the_full_table():
    import random

    random.seed(1)
    for _ in range(500):
        a, b = ([random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 8))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        limit = random.randint(0, 8)
        got = lines.edit_distance(a, b, limit)
        assert got == row[-1] if row[-1] <= limit else got > limit
