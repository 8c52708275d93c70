"""Fingerprints against plain big-integer hashes and plain comparison, and their edge cases."""

import hashlib
import os
import random

import numpy as np
import pytest

from boardlens.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def plain_hash(text):
    return sum((ord(c) + 1) * pow(fp.BASE, k, fp.MODULUS) for k, c in enumerate(text)) % fp.MODULUS


def words(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefgéß語") for _ in range(pick.randint(1, 9))) for _ in range(n))


def test_prefix_and_span_hashes_equal_big_integers():
    text = words(1, 60) + "\U0001F600\x00tail"
    prefix = fp.prefix_hashes(fp._codes(text))
    assert [int(x) for x in prefix] == [plain_hash(text[:k]) for k in range(len(text) + 1)]
    for a, b in [(0, 5), (3, 3), (17, 60), (40, len(text))]:
        assert int(fp.span_hashes(prefix, np.array([a]), np.array([b]))[0]) == plain_hash(text[a:b])


def test_segments_give_the_same_fingerprint(monkeypatch):
    texts = [words(k, n) for k, n in enumerate([3000, 40, 0, 900, 3000])] + ["a" * 9000, "ab" * 5000, "x"]
    whole = [fp.encoded(a) for a in fp.anchor_lists(texts)]
    monkeypatch.setattr(fp, "SEGMENT", 701)
    assert [fp.encoded(a) for a in fp.anchor_lists(texts)] == whole
    for text, print_ in zip(texts, whole, strict=True):
        anchors = fp.decoded(print_)
        assert len(anchors) <= fp.ANCHORS + 1 and int(anchors["at"][-1]) == len(text)
        assert all(int(h) == plain_hash(text[:int(at)]) for at, h in zip(anchors["at"], anchors["hash"], strict=True))


def alike(a, b):
    return fp.alike(*fp.anchor_lists([a, b]))


def test_likeness_follows_the_shared_text():
    for seed, n in [(5, 30), (6, 200), (7, 2000), (8, 9000)]:
        text, other = words(seed, n), words(seed + 100, n)
        cut = len(text) // 4
        assert alike(text, text) == 1 and alike(text, other) < 0.05
        assert 0.6 < alike(text, text[:-cut] + other[:cut]) <= 0.76
        # A word put in front moves all positions, and costs a block or two only.
        assert alike(text, "front " + text) > 0.85
        middle = len(text) // 2
        assert alike(text, text[middle:] + text[:middle]) > 0.75
        assert alike(text, text[:-1]) > 0.85
    assert alike("", "") == 1 and alike("", "a") == 0 and alike("abcd", "abcx") == 0.75


def test_repeated_contents_do_not_break_it():
    assert alike("a" * 5000, "a" * 5000) == 1
    assert 0 <= alike("a" * 5000, "a" * 4000) <= 1
    assert 0 <= alike("ab " * 5000, "ba " * 4000) <= 1


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        prints = fp.anchor_lists([text, edited, following])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.encoded(prints[0]), fp.encoded(prints[1]),
                    fp.alike(prints[0], prints[1]), fp.alike(prints[0], prints[2])))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in fp.edited_fingerprints(df).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 57])
def test_operator_equals_plain_loop(spark, n):
    rows = [(7 * k % 61 * 3, words(k, k % 40) if k % 9 else None) for k in range(n)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_one_slice_and_small_batches(spark):
    rows = [(k, words(k, 30)) for k in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for slices, size in (("1", "3"), ("200", "1")):
            spark.conf.set("spark.sql.shuffle.partitions", slices)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_odd_rows(spark):
    long = words(3, 150_000)
    rows = [(None, None), (None, "no id"), (1, ""), (2, " \n"), (3, long), (4, long), (4, long), (4, "tie"), (5, "é"), (6, "\x00ab")]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: df["doc_id"] for c in ("o", "h", "slice", "guest", "place", "fingerprint")})
    got = result(df)
    assert len(got) == len(rows)
    assert {g[1] for g in got} == {len(t or "") for _, t in rows}
    by = {g[0]: g for g in got}
    assert by[3][6] == 1.0 or by[3][6] < 0.1  # the next of 3 is one of the three rows of 4
    assert by[3][3] in {g[3] for g in got if g[0] == 4}
    assert len({g[3] for g in got if g[0] == 4}) == 2


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_fingerprints_and_likeness_as_columns(spark):
    rows = [(k, words(k % 3, 300)) for k in range(6)]
    prints = fp.fingerprints(spark.createDataFrame(rows, SCHEMA))
    a = prints.withColumnsRenamed({"doc_id": "a", "fingerprint": "x"}).select("a", "x")
    b = prints.withColumnsRenamed({"doc_id": "b", "fingerprint": "y"}).select("b", "y")
    got = {(r.a, r.b): r.l for r in a.join(b, a["a"] < b["b"]).select("a", "b", fp.likeness("x", "y").alias("l")).collect()}
    assert {k for k, v in got.items() if v == 1} == {(0, 3), (1, 4), (2, 5)} and sum(v < 0.05 for v in got.values()) == 12


def test_common_extensions(spark):
    pick = random.Random(4)
    text = words(9, 120)
    rows = []
    for _ in range(40):
        a, b = pick.randrange(len(text)), pick.randrange(len(text))
        other = text[:b] + text[a:a + pick.randint(0, 90)] + "#" + text[:30]
        rows.append((text, other, a, b))
    rows += [(None, "a", 0, 0), ("a", "a", 0, None), ("a", "a", 2, 0), ("abc", "abc", 0, 0), ("abc", "xabc", 3, 4)]
    got = fp.common_extensions(spark.createDataFrame(rows, "left string, right string, left_at int, right_at int")).collect()
    for r in got:
        left, right = (r.left or "")[r.left_at:], (r.right or "")[r.right_at:] if r.right_at is not None else ""
        inside = r.right_at is not None and r.left_at <= len(r.left or "")
        assert r.common == (len(os.path.commonprefix([left, right])) if inside else 0)
