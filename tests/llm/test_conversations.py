"""The conversation trie against a brute-force one, and its edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from boardlens.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ended[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest()) for p, m in members.items())


def nodes(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({n: df["text"] for n in ("path", "turns", "node", "up", "at", "h", "base", "depth", "slice")})
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
         r.saved_tokens, r.ends_sha256) for r in conversations.prefix_trie(df).collect())


def test_equals_brute_force(spark):
    pick = random.Random(3)
    rows = []
    for c in range(120):
        texts = ["hello", "héllo wörld", "", "again and again"]
        for t in range(pick.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, pick.choice(["user", "bot"]), pick.choice(texts[:2 if c % 3 else 4])))
    assert nodes(spark, rows) == brute_force(rows)


def test_a_long_conversation_and_many_copies(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(400)] + [(5, t, "user", f"t{t}") for t in range(250)]
    rows += [(c, t, "user", "same") for c in range(10, 400) for t in range(3)]
    assert nodes(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    rows = [
        (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 3, "user", "x" * 200_000), (8, 1, "", ""),
        (None, 1, "user", "nobody's"), (13, 1, "a", "bc"), (18, 1, "ab", "c"), (10, 0, "user", "hi"), (11, 0, "user", "hi")]
    assert nodes(spark, rows, extra) == brute_force(rows)


def test_turnless_conversations_belong_to_the_root(spark):
    # 11 takes over eight or fewer turns of 10, which is absent.
    rows = [(c, 0, "user", "hi") for c in range(1, 60) if c % 5]
    got = nodes(spark, rows)
    assert got == brute_force(rows) and got[0][1] == 0


def test_empty_table(spark):
    assert nodes(spark, []) == []
