"""Terms that reveal an entity, against counts over all lines."""

import math
import re
from collections import Counter, defaultdict

from boardlens.llm import pii

TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(texts):
    """Per text: {(start, action, end)}."""
    words = lambda line: {w.translate(LOWER) for w in TERM.findall(line)}
    lines = [words(line) for t in texts for line in t.split("\n") if words(line)]
    total, n_t = len(lines), Counter(w for line in lines for w in line)
    n_e, n_et, units, held = Counter(), Counter(), defaultdict(set), []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            spans = [s for s in pii.base_spans(t) if at <= s[0] < at + len(line)]
            own = {t[a:b].lower() for a, _, b in spans}
            for e in own:
                n_e[e] += 1
                for w in words(line):
                    n_et[e, w] += 1
                    units[e, w].add(line)
            if own:
                held.append((i, at, line, own))
            at += len(line) + 1
    out = [set() for _ in texts]
    for i, at, line, own in held:
        spans = pii.base_spans(texts[i])
        for m in TERM.finditer(line):
            w, actions = m.group().translate(LOWER), []
            for e in own:
                if n_e[e] < total:
                    ratio = math.log(total * n_et[e, w] / (n_e[e] * n_t[w])) / math.log(total / n_e[e])
                    if ratio * (1 - n_t[w] / total if len(units[e, w]) == 1 else 1) >= pii.GENERALISE:
                        actions.append("remove" if ratio >= pii.REMOVE - 1e-12 else "generalise")
            if actions and not any(a < at + m.end() and b > at + m.start() for a, _, b in spans):
                out[i].add((at + m.start(), max(actions), at + m.end()))
    return out


def test_term_spans_by_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: s for r, s in zip(rows, brute_force([r.text or "" for r in rows]), strict=True)}
    got = {r.doc_id: {tuple(x) for x in r.added} for r in pii.spans(docs).collect()}
    assert got == want and any(want.values())


def test_a_name_in_one_line_is_hidden(spark):
    other = [(i, f"the meeting of day {i} is in room {i % 7} with the team") for i in range(2, 60)]
    docs = spark.createDataFrame([(1, "the team Maria Kowalska, maria@x.org"), *other], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Maria" not in got[1] and "Kowalska" not in got[1] and "the team" in got[1]
    assert all(got[i] == t for i, t in other)
