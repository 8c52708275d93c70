"""Groups of near copies over several blocks: the same classes and links as by plain comparison."""

import random

from boardlens.llm import jaccard


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_links_do_not_depend_on_the_blocks(spark, monkeypatch):
    pick = random.Random(11)
    base = [f"w{pick.randrange(400)}" for _ in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(pick.choice((0, 1, 2, 3, 4))):
            words[pick.randrange(len(words))] = f"x{pick.randrange(9)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"u{k}-{i}" for i in range(30))) for k in range(20)]
    sets = {k: shingles(t) for k, t in rows}
    want = {a: sum(5 * len(x & y) >= 4 * len(x | y) for b, y in sets.items() if b != a) for a, x in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, total in ((500, 2_000_000), (7, 2_000_000), (500, 1500)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", total)
        assert {r.doc_id: r.n_links for r in jaccard.near_duplicates(docs).collect()} == want
