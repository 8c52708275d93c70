"""Component labels against union-find."""

import random

from boardlens.llm.components import components


def test_labels_are_the_smallest_members(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(400, 460)] + [(7, 7)]
    links += [(random.randrange(1000, 1300), random.randrange(1000, 1300)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_no_links_no_labels(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
