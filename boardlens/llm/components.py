"""Connected components over a table of links, as Spark jobs.

Round by round every node hooks to its smallest neighbour if that is smaller,
then links are rewritten to the nodes they now belong to; links inside a node go,
so the table shrinks until none is left. Minima are combined before the shuffle:
a node with very many links costs one row per task. Each round's tables lie in
the shared folder; the driver only learns whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.session import settled

MAX_ROUNDS = 100


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (smallest node of its component) for every node with a link."""
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = settled(one.union(one.select("y", "x")).distinct(), "links")
    labels = None
    for _ in range(MAX_ROUNDS):
        hooked = edges.groupBy("x").agg(F.min("y").alias("low")).select(
            F.col("x").alias("node"), F.least("x", "low").alias("up"))
        higher = hooked.select(F.col("node").alias("_up"), F.col("up").alias("top"))
        hooks = settled(
            hooked.join(higher, hooked["up"] == higher["_up"]).select("node", F.col("top").alias("label")), "hooks")
        if labels is None:
            labels = hooks
        else:
            moved = hooks.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
            labels = settled(
                labels.join(moved, labels["label"] == moved["_node"], "left").select(
                    "node", F.coalesce("_label", "label").alias("label")), "labels")
        left = hooks.select(F.col("node").alias("x"), F.col("label").alias("p"))
        right = hooks.select(F.col("node").alias("y"), F.col("label").alias("q"))
        edges = settled(
            edges.join(left, "x").join(right, "y").where("p <> q").select(
                F.col("p").alias("x"), F.col("q").alias("y")).distinct(), "links")
        if edges.isEmpty():
            return labels
    raise RuntimeError("components did not settle")
