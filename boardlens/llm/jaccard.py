"""Near-duplicate documents: a chosen-path join on five-word shingles, Jaccard 0.8 or more.

A document is the set of its five-word shingles (A-Z lower-cased; a text of one
to four words is one shingle), embedded as 64 minima of hash functions. A run
splits all documents by one or two sampled minima, then splits every bucket that
is still large by the next, chosen by the bucket's path; small buckets are
compared by brute force on the minima. Runs repeat until a pair at the
threshold is met with the target recall. What the buckets tie together forms
candidate groups; inside a group every two documents are compared exactly on
their whole shingle sets, in pairs of blocks of bounded size, and a block pair
returns one row per document (its links there) and a spanning set of links.
What is sent to the block pairs is each document's difference from one member of
its group: sizes of intersections follow from differences alone, and those of near
copies are short. Equal texts are one node with a number of copies, so copies cost
nothing.

NULL and blank texts have no shingles and no links, not even to each other.
Repeated rows are copies. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm.components import components
from boardlens.llm.text import columns_or_null, text_of
from boardlens.llm.tokens import groups, mix, pieces, windows
from boardlens.session import settled

SIMILARITY = 0.8
SHINGLE = 5
MINIMA = 64
DEPTH = 4
SMALL = 50
RECALL = 0.999
SLACK = 0.25  # five standard deviations of the estimate from 64 minima
#: Documents, and shingles in all, of a block; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 500, 2_000_000
_FACTORS = mix(np.arange(MINIMA), 71) | np.uint64(1)


def meeting_chance(depth: int, similarity: float = SIMILARITY) -> float:
    """Chance that two sets of this similarity share a path of the depth.

    A path has one child, with chance 1/4 two, each shared with the similarity.
    """
    chance = 1.0
    for _ in range(depth):
        p = similarity * chance
        chance = 0.75 * p + 0.25 * (1 - (1 - p) ** 2)
    return chance


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(depth)))


def _shingles(words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several texts and the text each belongs to, distinct and sorted within it."""
    hashes = words.hashes(lower=True)
    value, at = windows(hashes, words.first, SHINGLE, seed=73)
    owner = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        extra = []
        for text in short:
            a, n = words.first[text], words.count[text]
            extra.append(mix((hashes[a:a + n] * (mix(np.arange(n), 75) | np.uint64(1))).sum(keepdims=True), 75 + int(n))[0])
        value = np.concatenate((value, np.array(extra, np.uint64)))
        owner = np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[new], owner[new]
    return value, owner


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, words in pieces(batch.column("text")):
            value, owner = _shingles(words)
            if not len(value):
                continue
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.empty((len(head), MINIMA), np.uint32)
            for i, factor in enumerate(_FACTORS):
                low[:, i] = np.minimum.reduceat(value * factor, head) >> np.uint64(32)
            offsets = np.arange(len(head) + 1) * MINIMA
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(owner[head] + a)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(low.view(np.int32).ravel())),
                 pa.array(np.diff(np.append(head, len(owner))))],
                ["node", "minima", "size"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's connected group."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small buckets: members tied by estimated similarity, as one link per member."""
    nodes_a: list[bytes] = []
    nodes_b: list[bytes] = []
    for group in groups(batches, ["path"]):
        n = len(group)
        if n > 1:
            minima = np.asarray(group.column("minima").flatten()).reshape(n, MINIMA)
            share = (minima[:, None, :] == minima[None, :, :]).mean(axis=2)
            a, b = np.nonzero(np.triu(share >= SIMILARITY - SLACK, 1))
            root = _roots(n, a, b)
            ids = group.column("node").to_pylist()
            for i in np.flatnonzero(root != np.arange(n)):
                nodes_a.append(ids[root[i]])
                nodes_b.append(ids[i])
        if len(nodes_a) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(nodes_a, pa.binary()), pa.array(nodes_b, pa.binary())], ["a", "b"])
            nodes_a, nodes_b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(nodes_a, pa.binary()), pa.array(nodes_b, pa.binary())], ["a", "b"])


def _children(paths: DataFrame) -> DataFrame:
    """Rows (path, node, minima) one level down."""
    def child(c: int):
        at = F.pmod(F.xxhash64(F.lit(c), "path"), F.lit(MINIMA)).cast("int")
        return F.xxhash64("path", at, F.get("minima", at))

    second = F.when(F.pmod(F.xxhash64(F.lit(-1), "path"), F.lit(4)) == 0, child(1))
    return paths.select("node", F.explode(F.array_distinct(F.array(child(0), second))).alias("path")).where("path IS NOT NULL")


def candidates(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Links a, b that tie every two similar nodes together, directly or not, with the target recall."""
    runs = runs_needed(recall)
    top = nodes.select("node", "minima", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    frontier = _children(top.select("node", "minima", F.xxhash64("run").alias("path")))
    links = None
    for level in range(1, DEPTH + 1):
        frontier = settled(frontier, f"paths-{level}")
        shared = settled(
            frontier.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1"),
            f"buckets-{level}")
        small = frontier.join(shared.where(F.col("n") <= SMALL), "path").select("path", "node")
        found = (
            small.join(nodes.select("node", "minima"), "node").select("path", "node", "minima")
            .repartition("path").sortWithinPartitions("path")
            .mapInArrow(_compare, "a binary, b binary"))
        links = found if links is None else links.union(found)
        large = frontier.join(shared.where(F.col("n") > SMALL), "path")
        if level == DEPTH:
            # Members of a bucket this deep agree in all its minima; the smallest ties them.
            links = links.union(large.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")))
        else:
            frontier = _children(large.select("path", "node").join(nodes.select("node", "minima"), "node"))
    return links


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in pieces(batch.column("text")):
            value, owner = _shingles(words)
            rest = [batch.column(c).slice(a, b - a) for c in ("node", "copies", "label", "blocks")]
            yield pa.RecordBatch.from_arrays(
                [*rest, _lists(value.view(np.int64), owner, b - a, pa.int64())],
                ["node", "copies", "label", "blocks", "shingles"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block as differences from their group's representative, which comes first in its block.

    Signed by position: shingles that the member lacks, then those it has besides.
    """
    of, base = None, np.zeros(0, np.int64)
    for batch in batches:
        shingles = batch.column("shingles")
        values, ends = shingles.flatten().to_numpy(), np.diff(np.asarray(shingles.offsets))
        starts = np.cumsum(ends) - ends
        keys = list(zip(batch.column("label").to_pylist(), batch.column("to").to_pylist(), strict=True))
        own = batch.column("own").to_pylist()
        keep, lists, lacks = [], [], []
        for i, key in enumerate(keys):
            mine = values[starts[i]:starts[i] + ends[i]]
            if key != of:
                of, base = key, mine.copy()
            if own[i]:
                gone, more = np.setdiff1d(base, mine, assume_unique=True), np.setdiff1d(mine, base, assume_unique=True)
                keep.append((i, len(base), ends[i]))
                lists.append(np.concatenate((gone, more)))
                lacks.append(len(gone))
        if keep:
            rows = pa.array([k[0] for k in keep])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(rows) for c in ("node", "copies", "label", "blocks", "to")],
                 pa.array([k[1] for k in keep], pa.int64()), pa.array([k[2] for k in keep], pa.int64()), pa.array(lacks, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.int64()))],
                ["node", "copies", "label", "blocks", "block", "base", "size", "lacks", "change"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of one group: links per member, and one link to its group's smallest here."""
    out: list[list] = [[], [], []]

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["node", "root", "links"])

    for group in groups(batches, ["label", "low", "high"]):
        n = len(group)
        if n > 1:
            change = group.column("change")
            length = np.diff(np.asarray(change.offsets))
            size, lacks, base = (group.column(c).to_numpy() for c in ("size", "lacks", "base"))
            values, token = np.unique(np.asarray(change.flatten()), return_inverse=True)
            owner = np.repeat(np.arange(n), length)
            uses = np.bincount(token, minlength=len(values))
            rank = np.cumsum(uses > 1) - 1
            keep = uses[token] > 1
            owner, token = owner[keep], rank[token[keep]]
            # Shingles of both: those of the representative less what either lacks, and the changes that agree.
            # A shingle is either lacked or had besides, so equal changes have equal signs.
            both = base[:, None] - lacks[:, None] - lacks[None, :].astype(np.float64)
            order = np.argsort(token, kind="stable")
            owner, token = owner[order], token[order]
            width = 4096
            for a in range(0, int(token[-1]) + 1 if len(token) else 0, width):
                lo, hi = np.searchsorted(token, (a, a + width))
                part = np.zeros((n, width), np.float32)
                part[owner[lo:hi], token[lo:hi] - a] = 1
                both += part @ part.T
            linked = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            block = np.asarray(group.column("block"))
            if group.column("low")[0].as_py() != group.column("high")[0].as_py():
                linked &= block[:, None] != block[None, :]
            copies = np.asarray(group.column("copies"))
            count = linked @ copies
            a, b = np.nonzero(np.triu(linked))
            root = _roots(n, a, b)
            ids = group.column("node").to_pylist()
            for i in np.flatnonzero(count):
                for column, value in zip(out, (ids[i], ids[root[i]], int(count[i])), strict=True):
                    column.append(value)
        if len(out[0]) > 5000:
            yield flush()
            out = [[], [], []]
    yield flush()


def node_key():
    return F.unhex(F.md5(text_of().cast("binary")))


def node_links(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, copies) with shingles, and node, root, links for every node with a similar one."""
    texts = columns_or_null(docs, text="string").select(node_key().alias("node"), text_of().alias("text"))
    nodes = settled(
        texts.mapInArrow(_minima, "node binary, minima array<int>, size bigint")
        .groupBy("node").agg(F.first("minima").alias("minima"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")), "nodes")
    labels = components(candidates(nodes, recall))
    sized = labels.join(nodes.select("node", "copies", "size"), "node")
    sizes = sized.groupBy("label").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = settled(sized.join(sizes, "label").select("node", "copies", "label", "blocks"), "members")
    # Always by shuffle: members are a share of all texts, and small only while the corpus is.
    named = texts.hint("merge").join(members, "node").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("text", "copies", "label", "blocks")])
    sets = named.mapInArrow(
        _sets, "node binary, copies bigint, label binary, blocks int, shingles array<bigint>")
    # The member that names the group is its representative, and goes to every block of it.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    named_after = F.col("node") == F.col("label")
    dealt = sets.withColumn("block", block).withColumn(
        "to", F.explode(F.when(named_after, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    dealt = dealt.withColumns({"own": F.col("to") == F.col("block"), "later": ~named_after})
    changes = (
        dealt.select("label", "to", "later", "own", "node", "copies", "blocks", "shingles")
        .repartition("label", "to").sortWithinPartitions("label", "to", "later")
        .mapInArrow(_differences, "node binary, copies bigint, label binary, blocks int, block int, base bigint, size bigint, "
                                  "lacks bigint, change array<bigint>"))
    placed = changes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    exact = (
        placed.select("label", "low", "high", "block", "node", "copies", "base", "size", "lacks", "change")
        .repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")
        .mapInArrow(_exact, "node binary, root binary, links bigint"))
    return nodes, settled(exact, "exact-links")


def classed(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, node, class (NULL without shingles) and n_links per row."""
    nodes, links = node_links(docs, recall)
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies").join(counts, "node", "left").join(labels, "node", "left").select(
        F.col("node").alias("_node"), F.coalesce("label", "node").alias("class"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = columns_or_null(docs, doc_id="bigint", text="string").select("doc_id", node_key().alias("node"))
    return settled(ids.join(known, ids["node"] == known["_node"], "left").drop("_node"), "classed")


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links (other rows at the similarity or above) per row."""
    rows = classed(docs, recall)
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "class", "left").select(
        "doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents, one of each class: that with the smallest doc_id (NULL last), then text hash.

    Rows equal in doc_id and text are one document; rows without words all stay.
    """
    rows = classed(docs, recall).where("n_links > 0")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    first = rows.groupBy("class").agg(F.min(own).alias("first"))
    gone = settled(
        rows.join(first, "class").where(~own.eqNullSafe(F.col("first")))
        .select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct(), "copies-gone")
    keyed = docs.withColumn("_key", node_key())
    return keyed.join(
        gone, (F.col("_key") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").drop("_key")
