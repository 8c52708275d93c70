"""Prefix trie of conversations by truncation peeling.

A conversation is a path of prefix keys: key d is a digest of its first d turns,
so equal keys are equal beginnings. Peeling starts at the greatest depth: what
ends there is merged with what survives from below, the last turn is stripped
and the rest regrouped one turn up, and counts, minima and sums are aggregated
on the way, so that a node is found and finished in the same grouping.

Between two depths at which nothing meets or ends, stripping changes nothing. So
the distinct paths are sorted once, the length shared with either neighbour tells
where a path next meets another, and a round strips straight to that depth. There
are as many rounds as distinct shared lengths, however long the longest
conversation is; the nodes in between differ from the one below only in depth and
tokens, and are written out at the end.

Groupings combine before their shuffle, so a very common beginning costs a row
per task. The rounds' tables lie in the shared folder. A conversation is one row
of 24 bytes a turn; members are never collected.

Defined cases: rows without conv_id belong to no conversation; NULL role or text is
empty; equal turn numbers are ordered by a digest of role and text, repeated rows
are turns of their own; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, text_of
from boardlens.session import new_folder, settled

SIBLINGS = 5
SHARED_TURNS = 9
IDS_A_CHUNK = 1024
KEY_BYTES = 16
_STEP = "struct<key:binary,bytes:bigint>"
_NODE = (f"at bigint, path array<{_STEP}>, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved bigint, lcp_left bigint, lcp_right bigint, up bigint")


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: a digest of role and text, and the text's bytes."""
    rows = columns_or_null(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", F.substring(digest, 1, KEY_BYTES).alias("digest"),
                            F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def shared_beginnings(lists: DataFrame, siblings: int = SIBLINGS, turns: int = SHARED_TURNS) -> DataFrame:
    """Conversations whose first turns are those of the first of their siblings.

    The number taken over, below ``turns``, follows from a checksum of the id.
    """
    own = lists.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % siblings,
        "h": (F.crc32(F.col("conv_id").cast("string")) % turns).cast("int")})
    first = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, turns - 1).alias("first"))
    none = F.array().cast("array<struct<digest:binary,bytes:bigint>>")
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    begin = F.coalesce(F.when(F.col("h") > 0, F.slice("first", 1, F.greatest("h", F.lit(1)))), none)
    return own.join(first, "base", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for turns in batch.column("turns").to_pylist():
            key, path = b"", []
            for t in turns:
                key = hashlib.sha256(key + t["digest"]).digest()[:KEY_BYTES]
                path.append({"key": key, "bytes": t["bytes"]})
            paths.append(path)
        steps = pa.list_(pa.struct([("key", pa.binary()), ("bytes", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, steps)], ["conv_id", "path"])


def prefix_paths(lists: DataFrame) -> DataFrame:
    """conv_id and its path: per turn the key of all turns up to it, and the turn's bytes."""
    return lists.mapInArrow(_chain, f"conv_id bigint, path array<{_STEP}>")


def _end_key(path: str | Column = "path") -> Column:
    return F.coalesce(F.try_element_at(path, F.lit(-1))["key"], F.lit(b""))


def _key_at(depth: int) -> Column:
    return F.col("path")[depth - 1]["key"] if depth else F.lit(b"")


def _shared(a: Column, b: Column) -> Column:
    """Number of first steps that two paths share; keys are of whole prefixes, so it is a count of equal ones."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x["key"] == y["key"]), lambda same: F.coalesce(same, F.lit(False)))).cast("bigint")


def _with_neighbours(classes: DataFrame) -> DataFrame:
    """Adds the lengths shared with the path before and after in sorted order (0 at either end).

    Paths are range-partitioned and written, so slices keep their numbers; only each
    slice's first and last path meet those of other slices, in a table of a row a slice.
    """
    keys = F.transform("path", lambda s: s["key"])
    cut = settled(
        classes.withColumn("order", keys).repartitionByRange("order").withColumn("slice", F.spark_partition_id()), "sorted-paths")
    inside = Window.partitionBy("slice").orderBy("order")
    slices = Window.partitionBy(F.lit(0)).orderBy("slice")
    ends = cut.groupBy("slice").agg(F.min_by("path", "order").alias("first"), F.max_by("path", "order").alias("last")).select(
        "slice", F.lag("last").over(slices).alias("before"), F.lead("first").over(slices).alias("after"))
    near = cut.withColumns({"prev": F.lag("path").over(inside), "next": F.lead("path").over(inside)}).join(ends, "slice")
    return near.select(
        *classes.columns,
        F.coalesce(_shared(F.col("path"), F.coalesce("prev", "before")), F.lit(0)).alias("lcp_left"),
        F.coalesce(_shared(F.col("path"), F.coalesce("next", "after")), F.lit(0)).alias("lcp_right"))


def _finished(nodes: DataFrame) -> DataFrame:
    """Nodes of one grouping: the depth to strip to, and the tokens saved below that depth's child."""
    up = F.greatest("lcp_left", "lcp_right")
    return nodes.withColumn("up", F.when(F.col("at") == 0, F.lit(-1)).otherwise(up).cast("bigint"))


def _peel(classes: DataFrame) -> DataFrame:
    """Compressed nodes: those with several children, with ends, or without children.

    ``at`` is a node's depth and ``up`` the depth of the next one above; ``saved``
    counts the subtree below ``at``, without the node itself.
    """
    spark = classes.sparkSession
    folder = new_folder(spark, "trie")
    up = F.greatest("lcp_left", "lcp_right")
    paths = settled(_with_neighbours(classes).withColumns({"at": F.size("path").cast("bigint"), "up": up}), "trie-paths")
    names = [c.split()[0] for c in _NODE.split(", ")]
    # Paths that nobody extends are leaves of the trie at once; the others wait for the round of their depth.
    leaves = paths.where("up < at").withColumns(
        {"n_children": F.lit(0).cast("bigint"), "n_leaves": F.lit(1).cast("bigint"), "saved": F.lit(0).cast("bigint")})
    leaves.select(*names).write.mode("append").partitionBy("up").parquet(folder)
    ended = paths.where("up = at")
    # At most one number a depth: the lengths that neighbours share.
    rounds = sorted({r[0] for r in paths.select("lcp_left").distinct().collect()} | {0}, reverse=True)
    for depth in rounds if not paths.isEmpty() else []:
        bytes_above = F.aggregate(
            F.slice("path", depth + 1, F.col("at").cast("int") - depth), F.lit(0).cast("bigint"), lambda total, s: total + s["bytes"])
        survivors = spark.read.schema(_NODE).parquet(folder).where(F.col("up") == depth).select(
            _key_at(depth).alias("node"), F.slice("path", 1, depth).alias("path"), "conv_id", "n_convs",
            F.lit(1).alias("child"), F.col("n_leaves").alias("leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * bytes_above).alias("saved"), "lcp_left", "lcp_right")
        items = ended.where(F.col("at") == depth).select(
            _key_at(depth).alias("node"), "path", "conv_id", "n_convs", F.lit(0).alias("child"), F.lit(0).cast("bigint").alias("leaves"),
            F.lit(0).cast("bigint").alias("saved"), "lcp_left", "lcp_right").unionByName(survivors)
        nodes = items.groupBy("node").agg(
            F.any_value("path").alias("path"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("child").cast("bigint").alias("n_children"), F.greatest(F.sum("leaves"), F.lit(1)).cast("bigint").alias("n_leaves"),
            F.sum("saved").alias("saved"), F.min("lcp_left").alias("lcp_left"), F.min("lcp_right").alias("lcp_right"))
        _finished(nodes.withColumn("at", F.lit(depth).cast("bigint"))).select(*names).write.mode("append").partitionBy("up").parquet(folder)
    return spark.read.schema(_NODE).parquet(folder) if not paths.isEmpty() else spark.createDataFrame([], _NODE)


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from id lists that come in order; only the running digest is kept."""
    key, running = None, None

    def row():
        return pa.RecordBatch.from_pydict({"node": pa.array([key], pa.binary()), "ends_sha256": [running.hexdigest()]})

    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != key:
                if running is not None:
                    yield row()
                key, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if running is not None:
        yield row()


def ends(paths: DataFrame) -> DataFrame:
    """node and the SHA-256 of the ids of the conversations that end there, ascending, joined by commas.

    Ids are joined in chunks by many tasks; a node's own task only runs over its chunks.
    """
    chunks = paths.select(_end_key().alias("node"), "conv_id", F.expr(f"floor(conv_id / {IDS_A_CHUNK})").alias("chunk")).groupBy(
        "node", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(
        _hash_streams, "node binary, ends_sha256 string")


def trie(lists: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations given as ``turn_lists``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of turns that members share, over the subtree) and
    ends_sha256 (of the members that end here).
    """
    paths = settled(prefix_paths(lists), "paths")
    classes = paths.groupBy(_end_key().alias("node")).agg(
        F.any_value("path").alias("path"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).drop("node")
    nodes = _peel(classes)
    at = F.coalesce(F.try_element_at("path", F.col("at").cast("int"))["key"], F.lit(b""))
    above = F.when(F.col("up") > 0, F.try_element_at("path", F.greatest(F.col("up").cast("int"), F.lit(1)))["key"])
    nodes = nodes.withColumns({"node": F.when(F.col("at") > 0, at).otherwise(F.lit(b"")), "above": above})
    # The root has one row, every other parent meets its children by key.
    top = nodes.where("at = 0").select(F.col("conv_id").alias("root_conv"))
    parents = nodes.where("at > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("parent"))
    none = hashlib.sha256(b"").hexdigest()
    found = (
        nodes.join(parents, "above", "left").join(ends(paths), "node", "left")
        .withColumn("parent", F.when(F.col("up") == 0, top.scalar()).otherwise(F.col("parent")))
    )
    # A node's chain up to the next one above: same members, one child each.
    depths = F.when(F.col("at") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.col("at"), F.col("up") + 1, F.lit(-1).cast("bigint")))
    own = F.aggregate(
        F.slice("path", F.greatest("depth", F.lit(1)).cast("int"), (F.col("at") - F.col("depth") + 1).cast("int")),
        F.lit(0).cast("bigint"), lambda total, s: total + s["bytes"])
    bottom = F.col("depth") == F.col("at")
    return found.select("*", F.explode(depths).alias("depth")).select(
        "conv_id", "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("up") + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.when(F.col("depth") > 0, own).otherwise(F.lit(0))).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that take over the first turns of their siblings."""
    return trie(shared_beginnings(settled(turn_lists(conversations), "turn-lists")))


ORACLE = """
WITH own AS (
 SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
 SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
   range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: [CAST(ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
 SELECT i.conv_id, o.role, o.text, o.k, 0 AS part FROM ids i JOIN own o ON o.conv_id = i.base AND o.k <= i.h
 UNION ALL SELECT i.conv_id, o.role, o.text, o.k, 1 FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.k > i.h),
lists AS (
 SELECT ids.conv_id, coalesce(l, []) AS l FROM ids LEFT JOIN (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY part, k) AS l FROM turns GROUP BY conv_id) USING (conv_id)),
steps AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS p, CASE WHEN d > 0 THEN l[1:d - 1] END AS pp, strlen(l[d].t) AS bytes
 FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM lists)),
nodes AS (
 SELECT p, d AS depth, any_value(pp) AS pp, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN any_value(bytes) ELSE 0 END AS bytes,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM steps GROUP BY p, d),
kids AS (SELECT pp AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY pp),
sums AS (
 SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
  SELECT n.p[1:a] AS p, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.bytes AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM nodes) n LEFT JOIN kids ON kids.p = n.p) GROUP BY p)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
 CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON sums.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN nodes up ON n.depth > 0 AND up.p = n.pp
"""
