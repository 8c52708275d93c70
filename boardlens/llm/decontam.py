"""Benchmark decontamination by spaced seeds.

Items and documents are read as lower-cased words without punctuation. Two fixed
masks pick five words each out of windows of five and six; the ignored position
makes them tolerate a substitution inside. Hashes of all masked windows of the
items are joined to those of all documents, and around each hit the item is laid
along the document and compared word by word: a document holds an item if, in
some window of W aligned words, at most the allowed number differ. W is 20 or
the whole item if shorter, and one word in five may differ (one in all in items
of 10 to 14 words, none in shorter ones). With these numbers the two masks miss
no such window: every pattern of allowed differences leaves one mask untouched.

NULL and empty texts and items under five words match nothing. Repeated items
and documents are found each; extra columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, plain_words_of, text_of
from boardlens.session import settled

MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5))
WINDOW = 20
#: Seeds of a benchmark are broadcast up to this number of rows (about 40 bytes each).
BROADCAST_SEEDS = 1_000_000


def _word_hashes() -> Column:
    return F.transform(plain_words_of(), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (with ``h``) for every masked window: pos, seed."""
    at = df.select("*", F.posexplode("h").alias("pos", "_first"))
    h, pos = F.col("h"), F.col("pos")
    masked = [
        F.when(pos + mask[-1] < F.size(h), F.xxhash64(F.lit(m), *[F.get(h, pos + k) for k in mask]))
        for m, mask in enumerate(MASKS)
    ]
    return at.select("*", F.explode(F.array(*masked)).alias("seed")).drop("_first").where("seed IS NOT NULL")


def content_key() -> Column:
    """128 bits of the text, so that equal texts are the same document here."""
    return F.md5(text_of().cast("binary"))


def item_table(benchmark: DataFrame) -> DataFrame:
    items = columns_or_null(benchmark, item_id="bigint", text="string").select(
        "item_id", _word_hashes().alias("h"))
    window = F.least(F.size("h"), F.lit(WINDOW))
    allowed = F.when(window >= 15, F.floor(window / 5)).when(window >= 10, 1).otherwise(0)
    return items.where(F.size("h") >= 5).select(
        "item_id", "h", F.xxhash64("h").alias("item"), window.alias("window"), allowed.cast("int").alias("allowed"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document text and item it holds.

    content, item_id, window, matched (equal words in the best window), start and
    end (words of the document covered, end exclusive).
    """
    items = settled(item_table(benchmark), "benchmark-items")
    seeds = _seeds(items.select("item_id", "h", "item", "window", "allowed")).select(
        "seed", F.col("pos").alias("item_pos"), "item_id", "item", F.size("h").alias("item_size"))
    seeds = seeds.dropDuplicates(["seed", "item_pos", "item_id", "item"])
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    texts = columns_or_null(docs, text="string").select(content_key().alias("content"), _word_hashes().alias("h"))
    hits = _seeds(texts).join(seeds, "seed").withColumn("start", F.col("pos") - F.col("item_pos"))
    # The stretch of the document the item lies along; positions outside the text are NULL.
    h, start = F.col("h"), F.col("start")
    aligned = F.transform(
        F.sequence(F.lit(0), F.col("item_size") - 1),
        lambda i: F.when(start + i >= 0, F.get(h, F.greatest(start + i, F.lit(0)))))
    laid = hits.groupBy("content", "item_id", "item", "start").agg(F.first(aligned).alias("d"))
    item_side = items.select("item_id", "item", F.col("h").alias("b"), "window", "allowed").dropDuplicates(["item_id", "item"])
    pairs = laid.join(item_side, (laid["item"] == item_side["item"]) & laid["item_id"].eqNullSafe(item_side["item_id"])).select(
        "content", laid["item_id"], "start", "d", "b", "window", "allowed")
    equal = F.zip_with("d", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    pairs = pairs.withColumn("_eq", equal)
    inside = lambda a: F.filter(  # noqa: E731  windows reach no further than the text does
        F.slice(F.col("d"), a + 1, F.col("window")), lambda x: x.isNull())
    windows = F.transform(
        F.sequence(F.lit(0), F.size("b") - F.col("window")),
        lambda a: F.struct(
            a.alias("a"),
            F.when(F.size(inside(a)) == 0, F.aggregate(
                F.slice("_eq", a + 1, F.col("window")), F.lit(0), lambda s, x: s + x)).otherwise(0).alias("n")))
    good = F.filter(windows, lambda w: w.n >= F.col("window") - F.col("allowed"))
    found = pairs.withColumn("_good", good).where(F.size("_good") > 0).select(
        "content", "item_id", "window",
        F.array_max(F.transform("_good", lambda w: w.n)).alias("matched"),
        (F.col("start") + F.col("_good")[0]["a"]).alias("start"),
        (F.col("start") + F.element_at("_good", -1)["a"] + F.col("window")).alias("end"))
    return found.groupBy("content", "item_id").agg(
        F.max("window").alias("window"), F.max("matched").alias("matched"),
        F.min("start").alias("start"), F.max("end").alias("end"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, window, matched, start, end for every document row and item it holds."""
    found = settled(overlaps(docs, benchmark), "benchmark-overlaps")
    ids = columns_or_null(docs, doc_id="bigint", text="string").select("doc_id", content_key().alias("content"))
    return ids.join(found, "content").drop("content")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = settled(overlaps(docs, benchmark).select("content").distinct(), "leaked-texts")
    keyed = docs.withColumn("_content", content_key())
    return keyed.join(found, keyed["_content"] == found["content"], "left_anti").drop("_content")
