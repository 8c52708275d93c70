"""Quality rules: plain counts and a hashed n-gram likelihood ratio.

Words and word pairs are hashed to buckets. One multinomial over the buckets is
counted from trusted documents (labelled good and not toxic, at most
``TRUSTED`` of them, a bounded sample by hash order), the other from every
document. A document's score is the sum over its n-grams of the log ratio of
trusted to raw probability, divided by the number of its n-grams; it is kept if
it passes the base rules and scores at least ``THRESHOLD``.

NULL and blank texts have no words, so the base rules reject them. Repeated rows
are judged each; labels for unknown documents and repeated labels change nothing
but the sample; without trusted labels the score is 0 for all. The two models
have a fixed number of buckets, so what the driver sees does not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, text_of, words_of

BUCKETS = 1 << 14
TRUSTED = 20_000
PSEUDO = 1.0
THRESHOLD = -0.1
MIN_WORDS = 50
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
POSITION_BITS = 24


def _hashes(words: str = "words") -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: str, n: int) -> Column:
    """Hash of every n consecutive words."""
    h = F.col(hashes)
    starts = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(
        F.size(h) >= n, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    ).otherwise(F.array().cast("array<bigint>"))


def buckets(hashes: str = "hashes") -> Column:
    """Bucket numbers of a text's words and word pairs."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    twos = F.transform(_grams(hashes, 2), lambda h: (F.pmod(h, F.lit(BUCKETS)) + BUCKETS).cast("int"))
    return F.concat(ones, twos)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows found twice or more in the text.

    Windows are sorted as one long each: the upper bits of the window's hash, then
    its position. Equal neighbours are repeats. Should two different windows agree
    in the upper bits, or a text be too long for the position bits, the document
    is counted again by looking every window up among the repeated hashes.
    """
    low = (1 << POSITION_BITS) - 1
    df = df.withColumn("_t", _grams("hashes", 3))
    packed = F.sort_array(F.transform("_t", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))
    some = (F.size("_t") > F.size(F.array_distinct("_t"))) & (F.size("_t") <= low)
    df = df.withColumn("_s", F.when(some, packed))
    s, t = F.col("_s"), F.col("_t")
    top = lambda x: F.shiftright(x, POSITION_BITS)
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")

    def next_equal(x, j):
        following = F.get(s, j + 1)
        same = top(x) == top(following)
        return F.when(same & (F.get(t, at(x)) == F.get(t, at(following))), 1).when(same, 2).otherwise(0)

    df = df.withColumn("_e", F.transform("_s", next_equal))
    e = F.col("_e")
    fast = F.sort_array(F.filter(
        F.transform(s, lambda x, j: F.when((F.get(e, j) > 0) | (F.coalesce(F.get(e, j - 1), F.lit(0)) > 0), at(x))
                    .otherwise(-1)), lambda p: p >= 0))
    sorted_hashes = F.sort_array(t)
    twice = F.array_distinct(F.filter(sorted_hashes, lambda x, j: x == F.get(sorted_hashes, j + 1)))
    slow = F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(-1)), lambda p: p >= 0)
    unsure = F.array_contains(e, 2) | (F.size(t) > low)
    df = df.withColumn(
        "_r", F.when(unsure, slow).when(s.isNotNull(), fast).otherwise(F.array().cast("array<int>")))
    r = F.col("_r")
    covered = F.aggregate(
        F.transform(r, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(r, j + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered).drop("_t", "_s", "_e", "_r")


def base_counts(docs: DataFrame) -> DataFrame:
    """The documents with ``words``, ``hashes``, the plain counts and ``base_failed``."""
    text = text_of()
    df = docs.withColumn("words", words_of()).withColumn("hashes", _hashes())
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, GAPS, "") != "")
    df = df.withColumn("_lines", lines).withColumns({
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.length(F.translate(text, GAPS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    }).drop("_lines")
    df = _repeat_words(df)
    return df.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most ``limit`` documents labelled good and not toxic, by hash order."""
    good = columns_or_null(labels, doc_id="bigint", quality="int", toxic="int").where(
        "doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0")
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRUSTED) -> list[float]:
    """Log ratio of trusted to raw probability for each bucket."""
    # At most ``limit`` ids: broadcast.
    trusted = F.broadcast(trusted_ids(labels, limit).withColumn("_trusted", F.lit(1)))
    grams = (
        columns_or_null(docs, doc_id="bigint", text="string").join(trusted, "doc_id", "left")
        .select("_trusted", words_of().alias("words"))
        .select("_trusted", _hashes().alias("hashes"))
        .select("_trusted", F.explode(buckets()).alias("bucket")))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("good")).collect()
    raw_all = sum(r.raw for r in counts) + PSEUDO * 2 * BUCKETS
    good_all = sum(r.good for r in counts) + PSEUDO * 2 * BUCKETS
    seen = {r.bucket: (r.raw, r.good) for r in counts} if any(r.good for r in counts) else {}
    import math

    base = math.log(raw_all / good_all) if seen else 0.0
    return [
        round(math.log((g + PSEUDO) / (r + PSEUDO)) + base, 4) if seen else 0.0
        for r, g in (seen.get(b, (0, 0)) for b in range(2 * BUCKETS))
    ]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, limit: int) -> DataFrame:
    """``_doc`` (a struct of the document's columns, so that no name clashes) and COUNTS."""
    ratios = fit(docs, labels, limit)
    # One literal of a fixed number of values; the split is folded when the plan is made.
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    df = base_counts(whole).withColumn("_b", buckets())
    total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(table, b))
    score = F.when(F.size("_b") > 0, total / F.size("_b")).otherwise(F.lit(0.0))
    return df.withColumn("score", score).withColumn(
        "kept", ~F.col("base_failed") & (F.round("score", 6) >= threshold)).select("_doc", *COUNTS)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRUSTED) -> DataFrame:
    """The documents' columns and COUNTS, which take the place of columns of their names."""
    own = [F.col(f"_doc.`{c}`") for c in docs.columns if c.lower() not in COUNTS]
    return _judged(docs, labels, threshold, limit).select(*own, *COUNTS)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRUSTED) -> DataFrame:
    """The documents the rules keep, with their columns.

    An explode of one or no element does the filtering: a WHERE would be pushed
    below the projections and repeat their nested expressions many times over.
    """
    once = F.expr("if(kept, array(1), cast(array() as array<int>))")
    return _judged(docs, labels, threshold, limit).select("_doc", F.explode(once).alias("_once")).select("_doc.*")
