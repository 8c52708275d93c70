"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source documents lie in key
order, cut into about sqrt(n) key ranges; word counts are summed per range, the
range sums are added up in order (a window over sqrt(n) rows of the source), and
a window inside each range adds up its documents. A source of n documents thus
never has more than about sqrt(n) rows in one task. Each source is cut at its
exact budget, after as many whole epochs as the budget holds.

NULL text counts 0 words; NULL is a source of its own, last in order; documents
of size 0 take 0; repeated rows are documents of their own, ties in the key go
by doc_id and size; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, text_of, words_of
from boardlens.session import settled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2.0
SALT = "mix-1"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def mix_key() -> Column:
    """60 random bits fixed by document id and text."""
    seed = F.concat_ws(":", F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_of())
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Target words per source: ``share`` of all words by weight, none above ``epochs`` times its size.

    Sources at their limit are those with the smallest limit per weight. In that
    order, the level a weight of 1 gets if the first k sources are at their limit
    follows from running sums; the first source whose own limit is not below the
    level ends the search. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1))
    table = totals.select("*", weight.alias("_weight"), (F.col("source_size") * F.lit(epochs)).alias("_limit"))
    table = table.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    table = table.withColumn(
        "_level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        / F.sum("_weight").over(onward))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return table.select(
        "source", "source_size", "n_docs",
        F.least("_limit", F.coalesce(level, F.lit(float("inf"))) * F.col("_weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of the document)."""
    sizes = settled(
        columns_or_null(docs, doc_id="bigint", source="string", text="string").select(
            "doc_id", "source", word_count().alias("size"), mix_key().alias("_key")),
        "mix-sizes")
    return takes(sizes, weights, share, epochs)


def takes(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """The same from rows with source, size, _key; their other columns stay."""
    targets = settled(
        source_targets(sizes, weights, share, epochs).withColumn(
            "_ranges", F.ceil(F.sqrt("n_docs")).cast("bigint")), "mix-targets")
    # NULL is a source; a marker column lets the joins and windows treat it as any other.
    named = lambda df: df.withColumn("_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    cut = named(sizes).join(named(targets).drop("source"), "_source")
    cut = cut.withColumn("_range", F.expr("shiftright(shiftright(_key, 30) * _ranges, 30)"))
    ordered = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("_source", "_range").agg(F.sum("size").alias("_words")).select(
        "_source", "_range", F.coalesce(F.sum("_words").over(ordered), F.lit(0)).alias("_carried"))
    inside = (
        Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("_carried") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return (
        cut.join(carried, ["_source", "_range"])
        .withColumn("taken", taken.cast("bigint"))
        .drop("_source", "_range", "_ranges", "_carried", "_key", "n_docs"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """The mix itself: all columns of the documents, ``mix_epoch`` and ``mix_words`` (taken in it), one row per
    document and epoch. A document cut at the budget keeps its first words, joined by a blank.

    Rows equal in doc_id, source and text are taken as equals.
    """
    row_key = F.md5(F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("source", F.lit("")), text_of()).cast("binary"))
    keyed = columns_or_null(docs, doc_id="bigint", source="string", text="string").select(
        row_key.alias("_row"), "doc_id", "source", word_count().alias("size"), mix_key().alias("_key"))
    taken = settled(
        takes(settled(keyed, "mix-sizes"), weights, share, epochs)
        .groupBy("_row", "size").agg(F.max("taken").alias("taken")).where("taken > 0")
        .select(F.col("_row").alias("_mix_of"), F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken")),
        "mix-taken")
    size, total = F.col("_mix_size"), F.col("_mix_taken")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "mix_epoch", "mix_words")]
    joined = docs.drop("mix_epoch", "mix_words").withColumn("_mix_row", row_key).join(
        taken, F.col("_mix_row") == F.col("_mix_of"))
    rows = joined.withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(total / size).cast("bigint"))))
    rows = rows.withColumn("mix_words", F.least(size, total - (F.col("mix_epoch") - 1) * size))
    cut = F.array_join(F.slice(words_of(), 1, F.col("mix_words").cast("int")), " ")
    return rows.withColumn("text", F.when(F.col("mix_words") < size, cut).otherwise(F.col("text"))).select(
        *columns, "text", "mix_epoch", "mix_words")


ORACLE = f"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS k
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST(2 AS DOUBLE) * source_size AS lim,
  CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM t),
v AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
    - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
g AS (SELECT source, source_size, least(lim, weight * (SELECT arg_min(lvl, lim / weight) FROM v WHERE lvl <= lim / weight)) AS target FROM v),
r AS (SELECT s.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM r"""
