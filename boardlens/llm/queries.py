"""Named queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from boardlens.llm import conversations, decontam, fingerprints, jaccard, licenses, lines, lm, mixing, pii, quality, substrings, urls, whitening

QUERIES = {}
ORACLES = {}


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_mixing", mixing.ORACLE)
def op2_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op9_url_filters", urls.ORACLE)
def op9_url_filters(spark, sf):
    return urls.judge(table(spark, sf, "pages"))


@query("op8_quality_rules")
def op8_quality_rules(spark, sf):
    return quality.judge(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("score", 6).alias("score"))


@query("op1_decontamination")
def op1_decontamination(spark, sf):
    return decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf):
    return substrings.remove_repeats(table(spark, sf, "documents"), digest=True)


@query("op5_line_dedup")
def op5_line_dedup(spark, sf):
    return lines.decisions(table(spark, sf, "documents"))


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark, sf):
    return lm.score(table(spark, sf, "documents"))


@query("op10_private_terms")
def op10_private_terms(spark, sf):
    return pii.digest(table(spark, sf, "documents"))


@query("op4_license_scan")
def op4_license_scan(spark, sf):
    """Documents as files: source / thousands / hundreds / name; every 25th is its parent's licence file."""
    number = F.col("doc_id")
    path = F.when(number % 25 == 0, F.concat_ws(
        "/", "source", F.expr("doc_id div 1000").cast("string"), F.concat(F.lit("LICENSE-"), number.cast("string")))
    ).otherwise(F.concat_ws(
        "/", "source", F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100 % 10").cast("string"),
        F.concat(number.cast("string"), F.lit(".txt"))))
    files = table(spark, sf, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan_rows(files).select("doc_id", "path", "license", "cosine", "inherited_from")


@query("op11_document_fingerprints")
def op11_document_fingerprints(spark, sf):
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


@query("op12_whitening")
def op12_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op13_conversation_trie", conversations.ORACLE)
def op13_conversation_trie(spark, sf):
    return conversations.prefix_trie(table(spark, sf, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run
