"""Nulls, empty and long texts, ties, repeats, clashing column names and empty tables, for every operator."""

import pytest

import corpus_pipeline
from boardlens.llm import decontam, jaccard, licenses, lines, lm, mixing, pii, quality, substrings, urls

LONG = " ".join(f"w{i}" for i in range(60_000))
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards boil dark amber potions near the old stone bridge at night"
ROWS = [
    (1, SENTENCE, "en", "a", 10), (2, SENTENCE, "en", "b", 10), (2, SENTENCE, "en", "b", 10), (3, None, None, None, None),
    (None, "no id here\n\nno id here", "en", None, 1), (None, None, None, None, None), (4, "", "en", "a", 0),
    (5, " \t\n ", "en", "a", 0), (6, LONG, "en", "a", 1), (7, "mail me@x.org or 1.2.3.4", "en", "é", 1),
    (8, SENTENCE.replace("fox", "cat"), "en", "a", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["words", "hashes", "size", "label", "n", "kept", "key", "line", "term", "node", "removed", "content", "h", "pos", "epochs"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, DOCS)
    for i, name in enumerate(CLASH):
        df = df.withColumn(name, df["lang"] if i % 2 else df["doc_id"])
    return df


def labels(spark, rows=((1, 1, 0), (1, 1, 0), (6, 1, 0), (None, 1, None), (99, 1, 0), (7, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, SENTENCE), (None, "a b c"), (2, None), (3, ""), (1, SENTENCE))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "mixing": lambda s, d: mixing.mix(d),
    "mixed_documents": lambda s, d: mixing.mixed_documents(d),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "lines": lambda s, d: lines.decisions(d),
    "lines_text": lambda s, d: lines.deduplicated(d),
    "jaccard": lambda s, d: jaccard.near_duplicates(d),
    "jaccard_kept": lambda s, d: jaccard.one_of_each(d),
    "lm": lambda s, d: lm.score(d),
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "pii": lambda s, d: pii.digest(d),
    "pii_text": lambda s, d: pii.sanitised(d),
    "decontam": lambda s, d: decontam.leaks(d, benchmark(s)),
    "decontam_kept": lambda s, d: decontam.without_leaks(d, benchmark(s)),
    "licenses": lambda s, d: licenses.scan(d.withColumnRenamed("source", "path")),
    "urls": lambda s, d: urls.judge(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"})),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table_gives_an_empty_result(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    rows = OPERATORS[name](spark, documents(spark)).collect()
    if name not in ("decontam", "decontam_kept", "jaccard_kept", "mixed_documents", "licenses"):
        assert len(rows) == len(ROWS)


def test_line_dedup_keeps_one_of_each_line(spark):
    docs = spark.createDataFrame([(1, "Same line 12\nown words here"), (2, "same LINE, 34\nother own words"), (3, None), (4, "!!\n!!")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert got == {1: "Same line 12\nown words here", 2: "other own words", 3: None, 4: "!!\n!!"}


def test_near_duplicates_without_words_stand_alone(spark):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(documents(spark)).collect() if r.doc_id in (2, 3, 4, 5)}
    assert got == {(2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0)}


def test_leaks_name_item_and_span(spark):
    got = {(r.doc_id, r.item_id, r.matched, r.start, r.end) for r in decontam.leaks(documents(spark), benchmark(spark)).collect()}
    size = len(SENTENCE.split())
    assert {g[:2] for g in got} == {(1, 1), (2, 1), (8, 1)} and (1, 1, 20, 0, size) in got


def test_sanitised_text_hides_entities(spark):
    got = {r.doc_id: r.text for r in pii.sanitised(documents(spark)).collect()}
    assert got[7] == "mail [EMAIL] or [IP]" and got[3] is None and got[1] == SENTENCE


def test_license_is_inherited_from_the_nearest_directory(spark):
    files = spark.createDataFrame([
        ("p/LICENSE", "Released under the MIT License."), ("p/q/a.txt", "text"), ("p/q/r/COPYING", "Licensed under CC BY-NC 4.0."),
        ("p/q/r/b.txt", "text"), ("p/c.txt", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("z.txt", "text"), (None, None),
    ], "path string, text string")
    got = {r.path: (r.license, r.inherited_from) for r in licenses.scan(files).collect()}
    assert got == {
        "p/LICENSE": ("mit", None), "p/q/a.txt": ("mit", "p"), "p/q/r/COPYING": ("cc-by-nc-4.0", None),
        "p/q/r/b.txt": ("cc-by-nc-4.0", "p/q/r"), "p/c.txt": ("apache-2.0", None), "z.txt": (None, None), "": (None, None)}


def test_pipeline_stages_keep_the_columns_of_documents(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(ROWS, DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
