"""Personal data: patterns, and terms that give a protected entity away.

E-mail and IP addresses, card and phone numbers are found by pattern; each
distinct value is a protected entity. A term (a word, A-Z lower-cased, without
ASCII punctuation) reveals an entity as far as their pointwise mutual information
over the corpus's lines, log(N n(e,t) / (n(e) n(t))), comes near the entity's
own information log(N / n(e)). Their ratio is the disclosure: 1 means that the
term occurs with the entity only. Terms of ``REMOVE`` or more are removed, those
of ``GENERALISE`` or more replaced by a general word, in the lines that hold the
entity. All terms of an entity's lines are judged. Of a pair that shares a single
different line the disclosure is weighted by 1 - n(t) / N, the share of lines in which
the term is not met by chance anyway, before it is compared with ``GENERALISE``.

Counts run over all lines of all texts. NULL text is empty; a text without an
entity gets no span; rows equal in doc_id and text are judged alike; extra
columns pass through ``sanitised`` and are ignored elsewhere; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, text_of
from boardlens.llm.tokens import pieces
from boardlens.session import settled

GENERALISE, REMOVE = 0.9, 1.0
#: Terms whose lines are counted in one broadcast array; beyond that all terms are counted and joined.
BROADCAST_TERMS = 500_000
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A-Z to lower case, ASCII punctuation and control characters (but the line feed) to a blank.
TERM = np.arange(256, dtype=np.uint8)
TERM[[i for i in range(128) if not chr(i).isalnum() and i != 10]] = 32
TERM[65:91] += 32


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: a run of name characters, ``@``, a domain; each run is looked at once."""
    free, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGIT.findall(m.group()))
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode(), digest_size=8).digest(), "big", signed=True)


_FOUND = ("doc binary, doc_id bigint, spans array<struct<start:int,kind:int,end:int>>, "
          "contexts array<struct<start:int,line:string,entities:array<bigint>>>")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    contexts_type = pa.list_(pa.struct([("start", pa.int32()), ("line", pa.string()), ("entities", pa.list_(pa.int64()))]))
    for batch in batches:
        all_spans, all_contexts = [], []
        for value in batch.column("text"):
            text = value.as_py()
            spans = base_spans(text)
            lines: dict[int, set[int]] = {}
            for start, _, end in spans:
                lines.setdefault(text.rfind("\n", 0, start) + 1, set()).add(_entity(text[start:end]))
            contexts = []
            for start, entities in lines.items():
                end = text.find("\n", start)
                contexts.append({"start": start, "line": text[start:len(text) if end < 0 else end], "entities": sorted(entities)})
            all_spans.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            all_contexts.append(contexts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("doc_id"), pa.array(all_spans, spans_type), pa.array(all_contexts, contexts_type)],
            ["doc", "doc_id", "spans", "contexts"])


def _line_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each line, outside the entities themselves."""
    for batch in batches:
        for a, b, words in pieces(batch.column("line"), table=TERM):
            term = words.hashes()
            pair = np.unique(np.stack((words.doc.astype(np.uint64), term)), axis=1) if len(term) else np.zeros((2, 0), np.uint64)
            offsets = np.searchsorted(pair[0], np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("entity").slice(a, b - a), batch.column("unit").slice(a, b - a),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pair[1].view(np.int64)))],
                ["entity", "unit", "terms"])


def _lines_with(terms: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of lines that hold each of the terms (all terms if None); NULL stands for all lines with a word."""
    for batch in batches:
        for _, _, words in pieces(batch.column("text"), 8_000_000, TERM):
            if not len(words):
                continue
            feeds = np.concatenate(([0], np.cumsum(words.data == 10)))
            line = feeds[words.start] + words.doc
            lines = 1 + int(np.count_nonzero(line[1:] != line[:-1]))
            term = words.hashes()
            if terms is not None:
                at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
                keep = terms[at] == term if len(terms) else np.zeros(len(term), bool)
                line, term = line[keep], term[keep]
            order = np.lexsort((line, term))
            line, term = line[order], term[order]
            new = np.concatenate(([True], (line[1:] != line[:-1]) | (term[1:] != term[:-1]))) if len(term) else np.zeros(0, bool)
            value, count = np.unique(term[new], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *value.view(np.int64).tolist()], pa.int64()), pa.array([lines, *count.tolist()], pa.int64())],
                ["term", "n"])


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, action for the terms that reveal an entity."""
    contexts = found.select("doc", F.explode("contexts").alias("c")).select(
        "doc", "c.line", F.xxhash64("c.line").alias("unit"), F.explode("c.entities").alias("entity"))
    met = settled(
        contexts.select("entity", "unit", "line").mapInArrow(
            _line_terms, "entity bigint, unit bigint, terms array<bigint>")
        .select("entity", "unit", F.explode("terms").alias("term"))
        .groupBy("entity", "term", "unit").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("units")), "met-terms")
    n_e = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    wanted = met.select("term").distinct()
    terms = None
    if wanted.count() <= BROADCAST_TERMS:
        terms = np.sort(wanted.toPandas()["term"].to_numpy().astype(np.int64).view(np.uint64))
    lines = settled(
        columns_or_null(docs, text="string").select(text_of().alias("text"))
        .mapInArrow(functools.partial(_lines_with, terms), "term bigint, n bigint")
        .groupBy("term").agg(F.sum("n").alias("n_t")), "term-lines")
    total = lines.where("term IS NULL").agg(F.coalesce(F.max("n_t"), F.lit(0))).first()[0]
    ratio = F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    sure = F.when(F.col("units") > 1, 1.0).otherwise(1 - F.col("n_t") / F.lit(float(total)))
    action = F.when(F.col("ratio") * sure >= GENERALISE, F.when(F.col("ratio") >= REMOVE - 1e-12, ADDED[1]).otherwise(ADDED[0]))
    return (
        met.join(n_e, "entity").join(lines.where("term IS NOT NULL"), "term").where(F.col("n_e") < total)
        .withColumn("ratio", ratio).select("entity", "term", action.alias("action")).where("action IS NOT NULL"))


def _term_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the terms stand in their line, in code points of the text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for a, b, words in pieces(batch.column("line"), table=TERM):
            term = words.hashes().view(np.int64)
            acts = batch.column("acts").slice(a, b - a).to_pylist()
            starts, docs = batch.column("start").slice(a, b - a).to_pylist(), batch.column("doc").slice(a, b - a).to_pylist()
            begins = np.cumsum(np.concatenate(([0], (words.data & 0xC0) != 0x80)))
            for i in range(b - a):
                action = {}
                for act in acts[i]:
                    action[act["term"]] = max(action.get(act["term"], ""), act["action"])
                for w in range(words.first[i], words.first[i + 1]):
                    if int(term[w]) in action:
                        zero = begins[words.offsets[i]]
                        for column, value in zip(out, (
                            docs[i], action[int(term[w])], int(starts[i] + begins[words.start[w]] - zero),
                            int(starts[i] + begins[words.end[w]] - zero)), strict=True):
                            column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
            ["doc", "action", "start", "end"])


def document_key():
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_of()).cast("binary")))


def spans(docs: DataFrame) -> DataFrame:
    """doc (key), doc_id, spans (start, kind, end) and added (start, action, end) per row."""
    texts = columns_or_null(docs, doc_id="bigint", text="string").select(
        document_key().alias("doc"), "doc_id", text_of().alias("text"))
    found = settled(texts.mapInArrow(_found, _FOUND), "private-spans")
    reveal = disclosing_terms(docs, found)
    contexts = found.dropDuplicates(["doc"]).select("doc", F.explode("contexts").alias("c")).select(
        "doc", "c.start", "c.line", F.explode("c.entities").alias("entity"))
    revealing = (
        contexts.join(reveal, "entity").groupBy("doc", "start")
        .agg(F.first("line").alias("line"), F.collect_set(F.struct("term", "action")).alias("acts"))
        .mapInArrow(_term_spans, "doc binary, action string, start int, end int"))
    own = found.dropDuplicates(["doc"]).select(F.col("doc").alias("_doc"), "spans")
    apart = revealing.join(own, revealing["doc"] == own["_doc"]).where(
        ~F.exists("spans", lambda s: (s.start < F.col("end")) & (s.end > F.col("start"))))
    added = apart.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "action", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,action:string,end:int>>")
    return found.join(added, "doc", "left").select("doc", "doc_id", "spans", F.coalesce("added", none).alias("added"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and all spans as text."""
    df = spans(docs)
    name = F.array(*[F.lit(k) for k in KINDS])
    written = lambda kind, s: F.concat_ws(":", kind, s.start.cast("string"), s.end.cast("string"))
    base = F.transform("spans", lambda s: written(F.get(name, s.kind), s))
    listed = F.transform("spans", lambda s: F.struct(s.start, s.kind, written(F.get(name, s.kind), s).alias("t")))
    more = F.transform("added", lambda s: F.struct(
        s.start, (F.lit(len(KINDS)) + (s.action == ADDED[1]).cast("int")).alias("kind"), written(s.action, s).alias("t")))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("bigint")
    return df.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.array_sort(F.concat(listed, more)).t, ",").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with entities and revealing terms replaced or removed in ``text``, all columns."""
    marks = settled(
        spans(docs).where((F.size("spans") > 0) | (F.size("added") > 0)).dropDuplicates(["doc"])
        .select(F.col("doc").alias("_of_document"), F.col("spans").alias("_spans"), F.col("added").alias("_added")), "private-marks")
    joined = docs.withColumn("_document", document_key()).join(marks, F.col("_document") == F.col("_of_document"), "left")
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cuts = F.array_sort(F.concat(
        F.transform("_spans", lambda s: F.struct(s.start, s.end, F.get(name, s.kind).alias("by"))),
        F.transform("_added", lambda s: F.struct(s.start, s.end, F.when(s.action == ADDED[0], "[TERM]").otherwise("").alias("by")))))
    piece = F.aggregate(
        cuts, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, c: F.when(c.start < acc.at, acc).otherwise(F.struct(
            F.concat(acc.done, F.substring(F.col("text"), acc.at + 1, c.start - acc.at), c.by).alias("done"), c.end.alias("at"))),
        lambda acc: F.concat(acc.done, F.substring(F.col("text"), acc.at + 1, F.length("text") - acc.at)))
    return joined.withColumn("text", F.when(F.col("_of_document").isNull(), F.col("text")).otherwise(piece)).select(*docs.columns)
