"""License scan: TF-IDF cosine to templates, then nearest-ancestor inheritance.

Passages of lower-cased words are every line of a file, every block of consecutive
lines with words (a comment and the code after it are two), and the whole text of a
file named like a licence. A passage's cosine to a template is taken over
sparse TF-IDF vectors; idf = ln((1 + N) / (1 + df)) + 1 over all N lines of the
corpus, with df counted for every word. A licence has several templates: notices,
SPDX lines, headers and the full text. A file has the licence of the template with
the greatest cosine of at least ``COSINE``, from passages that share ``LEAST_TERMS``
different words with it. A directory
has the licence of its licence files (greatest cosine first), and a file without
a licence of its own gets that of its nearest ancestor directory, joined on the
directory's path. Ties go to the smaller template name.

NULL paths and texts are empty: such a file may have a licence of its own but
inherits none. Repeated files are one file if path and text are equal. Empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import columns_or_null, plain_words_of, text_of
from boardlens.session import settled

COSINE = 0.6
LEAST_TERMS = 2
NAMES = r"(?i)(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"

#: A line that begins like a comment.
_MARK = r"[ \t]*(?:#|//|/\*|\*|;|--|%|<!--|\"\"\")"

# Common licence notices, headers and full texts.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License"),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:"""),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", """Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."""),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.
        To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"""),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("cc-by-nc-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version."""),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
)


def _full_texts() -> list[tuple[str, str]]:
    """The full texts beside this file, and MIT's permission paragraph by itself."""
    texts = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return texts + [("mit", p) for name, t in texts if name == "mit" for p in t.split("\n\n") if p.startswith("Permission")]


TEMPLATES = (*NOTICES, *_full_texts())


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def passages(files: DataFrame) -> DataFrame:
    """file, no, line (whether it is one) and words for each line, block of lines, and whole licence file."""
    apart = F.regexp_replace("text", rf"(?m)(^{_MARK}[^\n]*\n)(?!{_MARK})", "$1\n")
    blocks = F.filter(F.split(apart, r"\n[^\p{L}\p{N}\n]*(?:\n[^\p{L}\p{N}\n]*)*(?=\n)"), lambda x: F.contains(F.trim(x), F.lit("\n")))
    part = lambda line: lambda x: F.struct(F.lit(line).alias("line"), x.alias("part"))
    parts = F.concat(
        F.transform(F.split("text", "\n"), part(True)), F.transform(blocks, part(False)),
        F.when(F.col("is_license") & F.contains("text", F.lit("\n")), F.transform(F.array("text"), part(False)))
        .otherwise(F.array().cast("array<struct<line:boolean,part:string>>")))
    split = files.select("file", parts.alias("parts")).select("file", F.posexplode("parts").alias("no", "p"))
    return split.select("file", "no", "p.line", plain_words_of(F.col("p.part")).alias("words"))


def anchors(templates, idf: dict[str, float], cosine: float) -> set[str]:
    """Words of which a passage must hold one to reach the cosine with any template.

    The other words of each template, its most common ones, have together less than
    the cosine's share of its length, so that they alone cannot reach it.
    """
    out = set()
    for _, text in templates:
        counts = Counter(_terms(text))
        square = {t: (n * idf[t]) ** 2 for t, n in counts.items()}
        left = cosine * cosine * sum(square.values()) * (1 - 1e-5)
        for t in sorted(counts, key=lambda t: (idf[t], t)):
            left -= square[t]
            if left <= 0:
                out.add(t)
    return out


def own_licenses(files: DataFrame, templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """file, license, cosine of files with a licence of their own."""
    session = files.sparkSession
    vocabulary = sorted({t for _, text in templates for t in _terms(text)})
    rows = passages(files)
    dfs = settled(
        rows.where("line").select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term")
        .agg(F.count(F.lit(1)).alias("df")), "line-counts")
    n_lines = files.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0
    df_counts = {r.term: r.df for r in dfs.join(F.broadcast(session.createDataFrame([(t,) for t in vocabulary], "term string")), "term").collect()}
    idf = {t: math.log((1 + n_lines) / (1 + df_counts.get(t, 0))) + 1 for t in vocabulary}
    weights = []
    for i, (name, text) in enumerate(templates):
        counts = Counter(_terms(text))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        weights += [(i, name, t, n * idf[t] / norm) for t, n in counts.items()]
    # One row per template and term of the fixed list: broadcast.
    table = F.broadcast(session.createDataFrame(weights, "template int, license string, term string, weight double"))
    needed = F.array(*[F.lit(t) for t in sorted(anchors(templates, idf, cosine))])
    tf = settled(
        rows.where(F.arrays_overlap("words", needed)).select("file", "no", F.explode("words").alias("term"))
        .groupBy("file", "no", "term").agg(F.count(F.lit(1)).alias("tf")), "licence-terms")
    weighted = settled(tf.join(dfs, "term", "left").select(
        "file", "no", "term",
        (F.col("tf") * (F.log(F.lit(1.0 + n_lines) / (1 + F.coalesce("df", F.lit(0)))) + 1)).alias("w")), "licence-weights")
    length = weighted.groupBy("file", "no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighted.join(table, "term").groupBy("file", "no", "template", "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= LEAST_TERMS)
    scored = dots.join(length, ["file", "no"]).select(
        "file", "license", F.round(F.col("dot") / F.col("length"), 6).alias("cosine")).where(F.col("cosine") >= cosine)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    return best.select("file", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"))


def scan_rows(files: DataFrame, templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """Every row of ``files`` (all columns, repeated rows too) with what ``scan`` finds for its path and text."""
    files = files.select("*", F.coalesce(F.col("path"), F.lit("")).alias("_path"), text_of().alias("_text"))
    found = scan(files.select(F.col("_path").alias("path"), F.col("_text").alias("text")), templates, cosine, keyed=True)
    names = ("license", "cosine", "inherited_from")
    kept = [c for c in files.columns if c not in ("_path", "_text", *names)]
    return files.withColumn("_file", _file_key("_path", "_text")).select("_file", *kept).join(
        found.select(F.col("file").alias("_file"), *names), "_file").select(*kept, *names)


def _file_key(path: str, text: str):
    return F.md5(F.concat(F.length(path).cast("string"), F.lit(":"), F.col(path), F.col(text)).cast("binary"))


def scan(files: DataFrame, templates=TEMPLATES, cosine: float = COSINE, keyed: bool = False) -> DataFrame:
    """path, license, cosine, inherited_from (directory, NULL if its own) for every distinct file.

    With ``keyed`` the file's key (a digest of path and text) comes along. NULL paths
    and texts are empty; long texts are read whole, line by line and block by block.
    """
    files = columns_or_null(files, path="string", text="string").select(
        F.coalesce("path", F.lit("")).alias("path"), text_of().alias("text"))
    rows = files.select(
        _file_key("path", "text").alias("file"), "path", "text", F.col("path").rlike(NAMES).alias("is_license"))
    own = settled(own_licenses(rows, templates, cosine), "own-licenses")
    named = settled(rows.select("file", "path", "is_license").distinct().join(own, "file", "left"), "licensed-files")
    parts = F.split("path", "/")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    directories = (
        named.where("is_license AND license IS NOT NULL").select(parent.alias("dir"), "license", "cosine")
        .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("d")))
    bare = named.where("license IS NULL").select("file", parts.alias("parts"))
    ancestors = bare.where(F.size("parts") > 1).select(
        "file", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("parts") - 1),
            lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("parts", 1, n), "/").alias("dir")))).alias("a"))
    nearest = (
        ancestors.select("file", "a.depth", "a.dir").join(directories, "dir").groupBy("file")
        .agg(F.max_by(F.struct("dir", "d"), "depth").alias("n")))
    return named.join(nearest, "file", "left").select(
        *(["file"] if keyed else []), "path", F.coalesce("license", F.col("n.d.license")).alias("license"),
        F.coalesce("cosine", -F.col("n.d.less")).alias("cosine"),
        F.when(F.col("license").isNull(), F.col("n.dir")).alias("inherited_from"))
