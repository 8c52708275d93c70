"""The licence scan on real headers and licence texts, and against plain cosines."""

import math
import re
from collections import Counter
from pathlib import Path

import pytest

from boardlens.llm import licenses

FULL = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
HEADERS = {
    "apache-2.0": '''#!/usr/bin/env python
# Copyright 2019 Somebody Else
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
import os''',
    "gpl-3.0": '''/* tool.c
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main(void)''',
    "mpl-2.0": '''// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
let a = 1;''',
}
SPDX = {"mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-3.0": "GPL-3.0-only", "mpl-2.0": "MPL-2.0", "bsd-3-clause": "BSD-3-Clause", "cc-by-nc-4.0": "CC-BY-NC-4.0"}


@pytest.fixture(scope="module")
def prose(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    return [(f"d/{r.doc_id}.txt", r.text or "") for r in rows]


def test_real_headers_and_license_texts(spark, prose):
    own = {f"f/{k}": (k, "Some Project\n\n" + t.replace("<year> <copyright holders>", "2020 Some One")) for k, t in FULL.items()}
    own |= {f"h/{k}": (k, t) for k, t in HEADERS.items()} | {f"s/{k}": (k, f"// SPDX-License-Identifier: {t}\nint a;") for k, t in SPDX.items()}
    files = spark.createDataFrame([(p, t) for p, (_, t) in own.items()] + [("LICENSE", FULL["mit"])] + prose, "path string, text string")
    got = {r.path: r.license for r in licenses.scan(files).where("inherited_from IS NULL").collect()}
    assert {p: got[p] for p in own} == {p: k for p, (k, _) in own.items()}


def test_cosines_of_lines_and_whole_files(spark, prose):
    files = prose + [("x/LICENSE", FULL["mit"]), *((f"h/{k}", t.split("\n")[3] + " and some other words") for k, t in HEADERS.items())]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    lines = [line for _, t in files for line in t.split("\n")]
    df = Counter(w for line in lines for w in set(words(line)))
    vector = lambda t: {w: n * (math.log((1 + len(lines)) / (1 + df[w])) + 1) for w, n in Counter(words(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(k, v, size(v)) for k, t in licenses.TEMPLATES for v in [vector(t)]]
    want = {}
    for path, text in files:
        best = []
        # The best of blocks is covered by the headers above: here lines and whole licence files.
        for passage in text.split("\n") + [text] * path.endswith("LICENSE"):
            v = vector(passage)
            for k, t, length in templates:
                if len(v.keys() & t.keys()) >= licenses.LEAST_TERMS:
                    best.append((-round(sum(x * t.get(w, 0) for w, x in v.items()) / size(v) / length, 6), k))
        least = min(best, default=(0, None))
        want[path] = (least[1], -least[0]) if -least[0] >= licenses.COSINE else None
    got = {r.path: (r.license, r.cosine) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).where("inherited_from IS NULL").collect()}
    assert sum(w is not None for w in want.values()) >= 3
    for path, w in want.items():
        if w:
            assert got[path][0] == w[0] and abs(got[path][1] - w[1]) < 2e-6
        else:
            assert got[path][0] is None


def test_rows_keep_their_ids(spark, tmp_path):
    """NULL, negative and repeated ids, and sources that end in digits, come back as they are."""
    from boardlens.llm import queries

    text = "Licensed under the Apache License, Version 2.0."
    rows = [(None, text, "web"), (None, "plain", "src3"), (-5, text, "src3"), (7, "x", None), (7, "x", None), (8, None, "a"), (25, text, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op4_license_scan"](spark, f"file://{tmp_path}").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.doc_id for r in got if r.license == "apache-2.0" and r.inherited_from is None} == {None, -5, 25}
