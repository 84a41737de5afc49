from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import pytest

from lexloom.llm import licenses as lic

LICENCE_FILES = sorted(p for p in Path("/usr/share/common-licenses").glob("*") if not p.is_symlink())

ALNUM = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall((text or "").lower())


def brute(files):
    """Own licence and score of each text, by plain dictionaries."""
    templates = [(n, Counter(words(t))) for n, t in lic.TEMPLATES]
    vocabulary = {w for _, c in templates for w in c}
    df = Counter(w for t in files for w in set(words(t)) & vocabulary)
    n = len(files)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1 if w in vocabulary else math.log((1 + n) / 2) + 1
    norm = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
    out = []
    for t in files:
        best = (0.0, None)
        for passage in [*(t or "").split("\n"), t]:
            c = Counter(words(passage))
            for name, m in templates:
                if c and all(c[v] for v in lic.version(name) | {lic.FAMILY.get(name.split("-")[0])} if v in m):
                    s = round(sum(c[w] * m[w] * idf(w) ** 2 for w in m) / (norm(c) * norm(m)), 9)
                    if s >= lic.THRESHOLD and (-s, name) < (-best[0], best[1] or "~"):
                        best = (s, name)
        out.append((best[1], best[0]))
    return out


ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.py", "# code\nnothing here"),
    (3, "a/b/c/y.py", "first\nLicensed under the Apache License, Version 2.0 (the License);\nmore"),
    (4, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3.\ntext"),
    (5, "a/b/c/d/z.py", "words"),
    (6, "top.py", "Permission is hereby granted"),
    (7, None, None),
    (8, "a/empty", ""),
    (9, "ab/other.py", "the the the of License"),
    (10, "a/b/LICENSE2", "\n".join(t for _, t in lic.TEMPLATES[:2])),
    (None, "a/b/c/none", None),
    (2, "a/b/x.py", "# code\nnothing here"),
    (11, "a/long", "word " * 20000 + "\nLicensed under CC BY-NC 4.0.\n"),
]


def test_like_brute_force_and_inheritance(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame(ROWS, "doc_id long, path string, text string").select("*", F.lit(1).alias("Text"), F.lit(2).alias("kind"), F.lit(3).alias("dir")).repartition(3)
    rows = lic.scan(files).collect()
    assert len(rows) == len(ROWS)
    got = {(r["doc_id"], r["path"]): r for r in rows}
    for (k, p, _), (name, score) in zip(ROWS, brute([t for *_, t in ROWS])):
        r = got[(k, p)]
        assert (r["kind"] == "own") == (name is not None)
        if name:
            assert (r["license"], round(r["score"], 7)) == (name, round(score, 7))
    inherited = {k: (r["license"], r["from_dir"]) for k, r in got.items() if r["kind"] == "inherited"}
    near = got[(10, "a/b/LICENSE2")]["license"]
    assert inherited[(5, "a/b/c/d/z.py")] == ("GPL-3.0", "a/b/c") and inherited[(2, "a/b/x.py")] == (near, "a/b") and inherited[(8, "a/empty")] == ("MIT", "a")
    assert got[(6, "top.py")]["kind"] == got[(9, "ab/other.py")]["kind"] == got[(7, None)]["kind"] == "none"
    assert lic.scan(files.filter("false")).count() == 0
    above = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code"), (3, "/a/x.py", ""), (4, None, "")], "doc_id long, path string, text string")
    assert {r["doc_id"]: (r["license"], r["from_dir"]) for r in lic.scan(above).collect()} == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", "")}


def test_every_template_finds_itself(spark):
    files = spark.createDataFrame([(i, f"{i}/f", "x\n" + t) for i, (_, t) in enumerate(lic.TEMPLATES)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in lic.scan(files).collect()}
    assert all(got[i]["license"] == n and got[i]["score"] > 0.99 for i, (n, _) in enumerate(lic.TEMPLATES))


CODE = "\n".join(f"def function_{i}(value_{i}):\n    return table_{i}[value_{i}] + offset_{i}" for i in range(40))
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""


def test_wrapped_headers_and_whole_licence_files(spark):
    import textwrap

    whole = {n: max((t for m, t in lic.TEMPLATES if m == n), key=len) for n in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC")}
    texts = [*whole.items(), ("Apache-2.0", APACHE), ("GPL-3.0", GPL)]
    rows = []
    for name, t in texts:
        for width in (50, 76):
            wrapped = [line for part in t.split("\n") for line in textwrap.wrap(part, width)]
            rows.append((len(rows), name, f"{len(rows)}/x.py", "# Copyright 2020 The Authors\n#\n" + "\n".join(f"# {line}" for line in wrapped) + "\n\n" + CODE))
            rows.append((len(rows), name, f"{len(rows)}/LICENSE", "Copyright (c) 2020, The Authors\nAll rights reserved.\n\n" + "\n".join(wrapped) + "\n"))
    many = [(1000 + i, None, f"code/{i}.py", CODE.replace("table", f"t{i}") + "\nuse of the software and any copy or the terms") for i in range(400)]
    files = spark.createDataFrame([(i, p, t) for i, _, p, t in [*rows, *many]], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in lic.scan(files).collect()}
    assert {i: (got[i]["kind"], got[i]["license"]) for i, *_ in rows} == {i: ("own", n) for i, n, *_ in rows}
    assert {got[i]["kind"] for i, *_ in many} == {"none"}


def scanned(spark, rows):
    return {r["path"]: r for r in lic.scan(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")).collect()}


def test_headers_are_no_licence_files(spark):
    rows = [
        ("src/x.c", "// Released under the MIT License.\n" + CODE), ("src/y.c", CODE), ("src/sub/z.c", CODE),
        ("named/LICENSE", "Some words of ours before it.\n" * 40 + "Released under the MIT License.\n" + CODE), ("named/a.c", CODE),
        ("tagged/a.c", "// SPDX-License-Identifier: MIT\n" + CODE), ("tagged/b.c", CODE),
        ("mostly/about.txt", "\n".join(t for n, t in lic.TEMPLATES if n == "MIT")), ("mostly/a.c", CODE),
        ("titled/terms", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n" + "Other words of a long licence text follow here.\n" * 100), ("titled/a.c", CODE),
        ("deny/COPYING.txt", "This is not licensed under the GNU General Public License, version 3."), ("deny/a.c", CODE),
    ]
    got = scanned(spark, rows)
    assert {p: (got[p]["kind"], got[p]["license"]) for p in ("src/x.c", "src/y.c", "src/sub/z.c")} == {"src/x.c": ("own", "MIT"), "src/y.c": ("none", None), "src/sub/z.c": ("none", None)}
    assert [(got[p]["kind"], got[p]["license"]) for p in ("named/a.c", "tagged/a.c", "tagged/b.c", "mostly/a.c", "titled/a.c", "deny/a.c")] == [("inherited", "MIT"), ("own", "MIT"), ("none", None), ("inherited", "MIT"), ("inherited", "GPL-2.0"), ("none", None)]


def test_spdx_tags(spark):
    rows = [("a/x", "# SPDX-License-Identifier: MIT"), ("b/x", "/* SPDX-License-Identifier: Apache-2.0 */\n" + CODE), ("c/x", "// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR MIT\nint x;"), ("d/x", "SPDX-License-Identifier: NOASSERTION"), ("e/x", "SPDX-License-Identifier:"), ("f/x", "SPDX-License-Identifier: Zlib AND LGPL-2.1-only")]
    got = scanned(spark, rows)
    assert {p[0]: r["licenses"] for p, r in got.items()} == {"a": ["MIT"], "b": ["Apache-2.0"], "c": ["GPL-2.0", "MIT"], "d": [], "e": [], "f": ["LGPL-2.1", "Zlib"]}
    assert got["b/x"]["score"] == 1.0 and got["b/x"]["kind"] == "own"


def test_denied_and_several_licences(spark):
    rows = [
        ("no1/x", "This program is not licensed under the GNU General Public License, version 3."),
        ("no2/x", "It was never released under the MIT License."),
        ("yes/x", "Licensed under the Apache License, Version 2.0;\nyou may not use this file except in compliance with it."),
        ("two/x", "Released under the MIT License.\n" + CODE + "\nLicensed under the BSD 2-Clause License.\n" + CODE),
        ("mixed/x", "This part is not released under the MIT License.\n" + CODE + "\nLicensed under the BSD 2-Clause License."),
        ("bsd/x", max((t for n, t in lic.TEMPLATES if n == "BSD-3-Clause"), key=len)),
    ]
    got = scanned(spark, rows)
    assert {p.split("/")[0]: r["licenses"] for p, r in got.items()} == {"no1": [], "no2": [], "yes": ["Apache-2.0"], "two": ["BSD-2-Clause", "MIT"], "mixed": ["BSD-2-Clause"], "bsd": ["BSD-3-Clause"]}


def test_versions():
    assert [lic.version(n) for n in ("GPL-2.0", "LGPL-2.1", "BSD-3-Clause", "MIT", "CC0-1.0", "CC-BY-NC-4.0", "Artistic-1.0-Perl")] == [{"2"}, {"2", "1"}, set(), set(), {"1"}, {"4"}, {"1"}]


def test_versions_are_told_apart_and_ties_take_the_first_name(spark):
    rows = [
        (1, "a/x", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n" + CODE),
        (2, "b/x", "GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989\n\nCopyright (C) 1989\n" + CODE),
        (3, "c/x", "This work is licensed under the GNU General Public License, version 7."),
        (4, "d/x", "x\nReleased under the MIT License.\nLicensed under the BSD 2-Clause License.\n" + CODE),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in lic.scan(files).collect()}
    assert got == {1: "GPL-2.0", 2: "GPL-1.0", 3: None, 4: "BSD-2-Clause"}


@pytest.mark.skipif(not LICENCE_FILES, reason="no folder of licence texts here")
def test_whole_licence_texts_name_themselves(spark):
    own = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    there = [p for p in LICENCE_FILES if p.name in own]
    rows = [(i, f"{p.name}/LICENSE", p.read_text(errors="replace")) for i, p in enumerate(there)]
    for others in (0, 300):
        files = spark.createDataFrame(rows + [(1000 + i, f"code/{i}.py", CODE.replace("table", f"t{i}")) for i in range(others)], "doc_id long, path string, text string")
        got = {r["doc_id"]: r["license"] for r in lic.scan(files).collect()}
        assert {p.name: got[i] for i, p in enumerate(there)} == {p.name: own[p.name] for p in there}
