"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Every line of a file, every run of consecutive lines about as long as a template and the whole text are compared with notices and licence texts. Document frequencies are counted over
all files for the templates' words; a word of no template weighs like one that a single file has. A line or text can reach
the threshold only if it shares enough of a template's own weight; that necessary condition, checked for all of them, leaves few
to score in full. A licence with a version needs that version in the passage: numbers are frequent words, which weigh too little to tell versions apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Words, map_text, pick, written

THRESHOLD = 0.7
#: A text is a licence text if this share of its words is in passages that name one.
MOSTLY = 0.5
#: Names of licence files; what follows a dot, a dash or an underline is open.
LICENSE_FILE = r"(?i)(^|/)((un)?licen[cs]es?|copying|copyright|notice|[a-z0-9.+]+-licen[cs]e)([._-][^/]*)?$"
#: A passage in which one of the former words comes at most three words before one of the latter does not grant that licence.
NEGATIONS, GRANTS = "not never neither nor cannot isn aren wasn", "licensed released subject dedicated distributed covered available under"

# Notices and characteristic passages of licences, by SPDX identifier.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    # Notices of the GNU licences by version.
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
)
# How licence texts open.
TITLES: tuple[tuple[str, str], ...] = (
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
# Whole licence texts, or passages that only those have.
TEXTS: tuple[tuple[str, str], ...] = (
    ("Artistic-1.0-Perl", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

TEMPLATES = NOTICES + TITLES + TEXTS

#: The template that every identifier has besides, in files and headers: a tag with one or several of them.
_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)")
_NO_IDENTIFIERS = frozenset(("OR", "AND", "WITH", "NONE", "NOASSERTION"))

_NEWLINE = 10


def tagged(text: bytes) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of each licence that tags of the text name; those of GNU without -only or -or-later. What follows WITH is an exception, not a licence."""
    found = []
    for m in _TAG.finditer(text):
        before = b""
        for part in re.finditer(rb"[A-Za-z0-9.+-]+", m[1]):
            name = re.sub(r"(-only|-or-later|\+)$", "", part[0].decode())
            if name.upper() not in _NO_IDENTIFIERS and before.upper() != b"WITH" and re.search("[A-Za-z]", name):
                found.append((name, m.start(), m.end()))
            before = part[0]
    return found


#: Words that tell families of licences with like texts apart.
FAMILY = {"AGPL": "affero", "LGPL": "lesser", "GFDL": "documentation"}


def version(name: str) -> set[str]:
    """The numbers of an identifier's version, without a zero at its end: GPL-2.0 has 2, LGPL-2.1 has 2 and 1. BSD-3-Clause has none."""
    found = re.search(r"-(\d+(?:\.\d+)*)(?=$|-(?!Clause))", name)
    return set(re.sub(r"\.0$", "", found[1]).split(".")) if found else set()


class Templates:
    """The templates' words, hashed, and their counts."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.titles = [one in TITLES for one in templates]
        words = Words([t.encode() for _, t in templates])
        spelled = [[words.word(i).decode() for i in range(a, a + n)] for a, n in zip(words.first.tolist(), words.count.tolist())]
        self.vocabulary = np.unique(words.hash)
        at = np.searchsorted(self.vocabulary, words.hash)
        self.counts = np.zeros((len(templates), len(self.vocabulary)))
        np.add.at(self.counts, (words.owner, at), 1)
        #: Which words a passage must have: those of version and family that the template's text has, whose weight alone would not tell licences apart.
        self.required = np.zeros(self.counts.shape, bool)
        for j, name in enumerate(self.names):
            for i, w in enumerate(spelled[j]):
                self.required[j, at[words.first[j] + i]] |= w in version(name) | {FAMILY.get(name.split("-")[0])}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, -1 for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


class Model:
    """Templates weighted by the frequencies of their words over all files."""

    def __init__(self, templates: Templates, files: int, frequency: np.ndarray):
        self.templates = templates
        self.idf = np.log((1 + files) / (1 + frequency)) + 1
        self.other = math.log((1 + files) / 2) + 1
        self.weights = templates.counts * self.idf
        self.norms = np.sqrt((self.weights**2).sum(axis=1))
        #: The share of each template's squared weight that each of its words has.
        self.shares = (self.weights / self.norms[:, None]) ** 2
        #: Words of many files: what they can add to a run of lines is at most their whole share.
        common = frequency > files / 20 + 2
        self.common = self.shares[:, common].sum(axis=1)
        self.rare = np.where(common, 0, self.shares)

    def cosine(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Of one passage's words (vocabulary places, -1 for others, told apart by hash) to each template; 0 where it lacks the template's version."""
        own = Counter(words[words >= 0].tolist())
        others = np.unique(hashes[words < 0], return_counts=True)[1]
        at, n = np.array(list(own), np.int64), np.array(list(own.values()), np.float64)
        x = n * self.idf[at]
        size = math.sqrt(float((x**2).sum()) + float(((others * self.other) ** 2).sum()))
        if not size:
            return np.zeros(len(self.norms))
        there = np.zeros(self.weights.shape[1], bool)
        there[at] = True
        return np.where((self.templates.required & ~there).any(axis=1), 0.0, (self.weights[:, at] @ x) / (self.norms * size))


def _frequencies(templates: Templates):
    def work(texts):
        words = Words(texts)
        at = templates.numbers(words.hash)
        pair = np.unique(words.owner[at >= 0].astype(np.int64) * len(templates.vocabulary) + at[at >= 0])
        counts = np.bincount(pair % len(templates.vocabulary), minlength=len(templates.vocabulary))
        found = np.flatnonzero(counts).tolist()
        # One row of a slice tells its counts; the others are empty.
        return [pa.array([[{"word": w, "n": int(counts[w])} for w in found], *[[] for _ in texts[1:]]], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))]

    return work


def fit(files: DataFrame, key: str, text: str, templates=TEMPLATES) -> Model:
    """Count the templates' words over all files: partial sums of slices, then one row for each word."""
    made = Templates(templates)
    kind = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())]))
    counted = map_text(files, key, text, [T.StructField("counts", kind)], _frequencies(made))
    rows = counted.select(F.explode("counts").alias("c")).groupBy("c.word").agg(F.sum("c.n").alias("n")).collect()  # at most the templates' words
    frequency = np.zeros(len(made.vocabulary))
    for r in rows:
        frequency[r[0]] = r[1]
    return Model(made, files.count(), frequency)


def _line_runs(model: Model, words: Words, at: np.ndarray, line: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(first word, end) of runs of two or more lines, from any line to the line ends next below and above each template's length, that can reach the threshold."""
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    edges = np.append(starts, len(line))
    ends = (words.first + words.count)[words.owner[starts]]
    known = np.flatnonzero(at >= 0)
    # Before which of the known words each line begins.
    place = np.searchsorted(known, edges)
    found = []
    for j, n in enumerate(model.templates.counts.sum(axis=1).astype(np.int64).tolist()):
        sums = np.concatenate([[0.0], np.cumsum(model.rare[j, at[known]])])
        after = np.searchsorted(edges, np.minimum(starts + n, ends))
        for stop in (after, after - (edges[after] > starts + n)):
            reach = sums[place[stop]] - sums[place[:-1]] + model.common[j]
            able = np.flatnonzero((stop - np.arange(len(starts)) > 1) & (reach >= threshold**2 - 1e-6))
            found.append(np.stack([starts[able], edges[stop[able]]], axis=1))
    return [(a, b) for a, b in np.unique(np.concatenate(found), axis=0).tolist()]


def _negated(words: Words) -> np.ndarray:
    """Places of the words before which, at most three words away and in the same text, a negation stands."""
    of = lambda some: Words([some.encode()]).hash
    grants, negations = np.flatnonzero(np.isin(words.hash, of(GRANTS))), np.flatnonzero(np.isin(words.hash, of(NEGATIONS)))
    if not len(negations):
        return negations
    at = np.searchsorted(negations, grants) - 1
    last = negations[np.maximum(at, 0)]
    return grants[(at >= 0) & (grants - last <= 4) & (words.owner[grants] == words.owner[last])]


#: What a passage is.
PASSAGE, TITLE, TAG = range(3)
Passage = tuple[float, str, int, int, int]


def _apart(passages: list[Passage]) -> list[Passage]:
    """The passages (-cosine, name, first word, end, what it is), best first, that overlap no better one of another licence; a tag may name several."""
    names: dict[int, str] = {}  # by word
    tags = [p for p in passages if p[4] == TAG]
    out = list(dict.fromkeys(tags))
    for _, _, a, b, _ in tags:
        names.update(dict.fromkeys(range(a, b), ""))
    for one in sorted(p for p in passages if p[4] != TAG):
        _, name, a, b, _ = one
        if all(names.get(w, name) == name for w in range(a, b)):
            names.update(dict.fromkeys(range(a, b), name))
            out.append(one)
    return sorted(out)


def _scan(model: Model, threshold: float):
    def work(texts):
        t = model.templates
        words = Words(texts)
        at = t.numbers(words.hash)
        raw = np.frombuffer(words.joined, np.uint8)
        # The line of each word, over all texts; texts are apart by the zero between them.
        breaks = np.flatnonzero((raw == _NEWLINE) | (raw == 0))
        line = np.searchsorted(breaks, words.start)
        passages: list[list[Passage]] = [[] for _ in texts]
        begin = np.cumsum([0, *(len(x or b"") + 1 for x in texts)]).tolist()
        for k, text in enumerate(texts):
            if text and b"SPDX-License-Identifier:" in text:
                for name, a, b in tagged(text):
                    span = np.searchsorted(words.start, [begin[k] + a, begin[k] + b]).tolist()
                    passages[k].append((-1.0, name, *span, TAG))
        known = np.flatnonzero(at >= 0)
        if len(known):
            # Distinct (line, word) pairs carry what a line can share with each template.
            pair = np.unique(line[known].astype(np.int64) * len(t.vocabulary) + at[known])
            lines, cut = np.unique(pair // len(t.vocabulary), return_index=True)
            reach = np.add.reduceat(model.shares.T[pair % len(t.vocabulary)], cut, axis=0)
            able = lines[(reach >= threshold**2 - 1e-9).any(axis=1)]
            todo = list(zip(np.searchsorted(line, able, side="left").tolist(), np.searchsorted(line, able, side="right").tolist()))
            pair = np.unique(words.owner[known].astype(np.int64) * len(t.vocabulary) + at[known])
            owners, cut = np.unique(pair // len(t.vocabulary), return_index=True)
            reach = np.add.reduceat(model.shares.T[pair % len(t.vocabulary)], cut, axis=0)
            todo += [(int(words.first[k]), int(words.first[k] + words.count[k])) for k in owners[(reach >= threshold**2 - 1e-9).any(axis=1)]]
            todo += _line_runs(model, words, at, line, threshold)
            negated = _negated(words)
            for a, b in todo:
                if np.searchsorted(negated, b) > np.searchsorted(negated, a):
                    continue
                cosine = np.round(model.cosine(at[a:b], words.hash[a:b]), 9)
                j = min(range(len(cosine)), key=lambda i: (-cosine[i], t.names[i]))
                if cosine[j] >= threshold:
                    passages[int(words.owner[a])].append((-float(cosine[j]), t.names[j], a, b, TITLE if t.titles[j] else PASSAGE))
        kept = [_apart(p) for p in passages]
        names = [list(dict.fromkeys(n for _, n, *_ in p)) for p in kept]
        whole = []
        for k, p in enumerate(kept):
            covered, upto = 0, 0
            for a, b in sorted((a, b) for _, _, a, b, _ in p):
                covered += max(0, b - max(a, upto))
                upto = max(upto, b)
            whole.append(bool(p) and (covered >= MOSTLY * int(words.count[k]) or any(what == TITLE and a == int(words.first[k]) for _, _, a, _, what in p)))
        return [
            pa.array([n or None for n in names], pa.list_(pa.string())),
            pa.array([-p[0][0] if p else 0.0 for p in kept], pa.float64()),
            pa.array(whole, pa.bool_()),
        ]

    return work


FIELDS = [T.StructField("own", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType()), T.StructField("whole", T.BooleanType())]


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"(^|/)[^/]*$", "")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD, license_file: Column | None = None) -> DataFrame:
    """(key, path, license, score, kind, from_dir, licenses) for each file.

    kind: `own` where a line, a run of lines or the whole text reaches the threshold, has the version that the licence names and does not deny it, or
    where an SPDX tag names a licence (license: the template of the highest cosine, the first name among equals; licenses: all that are named by
    passages apart from each other, the best first);
    else `inherited` from the licence file of the nearest directory at or above the file's; else `none`, score 0. `license_file` says which files
    are licence files. The default is those with a licence that have a name like LICENSE, COPYING or NOTICE, or whose text is mostly licence or opens with a
    licence's title; a header over code is none. Of several in a directory the highest score counts, then
    the first licence name. Null texts have no words; null paths are in the root. Repeated rows stay.
    """
    model = fit(files, key, text)
    named = pick(files, key=key, path=path, text=text)
    # The path rides along in the key, so that texts pass Python once and are never shuffled.
    packed = named.select(F.struct("key", "path").alias("_file"), "text")
    found = map_text(packed, "_file", "text", FIELDS, _scan(model, threshold)).select("_file.key", "_file.path", "own", "score", "whole")
    read, _ = written(found.withColumn("dir", parent(F.col("path"))), "licenses")
    by_default = F.col("whole") | F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    of_dir = read.filter(F.col("own").isNotNull() & (by_default if license_file is None else license_file)).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own")[0].alias("license"), F.col("own").alias("licenses"))).alias("l"))
    declared, _ = written(of_dir.select(F.col("dir").alias("from_dir"), "l.license", (-F.col("l.s")).alias("from_score"), "l.licenses"), "license-dirs")
    # Directories, not files, look up their ancestors; the nearest is the longest that has a licence. The root, above all of them, is one row and no key.
    root = declared.filter("from_dir = ''").first()
    above_all = F.struct(*[F.lit(root[n] if root else None).cast(t).alias(n) for n, t in (("from_dir", "string"), ("license", "string"), ("from_score", "double"))], F.lit(root["licenses"] if root else None).cast("array<string>").alias("licenses"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = read.select("dir").distinct().withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n))))).filter("up <> ''")
    nearest = above.join(declared, F.col("up") == F.col("from_dir")).groupBy("dir").agg(F.max_by(F.struct("from_dir", "license", "from_score", "licenses"), F.length("from_dir")).alias("near"))
    near, _ = written(nearest, "nearest")
    out = read.join(near, "dir", "left").withColumn("near", F.coalesce("near", F.when(F.lit(root is not None), above_all)))
    own, inherited = F.col("own").isNotNull(), F.col("near").isNotNull()
    return out.select(
        F.col("key").alias(key), "path",
        F.when(own, F.col("own")[0]).otherwise(F.col("near.license")).alias("license"),
        F.when(own, F.col("score")).when(inherited, F.col("near.from_score")).otherwise(0.0).alias("score"),
        F.when(own, "own").when(inherited, "inherited").otherwise("none").alias("kind"),
        F.when(~own, F.col("near.from_dir")).alias("from_dir"),
        F.coalesce("own", "near.licenses", F.array().cast("array<string>")).alias("licenses"),
    )
