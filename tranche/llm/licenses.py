"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directories.

Headers are the lines of a text that speak of licences; a licence file is taken as a whole. Equal headers collapse before
anything is counted, so a notice in a third of all files is one vector. Document frequencies are those of all headers.
Besides, blocks of lines from each header on are scored with the document frequencies of the templates alone, so a wrapped
notice, or a licence file by its best block, is found however common it is. SPDX tags are read as they are.
A file without a licence of its own has that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import map_batches, written_once

#: How licences are named in headers, and how their texts begin. Few and short, so they may be broadcast.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved. Proprietary and confidential; unauthorized copying of this file is prohibited."),
]
#: Notices of several lines, paragraphs of licence texts and their titles. Blocks are compared with these too.
NOTICES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
]
#: Reserved rights stand above most open licences too: this one counts only where a file has no other.
WEAKEST = "proprietary"
#: The first licence that an SPDX tag names; those of a family without the suffix that tells of later versions.
SPDX = re.compile(r"(?i)spdx-license-identifier:[\s(]*([a-z0-9][a-z0-9.-]*)")
#: The holder and the years of a copyright notice, which no template can know.
HOLDER = re.compile(r"(?is)\bcopyright\b(?:\W+\w+){1,16}?\W+(?=all\s+rights\s+reserved)")
#: Lines of a block, at most: a notice wrapped more narrowly than that is found by its longest template paragraph.
BLOCK_LINES = 24
HEADER = r"(?i)licen[cs]|copyright|spdx|public domain|permission is hereby|redistribution and use|free software|all rights reserved"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
#: A header is a licence's if the cosine is at least this.
LEAST_COSINE = 0.6
#: A file is a licence file, whatever its name, if so much of it is words of licence headers.
LEAST_SHARE = 0.5


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(tokens: Column) -> Column:
    """Words, and pairs of words that follow each other."""
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def headers(files: DataFrame) -> DataFrame:
    """``(file, header, size)``: the normal words of each header of ``(file, name, text)``, of a licence file the whole text."""
    named = F.col("name").rlike(LICENCE_FILE)
    lines = F.when(named, F.array("text")).otherwise(F.filter(F.split("text", "\n"), lambda line: line.rlike(HEADER)))
    each = files.where(named | F.col("text").rlike(HEADER)).select("file", F.explode(lines).alias("line"))
    each = each.select("file", words("line").alias("words")).where(F.size("words") > 0)
    return each.select("file", F.array_join("words", " ").alias("header"), F.size("words").alias("size"))


class Blocks:
    """Best block of a text: cosines to ``templates`` with their own document frequencies. Remembers texts, up to a bound."""

    MOST_WORDS, MOST_TEXTS = 400, 1000
    WORD, LINE = re.compile(r"[a-z0-9]+"), re.compile(HEADER)

    def __init__(self, templates: list[tuple[str, str]], least_cosine: float = LEAST_COSINE):
        self.licences, self.least = [licence for licence, _ in templates], least_cosine
        self.official = {licence.lower(): licence for licence in self.licences}
        counts = [Counter(self.terms(self.WORD.findall(text.lower()))) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.idf = {t: log((len(counts) + 1) / (n + 1)) + 1 for t, n in df.items()}
        self.unknown = log(len(counts) + 1) + 1
        self.norms = [sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items())) for c in counts]
        self.holders: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(counts):
            for t, n in c.items():
                self.holders[t].append((k, n * self.idf[t] ** 2))
        self.known: dict[str, tuple[str, float, int] | None] = {}

    @staticmethod
    def terms(tokens: list[str], before: str | None = None) -> list[str]:
        return tokens + [f"{a} {b}" for a, b in zip([before, *tokens], tokens, strict=False) if a is not None]

    def best(self, text: str) -> tuple[str, float, int] | None:
        """``(licence, cosine, words in blocks that match)``; null without any."""
        if text not in self.known:
            if len(self.known) >= self.MOST_TEXTS:
                self.known.clear()
            self.known[text] = self.scored(text)
        return self.known[text]

    def tagged(self, name: str) -> str:
        plain = re.sub(r"-(only|or-later)$|\+$", "", name.lower().rstrip(".-"))
        return self.official.get(plain, name.rstrip(".-"))

    def scored(self, text: str) -> tuple[str, float, int] | None:
        full = HOLDER.sub("copyright ", text)
        lines = [(line, self.WORD.findall(line.lower())) for line in full.split("\n")]
        lines = [x for x in lines if x[1]]
        found: list[tuple[bool, float, str]] = []
        covered: set[int] = set()
        starts: set[int] = set()
        for n, (line, _) in enumerate(lines):
            if self.LINE.search(line):
                starts |= {max(0, n - 1), n}
                for name in SPDX.findall(line):
                    found.append((False, -1.0, self.tagged(name)))
                    covered.add(n)
                    break
        for first in sorted(starts):
            tf: Counter = Counter()
            dots = [0.0] * len(self.norms)
            square, size, before = 0.0, 0, None
            for last in range(first, min(first + BLOCK_LINES, len(lines))):
                tokens = lines[last][1]
                if size and size + len(tokens) > self.MOST_WORDS:
                    break
                size += len(tokens)
                for t in self.terms(tokens, before):
                    square += (2 * tf[t] + 1) * self.idf.get(t, self.unknown) ** 2
                    tf[t] += 1
                    for k, w in self.holders.get(t, ()):
                        dots[k] += w
                before = tokens[-1]
                top = max((round(d / norm / sqrt(square), 9), -k) for k, (d, norm) in enumerate(zip(dots, self.norms, strict=True)))
                if top[0] >= self.least:
                    licence = self.licences[-top[1]]
                    found.append((licence == WEAKEST, -top[0], licence))
                    covered.update(range(first, last + 1))
        if not found:
            return None
        _, far, licence = min(found)
        return licence, -far, sum(len(lines[n][1]) for n in covered)


def blocks(files: DataFrame, templates: list[tuple[str, str]], least_cosine: float) -> DataFrame:
    """``(file, licence, cosine, size)`` by the best block of ``(file, name, text)``, for files that have one. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Blocks(templates, least_cosine)
        for batch in batches:
            rows = [(f, *hit) for f, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (hit := scorer.best(t.as_py()))]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "licence", "cosine", "size"])

    some = files.where(F.col("text").rlike(HEADER)).select("file", "text")
    return map_batches(some, run, "file string, licence string, cosine double, size long")


def counted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)`` of normal texts."""
    split = F.split(text, " ")
    return texts.select(key, F.explode(terms(split)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def matched(found: DataFrame, templates: list[tuple[str, str]], least_cosine: float) -> DataFrame:
    """``(header, licence, cosine)``: the best template of each distinct header that has one; of equals the first by name."""
    spark = found.sparkSession
    distinct = written_once(found.groupBy("header").agg(F.count("*").alias("n")), "headers")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    tf = counted(distinct, "header", "header")
    df = tf.join(distinct.select("header", "n"), "header").groupBy("term").agg(F.sum("n").alias("df"))
    idf = (F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf")
    weights = tf.join(df, "term").select("header", "term", (F.col("tf") * idf).alias("w"))
    weights = written_once(weights, "header-weights")
    given = spark.createDataFrame([(n, licence, text) for n, (licence, text) in enumerate(templates)], "template int, licence string, text string")
    given = given.select("template", "licence", F.array_join(words("text"), " ").alias("text"))
    theirs = counted(given, "template", "text").join(df, "term", "left").select("template", "term", (F.col("tf") * idf).alias("v"))
    norms = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("template_norm"))
    own = weights.groupBy("header").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    # The templates are a fixed list of this module's size: a few hundred terms.
    dots = weights.join(F.broadcast(theirs), "term").groupBy("header", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(own, "header").join(F.broadcast(norms), "template").join(F.broadcast(given.select("template", "licence")), "template")
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 9)
    scored = scored.select("header", "licence", cosine.alias("cosine")).where(F.col("cosine") >= least_cosine)
    best = scored.groupBy("header").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("best"))
    return best.select("header", "best.licence", (-F.col("best.far")).alias("cosine"))


def scan(
    files: DataFrame,
    file_id: str = "file_id",
    path: str = "path",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    least_cosine: float = LEAST_COSINE,
    least_share: float = LEAST_SHARE,
    notices: list[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """``(file_id, path, licence, cosine, origin, directory)`` for every row of ``files``.

    ``origin`` is "header", "licence file" or "inherited", and null without a licence; ``directory`` is that of the licence
    file for the latter two. A file keeps its own licence over an inherited one. Of several headers the one with the
    largest cosine counts, reserved rights after all others, and of several licence files in a directory the same. Null texts have no headers; a file
    without a path inherits nothing; rows that agree in id, path and text get the same answer each.
    """
    rows = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    file = F.sha2(F.to_json(F.struct("file_id", "path", F.sha2("text", 256).alias("text")), {"ignoreNullFields": "false"}), 256)
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "")
    name = F.regexp_extract("path", "[^/]*$", 0)
    rows = rows.select("file_id", "path", "text", file.alias("file"), directory.alias("at"), name.alias("name"))
    texts = rows.select("file", "name", "text").where("text is not null")
    found = written_once(headers(texts), "licence-headers")
    known = matched(found, templates, least_cosine)
    far = lambda: F.struct((F.col("licence") == WEAKEST).alias("weak"), (-F.col("cosine")).alias("far"), "licence")
    hits = found.join(known, "header").groupBy("file").agg(F.min(far()).alias("best"), F.sum("size").alias("licence_words"))
    hits = hits.select("file", "best", "licence_words")
    # Rows that repeat have one file key, whose blocks are counted once; its lines are counted as often as it comes.
    by_block = written_once(blocks(texts, [*templates, *notices], least_cosine), "licence-blocks")
    by_block = by_block.select("file", far().alias("best"), F.col("size").alias("licence_words"))
    hits = hits.unionByName(by_block).groupBy("file").agg(F.min("best").alias("best"), F.max("licence_words").alias("licence_words"))
    hits = hits.select("file", "best.licence", (-F.col("best.far")).alias("cosine"), "licence_words")
    # Of files with a licence, those that are about nothing else are licence files. Texts are counted before the shuffle.
    sizes = rows.where(F.col("name").rlike(LICENCE_FILE) | F.col("text").rlike(HEADER))
    sizes = sizes.select("file", "at", "name", F.size(words("text")).alias("all_words"))
    own = sizes.join(hits, "file").select("file", "at", "name", "licence", "cosine", "licence_words", "all_words")
    whole = F.coalesce(F.col("name").rlike(LICENCE_FILE), F.lit(False)) | (F.col("licence_words") >= least_share * F.col("all_words"))
    own = written_once(own.select("file", "at", "licence", "cosine", whole.alias("whole")).distinct(), "licences")
    above = own.where("whole and at is not null").groupBy("at").agg(F.min(far()).alias("best"))
    above = above.select(F.col("at").alias("directory"), F.col("best.licence").alias("theirs"), (-F.col("best.far")).alias("their_cosine"))
    # Each distinct directory meets all directories above it, itself included; the longest that holds a licence file is the nearest.
    steps = F.split("at", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    places = rows.where("at is not null").select("at").distinct().select("at", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), prefixes))).alias("directory"))
    nearest = places.join(above, "directory").groupBy("at").agg(
        F.max_by(F.struct("directory", "theirs", "their_cosine"), F.length("directory")).alias("near")
    )
    joined = rows.select("file_id", "path", "file", "at").join(own.drop("at"), "file", "left").join(nearest, "at", "left")
    has, near = F.col("licence").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "file_id", "path",
        F.coalesce("licence", "near.theirs").alias("licence"),
        F.coalesce("cosine", "near.their_cosine").alias("cosine"),
        F.when(has & F.col("whole"), "licence file").when(has, "header").when(near, "inherited").alias("origin"),
        F.when(has & F.col("whole"), F.col("at")).when(~has, F.col("near.directory")).alias("directory"),
    )
