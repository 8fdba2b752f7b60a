import re
from collections import Counter, defaultdict
from math import log, sqrt
from pathlib import Path

import pytest

from tests.llm.rows import LONG, same
from tranche.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
FILES = [
    (1, "a/LICENSE", MIT), (2, "a/x.py", "print(1)"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 30),
    (4, "a/b/c/z.py", "no notice"), (5, "a/b/c/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (6, "a/b/c/d/e/q.py", None), (7, "other/file", "a licence to speak of something else entirely, and so on"), (8, "top.txt", ""),
    (9, None, "Released under the MIT License."), (10, "other/b.txt", "x\r\nReleased under the MIT License.\r\nCopyright. All rights reserved."),
    (11, "a/b/c/d/LICENSE", "Released under the MIT License."), (2, "a/x.py", "print(1)"), (None, "a/n.py", LONG), (12, "aa/x.py", "print"), (13, "a/", ""),
]


def terms(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:], strict=False))


def brute(files):
    heads, per = [], {}
    for n, (_, path, text) in enumerate(files):
        name = (path or "").rpartition("/")[2]
        named = path is not None and re.match(licenses.LICENCE_FILE, name)
        lines = [] if text is None else [text] if named else [x for x in text.split("\n") if re.search(licenses.HEADER, x)]
        per[n] = [x for x in lines if terms(x)]
    seen = {}
    for n, f in enumerate(files):
        if f not in seen:
            seen[f] = n
    heads = [x for n in per for x in per[n]]
    df = Counter(t for x in heads for t in terms(x))
    weight = lambda tf: {t: c * (log((len(heads) + 1) / (df[t] + 1)) + 1) for t, c in tf.items()}
    norm = lambda w: sqrt(sum(x * x for x in w.values()))
    own, above = {}, defaultdict(list)
    for n, (_, path, text) in enumerate(files):
        best, size = [], 0
        for x in per[n]:
            w = weight(terms(x))
            found = []
            for licence, template in licenses.TEMPLATES:
                v = weight(terms(template))
                found.append((-round(sum(w[t] * v[t] for t in w.keys() & v.keys()) / norm(w) / norm(v), 9), licence))
            if -min(found)[0] >= licenses.LEAST_COSINE:
                best.append(min(found))
                size += len(re.findall("[a-z0-9]+", x.lower()))
        if best:
            name = (path or "").rpartition("/")[2]
            whole = bool(path is not None and re.match(licenses.LICENCE_FILE, name)) or size >= 0.5 * len(re.findall("[a-z0-9]+", text.lower()))
            own[n] = (*min(best), whole)
            if whole and path is not None:
                above[path.rpartition("/")[0]].append(min(best))
    out = []
    for n, (i, path, _) in enumerate(files):
        folder = None if path is None else path.rpartition("/")[0]
        if n in own:
            far, licence, whole = own[n]
            out.append((i, path, licence, -far, "licence file" if whole else "header", folder if whole else None))
            continue
        while folder is not None and folder not in above:
            folder = folder.rpartition("/")[0] if folder else None
        near = min(above[folder]) if folder is not None else (None, None)
        out.append((i, path, near[1], near[0] and -near[0], "inherited" if near[1] else None, folder))
    return out


def frame(spark, files):
    return spark.createDataFrame([(*f, "x", 0.5) for f in files], "file_id long, path string, text string, header string, cosine double")


def test_licences_and_inheritance(spark):
    found = [tuple(r) for r in licenses.scan(frame(spark, FILES)).collect()]
    near = lambda r: (*r[:3], r[3] and round(r[3], 6), *r[4:])
    same(map(near, found), map(near, brute(FILES)))


def test_nearest_directory_wins(spark):
    got = {r["file_id"]: (r["licence"], r["origin"], r["directory"]) for r in licenses.scan(frame(spark, FILES)).collect()}
    assert got[2] == got[4] == ("MIT", "inherited", "a")
    assert got[6][1:] == ("inherited", "a/b/c/d")
    assert got[3] == ("Apache-2.0", "header", None)
    assert got[12] == (None, None, None)


def test_empty_table_and_no_headers(spark):
    assert licenses.scan(frame(spark, FILES).limit(0)).count() == 0
    assert [r["licence"] for r in licenses.scan(frame(spark, [(1, "a/b", "plain")])).collect()] == [None]


HEADERS = [
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "GPL-3.0"),
    ("// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("# SPDX-License-Identifier: (ISC OR MIT)", "ISC"),
    ("All rights reserved.", "proprietary"),
    ("Copyright (c) 2015-2024 Some Company, Inc. and others. All rights reserved.", "proprietary"),
    ("Copyright (c) 2015 X. All rights reserved.\nUse of this source code is governed by a BSD-style license that can be\nfound in the LICENSE file.", "BSD-3-Clause"),
    ("for all rights of the people were reserved by law, and copyright is a licence to speak", None),
]


@pytest.mark.parametrize("often", [1, 60])
def test_wrapped_spdx_and_copyright_notices_however_common(spark, often):
    code = "\n\n" + "\n".join(f"int value{n} = {n};" for n in range(60))
    rows = [(n * 100 + k, f"f{n}/{k}.c", f"import a\n{text}{code}{k}") for n, (text, _) in enumerate(HEADERS) for k in range(often)]
    got = {r["file_id"]: (r["licence"], r["origin"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert {n: got[n * 100] for n in range(len(HEADERS))} == {n: (w, w and "header") for n, (_, w) in enumerate(HEADERS)}
    assert len(got) == len(rows) and all(got[n * 100 + k] == got[n * 100] for n in range(len(HEADERS)) for k in range(often))


WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
WHOLE = {"MIT": f"MIT License\n\nCopyright (c) 2024 A. Person\n\n{GRANT}\n\n{WARRANTY}\n"}
WHOLE |= {k: Path("/usr/share/common-licenses", f).read_text() for k, f in {"Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}.items() if Path("/usr/share/common-licenses", f).exists()}


@pytest.mark.parametrize("often", [1, 20])
def test_files_inherit_from_unabridged_licence_files(spark, often):
    rows = []
    for n, text in enumerate(WHOLE.values()):
        for k in range(often):
            at = n * 1000 + k * 2
            rows += [(at, f"d{n}_{k}/{('LICENSE', 'COPYING.txt')[k % 2]}", text), (at + 1, f"d{n}_{k}/src/deep/x.py", "print(1)")]
    got = {r["file_id"]: (r["licence"], r["origin"], r["directory"]) for r in licenses.scan(frame(spark, rows)).collect()}
    for n, licence in enumerate(WHOLE):
        for k in range(often):
            assert got[n * 1000 + k * 2] == (licence, "licence file", f"d{n}_{k}")
            assert got[n * 1000 + k * 2 + 1] == (licence, "inherited", f"d{n}_{k}")
