from __future__ import annotations

import math
import random
import re

from tidemark.llm import license_scan

FILES = "path string, text string, license string, origin int, _x string"


def brute(rows, threshold=0.6):
    find = lambda t: re.findall(license_scan.TERM, (t or "").lower())
    wanted = license_scan.template_terms()
    n, seen = max(1, len(rows)), [set(find(r[1])) for r in rows]
    share = {}
    w = lambda t: 1 + math.log(1.001 / (share.setdefault(t, sum(t in s for s in seen) / n) + 0.001))
    length = lambda x: math.sqrt(sum((x.count(t) * w(t)) ** 2 for t in set(x)))
    own, given = [], {}
    for path, text, *_ in rows:
        best, whole = None, find(text)
        for name, anchor, template in wanted:
            before = template.index(anchor)
            tried = [whole[max(0, p - before) : p - before + len(template)] for p, t in enumerate(whole) if t == anchor]
            if len(template) <= 25:
                tried += [x for x in map(find, (text or "").lower().split("\n")) if anchor in x]
            for x in tried:
                score = round(sum(x.count(t) * template.count(t) * w(t) ** 2 for t in set(x)) / (length(x) * length(template)), 6)
                rank = 2 if name == "all-rights-reserved" else 0 if len(template) > 25 and score >= 0.8 else 1
                if score >= threshold and (best is None or (rank, -score, name) < best):
                    best = (rank, -score, name)
        best = best and best[1:]
        own.append(best)
        if best and path and re.match(license_scan.LICENCE_FILE, path.rsplit("/", 1)[-1]):
            d = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
            given[d] = min(given.get(d, (1, "", "")), (best[0], path, best[1]))
    out = []
    for (path, *_), best in zip(rows, own, strict=True):
        name, origin = (best[1], "header") if best else (None, "none")
        if not best and path and "/" in path:
            d = path.rsplit("/", 1)[0] + "/"
            while d:
                if d in given:
                    name, origin = given[d][2], "inherited"
                    break
                d = d[: d[:-1].rfind("/") + 1]
        out.append((path, -best[0] if best else None, name, origin))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    notices = [text for _, _, text in license_scan.TEMPLATES]
    prose = lambda: " ".join(rng.choice("the of is this work under a version form with all words terms anre tion".split()) for _ in range(rng.randint(1, 30)))
    rows = []
    for i in range(250):
        lines = [prose() for _ in range(rng.randint(0, 5))]
        r = rng.random()
        if r < 0.3:
            notice = rng.choice(notices)
            if r < 0.2:
                words = notice.split()
                words[rng.randrange(len(words))] = rng.choice(["anre", "MIT", "2.0", ""])
                notice = rng.choice(["// ", "# ", "* "]) + " ".join(words)
            lines.insert(rng.randint(0, len(lines)), notice)
        depth = rng.randint(0, 4)
        path = "/".join(["", *(rng.choice("ab") for _ in range(depth)), rng.choice(["LICENSE", "copying.txt", "Notice", "licence-mit", "a.py", "b.py", "unlicensed.txt"])])
        rows.append((path, "\n".join(lines), "k", 1, "x"))
    rows += [(None, notices[0], "k", 1, "x"), ("nodir", None, "k", 1, "x"), ("/a/z.py", "", None, None, None), ("/a/z.py", "", None, None, None), ("/a/b/long.py", prose() * 900, "k", 1, "x")]
    found = license_scan.scan(spark.createDataFrame(rows, FILES).repartition(5))
    assert found.columns == ["path", "_x", "own_license", "own_score", "license", "origin"]
    got = sorted(str((r.path, r.own_score, r.license, r.origin)) for r in found.collect())
    assert got == sorted(map(str, brute(rows)))
    assert {"header", "inherited", "none"} == {r.origin for r in found.collect()}


MIT = """The MIT License (MIT)

Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.
"""
THIRD = """3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
PUBLIC = {
    "mit": MIT,
    "bsd-3-clause": BSD % THIRD,
    "bsd-2-clause": (BSD % "").replace("All rights reserved.", ""),
    "apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n",
    "gpl-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n",
    "mpl-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n\n1.2. \"Contributor Version\"\n    means the combination of the Contributions of others (if any) used\n    by a Contributor and that particular Contributor's Contribution.\n",
}
HEADERS = {
    "mit": "# Copyright 2024 Example Corp. Released under the MIT License.\n",
    "apache-2.0": "/*\n * Copyright 2024 Example Corp.\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n */\n",
    "all-rights-reserved": "// Copyright (c) 2024 Jane Doe. All rights reserved.\n",
    "gpl-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n",
}


def test_public_licence_files_and_headers(spark):
    code = "import os\n\ndef main():\n    return os.getcwd()\n" * 20
    rows = [(f"/{n}/LICENSE", t + code) for n, t in PUBLIC.items()] + [(f"/{n}/src/deep/a.py", code) for n in PUBLIC]
    rows += [(f"/h/{n}.py", t + code) for n, t in HEADERS.items()] + [("/h/none.py", code)]
    for extra in (0, 400):  # a verdict doesn't depend on the size of the table
        df = spark.createDataFrame([*rows, *((f"/z/{i}.py", f"{code} {i}") for i in range(extra))], "path string, text string")
        got = {r.path: (r.license, r.origin) for r in license_scan.scan(df).collect()}
        for name in PUBLIC:
            assert got[f"/{name}/LICENSE"] == (name, "header") and got[f"/{name}/src/deep/a.py"] == (name, "inherited")
        for name in HEADERS:
            assert got[f"/h/{name}.py"] == (name, "header")
        assert got["/h/none.py"] == (None, "none")


def test_clashing_columns_come_through(spark):
    names = ["_ls_dir", "_ls_given", "_given", "_top", "above", "salt", "key", "given"]
    df = spark.createDataFrame([("/a/LICENSE", MIT, *names), ("/a/b.py", "x", *names)], "path string, text string, " + ", ".join(f"`{n}` string" for n in names))
    found = license_scan.scan(df)
    assert found.columns == ["path", *names, "own_license", "own_score", "license", "origin"]
    assert all([r[n] for n in names] == names and r.license == "mit" for r in found.collect())


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], FILES)).count() == 0


def test_terms_travel_without_their_texts_key(spark):
    files = spark.createDataFrame([("a", "SPDX-License-Identifier: MIT"), ("b", "nothing")], "path string, text string")
    plan = license_scan.best_matches(files, license_scan.TEMPLATES, license_scan.THRESHOLD)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line and "pid#" in line]
    assert grouped and not any("key#" in line for line in grouped)
