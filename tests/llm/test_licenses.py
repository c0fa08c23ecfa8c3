import math
import re
from collections import Counter

from pyspark.sql import functions as F

from callytics.llm import licenses


def best(text):
    """Brute force: cosine of one text to all templates."""
    idf, other, templates = licenses.vectors()
    c = Counter(licenses.words_of(text))
    norm = math.sqrt(sum((n * idf.get(w, other)) ** 2 for w, n in c.items()))
    if not norm:
        return 0.0, ""
    return max((round(sum(n * idf.get(w, other) * v.get(w, 0) for w, n in c.items()) / norm, 6), name) for name, v in templates)


def segments(path, text):
    out = text.split("\n")
    head = re.match(r"(?:\s*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*\n?)+", text)
    if head:
        out.append(head.group())
    if path and re.match(r"(?i)(licen[cs]e|copying|unlicense|notice)([._-].*)?$", path.rsplit("/", 1)[-1]):
        out.append(text)
    return out


FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("a/b/c.py", "print(1)"),
    ("a/b/d.py", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\nx = 1"),
    ("a/x/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("a/x/y/z/deep.c", "int main;"),
    ("a/x/LICENSE.txt", "Released under the MIT License."),
    ("b/e.py", "no licence here, only the words of the public"),
    ("LICENSE-root", "SPDX-License-Identifier: BSD-3-Clause"),
    ("b/LICENSE", "nothing at all"),
    ("top.py", ""),
    ("nulls.py", None),
    (None, "Licensed under CC BY-NC 4.0."),
    (None, None),
    ("a/b/c.py", "print(1)"),
    ("weird//p.c", "x " * 3_000 + "\nThis work is licensed under the GNU General Public License, version 2."),
]


def test_scan(spark):
    table = spark.createDataFrame(FILES, "path string, text string").withColumn("license", F.lit("clash")).withColumn("score", F.lit(1))
    out = licenses.scan(table).collect()
    assert len(out) == len(FILES)
    got = {(r["path"], r["text"]): r for r in out}
    for path, text in FILES:
        r = got[path, text]
        score, name = max((best(s) for s in segments(path, text or "")), default=(0, ""))
        if score >= licenses.LEAST:
            assert (r["own_license"], round(r["own_score"], 6)) == (name, score)
        else:
            assert r["own_license"] is None and r["own_score"] is None
    lic = {p: (r["license"], r["inherited_from"]) for (p, _), r in got.items() if p}
    assert lic["a/LICENSE"] == ("MIT", None)
    assert lic["a/b/c.py"] == ("MIT", "a")
    assert lic["a/b/d.py"] == ("Apache-2.0", None)
    assert lic["a/x/y/z/deep.c"] == (max((got[f] for f in FILES if f[0] in ("a/x/COPYING", "a/x/LICENSE.txt")), key=lambda r: (r["own_score"], r["own_license"]))["own_license"], "a/x")
    assert lic["b/e.py"] == lic["top.py"] == lic["nulls.py"] == lic["b/LICENSE"] == ("BSD-3-Clause", "")
    assert lic["weird//p.c"] == ("GPL-2.0", None)
    assert got[None, FILES[11][1]]["license"] == "CC-BY-NC-4.0" and got[None, None]["license"] is None
    assert "score" in out[0]


def test_each_template_finds_itself(spark):
    rows = [(f"d{i}/f.c", text) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    out = {r["path"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [out[p] for p, _ in rows] == [name for name, _ in licenses.TEMPLATES]


def test_no_text_without_an_anchor_reaches_the_least_score():
    words = licenses.anchors()
    assert len(words) < 80
    for _, vector in licenses.vectors()[2]:
        rest = math.sqrt(sum(v * v for w, v in vector.items() if w not in words))
        assert rest < licenses.LEAST


def test_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    licenses.scan(spark.createDataFrame(FILES, "path string, text string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_usual_notices_give_their_own_licence(spark):
    gnu = "{0} is free software; you can redistribute it and/or modify\n{1}it under the terms of the GNU {2}General Public License as published by\n{1}the Free Software Foundation; either version {3} of the License, or\n{1}(at your option) any later version.\n"
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
    )
    cases = {
        "GPL-2.0": "# " + gnu.format("This program", "# ", "", "2"),
        "GPL-3.0": "# " + gnu.format("This program", "# ", "", "3"),
        "LGPL-2.1": "# " + gnu.format("This library", "# ", "Lesser ", "2.1"),
        "AGPL-3.0": "# " + gnu.format("This program", "# ", "Affero ", "3"),
        "BSD-2-Clause": bsd,
        "BSD-3-Clause": bsd + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    }
    table = spark.createDataFrame([(f"d/{n}.c", t) for n, t in cases.items()], "path string, text string")
    got = {r["path"][2:-2]: r["own_license"] for r in licenses.scan(table).collect()}
    assert got == {n: n for n in cases}
