"""Licence scans in DataFrame functions only: TF-IDF cosine to templates, then inheritance along directories.

Lines, the leading comment of a file, and the whole of a licence file are compared with licence templates as sparse vectors of
words weighted by count and inverse document frequency among the templates; words that no template has weigh as much as
the rarest. Only texts with one of the `anchors` are compared: without one, no text can reach the least score. Everything up
to a file's own licence is an expression over its row.

A file without a licence takes that of the nearest directory above it that has a licence file. Directories, not files,
are joined with their ancestors, and files then with their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from callytics.llm.common import stored

LEAST = 0.6
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
#: The number of a clause doesn't count.
CLAUSE = r"^\s*[0-9]+[.)]\s"

# Names of licences with usual notices, and the opening of their texts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    # Both have this sentence; the other clause tells the longer one.
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
]
#: Words that say nothing about a licence and don't count.
STOP = (
    "the of and to in is it its this that these those for any or not you may are be a an as at on with without under we "
    "our your from has have will shall can all no if do does by use"
).split()
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
_COMMENT = r"^(?:\\s*(?:#|//|/\\*|\\*|--|;|%|<!--)[^\\n]*\\n?)+"


def words_of(text: str) -> list[str]:
    """The words of a text that count; `best_template` gets the same ones."""
    return [w for w in re.findall(WORD, re.sub(CLAUSE, "", text.lower())) if w not in STOP]


def vectors() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Weights of words, weight of other words, and (name, unit vector) of each template."""
    counts = [Counter(words_of(text)) for _, text in TEMPLATES]
    seen = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in sorted(seen.items())}
    out = []
    for (name, _), c in zip(TEMPLATES, counts):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        out.append((name, {w: n * idf[w] / norm for w, n in sorted(c.items())}))
    return idf, math.log(1 + len(counts)) + 1, out


def anchors(least: float = LEAST) -> list[str]:
    """Words of which a text needs one to reach the least score: the word that takes most of what the templates have left,
    again and again, until the length left of each, which bounds the cosine of a text without these words, is below."""
    out: set[str] = set()
    left = [dict(vector) for _, vector in vectors()[2]]
    while left := [v for v in left if sum(x * x for x in v.values()) >= least * least]:
        gain: Counter[str] = Counter()
        for v in left:
            for w, x in v.items():
                gain[w] += x * x * (1 if w.isalpha() else 0.5)  # numbers are frequent in texts
        word = max(gain, key=lambda w: (gain[w], w))
        out.add(word)
        for v in left:
            v.pop(word, None)
    return sorted(out)


def best_template(words: str) -> str:
    """SQL for struct(score, license): the template nearest to an array of words; the score is rounded to 9 places."""
    idf, other, templates = vectors()
    table = "map(" + ", ".join(f"'{w}', {v!r}D" for w, v in idf.items()) + ")"
    weight = lambda w: f"coalesce(try_element_at({table}, {w}), {other!r}D)"
    # The squares of the counts of equal words, in one pass over the sorted words.
    square = (
        f"aggregate(array_sort({words}), named_struct('w', '', 'n', 0, 's', 0.0D), (a, w) -> if(w = a.w, "
        f"named_struct('w', w, 'n', a.n + 1, 's', a.s + (2 * a.n + 1) * {weight('w')} * {weight('w')}), "
        f"named_struct('w', w, 'n', 1, 's', a.s + {weight('w')} * {weight('w')})), a -> a.s)"
    )
    rows = ", ".join(
        f"named_struct('name', '{name}', 'v', array(" + ", ".join(f"named_struct('w', '{w}', 'x', {x * idf[w]!r}D)" for w, x in v.items()) + "))"
        for name, v in templates
    )
    dot = f"aggregate(r.v, 0.0D, (a, e) -> a + e.x * size(filter({words}, w -> w = e.w)))"
    scores = f"transform(array({rows}), r -> named_struct('score', round({dot} / sqrt(n), 9), 'license', r.name))"
    return f"transform(array({square}), n -> array_max({scores}))[0]"


def own_license(text: str, whole: str = "false", least: float = LEAST) -> str:
    """SQL for struct(score, license) of a text column, null without a licence; `whole` tells if all of it is one."""
    lines = f"split({text}, '\\n')"
    parts = f"concat({lines}, array(regexp_extract({text}, '{_COMMENT}', 0)), if({whole}, array({text}), array()))"
    some = f"filter({parts}, p -> p rlike '\\\\b({'|'.join(anchors(least)).replace('.', '[.]')})\\\\b')"
    stop = ", ".join(f"'{w}'" for w in STOP)
    clause = CLAUSE.replace("\\", "\\\\")
    words = f"transform({some}, p -> filter(regexp_extract_all(regexp_replace(p, '{clause}', ''), '{WORD}', 0), w -> w not in ({stop})))"
    scored = f"transform({words}, ws -> {best_template('ws')})"
    best = f"array_max({scored})"
    return f"transform(array({best}), b -> if(b.score >= {least!r}D, b, null))[0]"


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """All columns of `files` with own_license, own_score, license (own or inherited) and inherited_from (a directory).

    Null and empty texts have no licence of their own; a null path inherits nothing. Of several licence files in a directory
    the one with the highest score counts, then the greater licence name. Columns of these names are replaced.
    """
    names = ["own_license", "own_score", "license", "inherited_from"]
    path = F.col(path_col)
    is_license = F.coalesce(F.regexp_extract(path, r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False))
    rows = files.drop(*names).withColumn("_whole_", is_license).withColumn("_lower_", F.lower(F.col(text_col)))
    rows = rows.withColumn("_own_", F.expr(own_license("_lower_", "_whole_", least))).drop("_lower_")
    rows = rows.withColumn("_dir_", F.regexp_extract(path, r"^(.*)/[^/]*$", 1))

    # Only licence files are scored here; all files are scored once, at the end.
    narrow = stored(rows.select("_dir_").filter("_dir_ is not null").distinct(), "directories")
    licensed = rows.filter("_whole_ and _dir_ is not null").groupBy(F.col("_dir_").alias("above")).agg(F.max("_own_").alias("found"))
    licensed = stored(licensed.filter("found is not null"), "licensed")
    parts: Column = F.split("_dir_", "/")
    above = narrow.select(
        "_dir_", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")
    )
    above = above.select("_dir_", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above")).distinct()
    nearest = above.join(licensed, "above").groupBy("_dir_").agg(
        F.max(F.struct("depth", "above", "found.license")).alias("near")
    )
    inherited = stored(nearest.select("_dir_", "near.above", "near.license"), "inherited")

    out = rows.join(inherited.withColumnsRenamed({"above": "_above_", "license": "_theirs_"}), "_dir_", "left")
    mine = F.col("_own_").isNotNull()
    return out.select(
        *(out[c] for c in files.columns if c not in names),
        F.col("_own_.license").alias("own_license"),
        F.col("_own_.score").alias("own_score"),
        F.when(mine, F.col("_own_.license")).otherwise(F.col("_theirs_")).alias("license"),
        F.when(~mine, F.col("_above_")).alias("inherited_from"),
    )
