"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Words are runs of ASCII letters and digits in lower case, shingles are ``WORDS`` of them (a
template of fewer words is one shingle).  Templates fall into size classes (powers of two); a
class looks at windows of one and a half times its size that overlap so that an occurrence lies
whole in one.  A window that holds 0.8 of a template's shingles has a Jaccard similarity of 0.25
with it at least, so ``BANDS`` one-row bands collide with probability 1 - 0.75**BANDS (0.999).
A retrieved template counts where a window holds ``CONTAINED`` of its shingles.

A window can hold that share only if it has one of the template's anchor words (chosen so that
the shingles without any anchor are too few), so windows are cut around anchors: nothing is lost,
and documents without an anchor never leave the scan.  All of it is built-in functions; templates
(``MOST_TEMPLATES`` at most, checked) are literals of the plan.

Defined results: null and empty texts match nothing; repeated documents give repeated rows, since
every row is judged alone; several occurrences of a template give one row, with the best
containment; empty tables give an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, CONTAINED, BANDS, MOST_TEMPLATES, MOST_TEMPLATE_WORDS = 5, 0.8, 24, 1000, 100_000

# License notices as published.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_shingles(text: str, n: int = WORDS) -> list[str]:
    w = template_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))) if w else []


def size_class(shingles: int) -> int:
    return 1 << max(0, (shingles - 1).bit_length())


def anchors(texts: list[str], n: int = WORDS, contained: float = CONTAINED) -> list[str]:
    """Words such that the shingles with none of them are fewer than a match needs, for each template; rare and long ones first."""
    counts = Counter(w for t in texts for w in set(template_words(t)))
    out: list[str] = []
    for t in sorted(texts, key=len):
        left = [set(s.split()) for s in template_shingles(t, n)]
        need = math.ceil(contained * len(left) - 1e-9)
        left = [s for s in left if not s & set(out)]
        while left and len(left) >= need:
            share = Counter(w for s in left for w in s)
            # Long words, which few other texts have, before short ones; of these one that is enough, else one that covers most.
            word = max(share, key=lambda w: (len(w) > 5, len(left) - share[w] < need, share[w] * (len(left) - share[w] >= need), len(w), -counts[w], w))
            out.append(word)
            left = [s for s in left if word not in s]
    return out


def _windows(cls: int, n: int) -> Column:
    """A class's windows that have a shingle with one of the words in ``at``: these shingles begin up to n - 1 words before, windows at multiples of the step."""
    step = max(1, cls // 2)
    width = cls + step

    def around(p: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((p - (n - 1) - width + 1) / step).cast("int"))
        final = F.floor(F.least(p, F.size("sh") - 1) / step).cast("int")
        return F.when(final >= first, F.sequence(first, F.greatest(first, final))).otherwise(F.array().cast("array<int>"))

    return F.transform(F.array_distinct(F.flatten(F.transform("at", around))), lambda k: F.struct(F.lit(cls).alias("cls"), (k * step).alias("from"), F.lit(width).alias("width")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, contained: float = CONTAINED, bands: int = BANDS) -> DataFrame:
    """(id, license, containment): each template that some window of a document holds."""
    spark = docs.sparkSession
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if template_words(v)}
    assert len(templates) <= MOST_TEMPLATES and sum(len(template_words(t)) for t in templates.values()) <= MOST_TEMPLATE_WORDS, "too many templates for literals of a plan"
    if not templates:
        return docs.select(id_col, F.lit("").alias("license"), F.lit(0.0).alias("containment")).limit(0)
    marks = anchors(list(templates.values()), n, contained)
    classes = sorted({size_class(len(template_shingles(t, n))) for t in templates.values()})
    known = spark.createDataFrame([(name, size_class(len(s := template_shingles(t, n))), s) for name, t in templates.items()], "license string, cls int, shingles array<string>")
    hashed = F.transform("shingles", lambda s: F.xxhash64(s))
    seeded = lambda b: lambda h: F.xxhash64(h, F.lit(b))
    least = lambda arr: F.array(*[F.array_min(F.transform(arr, seeded(b))) for b in range(bands)])
    known = known.select("license", "cls", hashed.alias("wanted")).select("license", "cls", "wanted", F.posexplode(least(F.col("wanted"))).alias("band", "value"))
    low = F.lower(text_col)
    has_mark = None
    for w in marks:
        has_mark = low.contains(w) if has_mark is None else has_mark | low.contains(w)
    words = docs.filter(has_mark).select(F.col(id_col).alias("own"), F.monotonically_increasing_id().alias("__id"), F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    # One shingle for a text of fewer words than n; else one a place.
    last = F.greatest(F.lit(0), F.size("w") - n)  # an anchor has been found, so there is a word
    words = words.select("own", "__id", "w", F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, n), " "))).alias("sh"))
    mark_set = F.array(*[F.lit(w) for w in marks])
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(mark_set, F.element_at("w", i + 1)))
    words = words.select("own", "__id", "sh", at.alias("at"))
    starts = F.concat(*[_windows(c, n) for c in classes])
    # Outer: else the optimizer tests for an empty array before the words are split, and so splits for every use.
    windows = words.select("own", "__id", "sh", F.explode_outer(starts).alias("x")).filter(F.col("x").isNotNull()).select("own", "__id", F.col("x.cls").alias("cls"), F.array_distinct(F.slice("sh", F.col("x.from") + 1, F.col("x.width"))).alias("sh"))
    banded = windows.select("own", "__id", "cls", "sh", F.posexplode(least(F.col("sh"))).alias("band", "value"))
    hit = banded.join(F.broadcast(known), ["cls", "band", "value"])
    share = F.size(F.array_intersect("sh", "wanted")) / F.size("wanted")
    best = hit.select("own", "__id", "license", share.alias("share")).filter(F.col("share") >= contained).groupBy("__id", "license").agg(F.max("share").alias("share"), F.first("own").alias("own"))
    # Rows are told apart by their place, so repeated ids and null ones stay rows of their own.
    return best.select(F.col("own").alias(id_col), "license", F.round("share", 6).alias("containment"))


def oracle(templates: dict[str, str] | None = None, n: int = WORDS, contained: float = CONTAINED) -> str:
    """The same, without bands and anchors: every window that shares a shingle with a template."""
    templates = TEMPLATES if templates is None else templates
    rows = ", ".join("('{}', {}, {}, '{}')".format(name, size_class(len(s)), len(s), x) for name, t in templates.items() if (s := template_shingles(t, n)) for x in s)
    return f"""
with t(license, cls, m, s) as (values {rows}),
w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents where text is not null),
p as (select r, doc_id, w, unnest(range(0, greatest(len(w) - {n}, 0) + 1)) as i from w where len(w) > 0),
s as (select r, doc_id, i, array_to_string(w[i + 1 : i + {n}], ' ') as s from p),
m as (select r, doc_id, i, license, cls, m, s.s, greatest(1, cls // 2) as step from s join t on s.s = t.s),
k as (select r, doc_id, license, m, s, unnest(range(greatest(0, cast(ceil((i - (cls + step) + 1) / step) as bigint)), i // step + 1)) as k from m),
c as (select r, doc_id, license, k, count(distinct s) / any_value(m) as share from k group by all)
select doc_id, license, round(max(share), 6) as containment from c where share >= {contained} group by r, doc_id, license"""
