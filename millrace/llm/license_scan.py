"""License notices by MinHash bands over overlapping text windows, verified by shingle containment.

Only DataFrame functions run on the documents and the templates.

1. A text becomes words (letters and digits, lower case) and the 64-bit hashes of its five-word
   shingles, one array a text.
2. Templates fall into size classes; class c has windows of ``WINDOWS[c]`` shingles that overlap by
   half, and its templates are at most half as long, so some window holds any notice whole. A window
   without a shingle of its class's templates shares no least hash with any of them, so it has no
   band to look up and is not built; every other window is built whole.
3. A window's signature is the least value of each of ``bands_of`` hash functions over all its own
   shingles, other text included; a band is one value. A window that holds ``CONTAINED`` of a template
   shares a band with it with probability 1 - ``MISS`` at least, however much other text is in it: the
   number of bands follows from the least Jaccard similarity that such a window can have.
4. Each retrieved pair is verified exactly: at least ``CONTAINED`` of the template's shingles are in
   the window. Several templates may be found in a text; notices of fewer than five words are none.

Null and empty texts have no license. Rows with the same id and text agree.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table

SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-6
WINDOWS = (16, 64, 512)

# Notices as their licenses give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_rows(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(name, size class, its distinct shingles, words joined by spaces); one with too few words is an error."""
    out = []
    for name, text in sorted(templates.items()):
        w = words_of(text)
        n = len(w) - SHINGLE + 1
        if n < 1 or 2 * n > WINDOWS[-1]:
            raise ValueError(f"{name}: {len(w)} words")
        out.append((name, next(c for c, size in enumerate(WINDOWS) if 2 * n <= size), sorted({" ".join(w[i : i + SHINGLE]) for i in range(n)})))
    return out


def bands_of(sizes: list[int], window: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """How many one-value bands a class of ``window`` shingles needs, for templates of ``sizes`` shingles.

    A window that holds m of a template's n shingles is similar to it by m / (window + n - m) or more.
    """
    held = [(math.ceil(contained * n), n) for n in sizes]
    least = min(m / (window + n - m) for m, n in held)
    return math.ceil(math.log(miss) / math.log1p(-least))


def templates_of(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Rows (license, c, n, own): each template's shingle hashes as an array; literals, no job."""
    rows = ", ".join(f"('{name}', {c}, {len(shingles)}, array({', '.join(repr(s) for s in shingles)}))" for name, c, shingles in template_rows(templates))
    t = spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, c, n, s)")
    return t.select("license", "c", "n", F.transform("s", lambda s: F.xxhash64(s)).alias("own"))


def _signature(hashes, bands):
    """The least value of each hash function over ``hashes``."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def shingles_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, th, hs): the shingle hashes of ``docs(doc_id, text)`` in order, and a hash of the text."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), w.alias("w"))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("w", i + k) for k in range(SHINGLE)])))
    return rows.select("doc_id", "th", F.when(F.size("w") >= SHINGLE, each).alias("hs"))


def windows_of(shingles: DataFrame, hashes: dict[int, list[int]]) -> DataFrame:
    """Rows (doc_id, th, c, start, win): windows, as arrays, that hold one of ``hashes`` of their class."""
    every = sorted({h for own in hashes.values() for h in own})
    at = F.transform("hs", lambda h, i: F.when(h.isin(every), F.struct(i.alias("i"), h.alias("h"))))
    placed = shingles.select("doc_id", "th", "hs", F.filter(at, lambda p: p.isNotNull()).alias("at"))

    def starts(c: int):
        half = WINDOWS[c] // 2
        mine = F.filter("at", lambda p: p["h"].isin(hashes[c]))
        slots = F.array_distinct(F.transform(mine, lambda p: F.floor(p["i"] / half).cast("int")))
        # a place is in the window that starts in its half and in the one before
        both = F.array_distinct(F.flatten(F.transform(slots, lambda s: F.array((s - 1) * half, s * half))))
        return F.transform(both, lambda s: F.struct(F.lit(c).alias("c"), s.alias("start")))

    where = placed.select("doc_id", "th", "hs", F.explode(F.concat(*[starts(c) for c in sorted(hashes)])).alias("p"))
    size = F.element_at(F.array(*[F.lit(x) for x in WINDOWS]), F.col("p.c") + 1)
    first = F.greatest(F.col("p.start"), F.lit(0))
    return where.select("doc_id", "th", "p.c", first.alias("start"), F.slice("hs", first + 1, size + F.least(F.col("p.start"), F.lit(0))).alias("win"))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Rows (doc_id, th, license, containment, first_shingle): each notice found in each text."""
    t = templates_of(docs.sparkSession, templates)
    hashes, sizes = {}, {}
    for r in t.collect():  # the templates alone
        hashes[r["c"]] = sorted({*hashes.get(r["c"], ()), *r["own"]})
        sizes.setdefault(r["c"], []).append(r["n"])
    bands = F.element_at(F.array(*[F.lit(bands_of(sizes.get(c, [1]), x, contained)) for c, x in enumerate(WINDOWS)]), F.col("c") + 1)
    mine = t.select("license", "c", F.posexplode(_signature(F.col("own"), bands)).alias("k", "v"))
    near = windows_of(shingles_of(docs), hashes).select("*", F.posexplode(_signature(F.col("win"), bands)).alias("k", "v"))
    pairs = near.join(F.broadcast(mine), ["c", "k", "v"]).join(F.broadcast(t.select("license", "n", "own")), "license")
    both = pairs.select("doc_id", "th", "license", "n", "start", "win", F.array_intersect("own", "win").alias("both"))
    at = F.array_min(F.transform("both", lambda h: F.array_position("win", h))) - 1 + F.col("start")
    held = both.where(F.size("both") >= contained * F.col("n")).select("doc_id", "th", "license", (F.size("both") / F.col("n")).alias("share"), at.cast("int").alias("at"))
    return held.groupBy("doc_id", "th", "license").agg(F.max("share").alias("containment"), F.min("at").alias("first_shingle"))


def licenses_by_document(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Rows (doc_id, n_licenses, licenses), one for each row of ``docs``; names in order, joined by commas."""
    found = find_licenses(docs, templates).groupBy("doc_id", "th").agg(F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"), F.count("*").alias("n_licenses"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "licenses", "n_licenses")
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    got = own.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    return got.select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def op2_license_scan(spark, sf_dir):
    return licenses_by_document(read_table(spark, sf_dir, "documents"))


def oracle(templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> str:
    """SQL that compares every window with every template."""
    rows = ", ".join(f"('{name}', {c}, '{s}', {len(shingles)})" for name, c, shingles in template_rows(templates) for s in shingles)
    return rf"""
WITH t(license, c, s, n) AS (VALUES {rows}),
     w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
     x AS (SELECT doc_id, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM w),
     s AS (SELECT doc_id, pos, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o || ' ' || lead(w1, 4) OVER o AS s FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
     h AS (SELECT s.doc_id, t.license, t.n, s.s, s.pos // (CASE t.c WHEN 0 THEN {WINDOWS[0] // 2} WHEN 1 THEN {WINDOWS[1] // 2} ELSE {WINDOWS[2] // 2} END) AS slot FROM s JOIN t ON s.s = t.s),
     p AS (SELECT doc_id, license, n, s, slot AS win FROM h UNION ALL SELECT doc_id, license, n, s, slot - 1 FROM h),
     g AS (SELECT doc_id, license FROM p GROUP BY doc_id, license, win, n HAVING count(DISTINCT s) >= {contained} * n),
     d AS (SELECT doc_id, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS l FROM g GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_licenses, coalesce(d.l, '') AS licenses
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id
"""


SQL = oracle()
