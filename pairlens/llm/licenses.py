"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

A text becomes lower-cased words; five of them in a row are a shingle, known by its hash.  For
every size class of templates (a power of two), windows of that many shingles overlap by three
quarters.  A window's MinHash signature has ``BANDS`` values, each a band of its own: a window
with Jaccard similarity s to a template shares a band with probability 1 - (1 - s)^BANDS, over
0.9999 at s = 0.35, which is below what a window at the worst offset has of a text that contains
0.8 of a template.  Bands are joined with the templates' bands, and the share of the template's
shingles that the window and its surroundings contain decides.

Only windows with a shingle of some template get a signature: the others have nothing in common
with any, so this loses nothing.  Texts are cut into blocks of shingles first, with what windows at
their edges need, so a row stays small however long its text.  All steps are column expressions and
one join with the bands of the template library, which has ``LIBRARY`` shingles at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 24
CONTAINED = 0.8
#: Shingles of a text that are worked on at once.
BLOCK = 8192
#: Distinct shingles of all templates: the table that is broadcast.
LIBRARY = 200_000

#: Notices and headers of common licenses.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "MIT/warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-3-Clause/conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense/grant": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "proprietary/notice": "All rights reserved.",
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_hashes(words: str, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words of the array column ``words``."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)]))


def signature(hashes: Column, bands: int = BANDS) -> Column:
    def band(j: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(j))))

    return F.array(*[band(j) for j in range(bands)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, size`` (words in a shingle), ``hashes`` (distinct) and ``width``, the window class."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string").select("license", words_of(F.col("body")).alias("w"))
    # a template of fewer words than a shingle is one shingle of all of them
    out = None
    for size in range(1, SHINGLE + 1):
        own = rows.where(F.size("w") >= SHINGLE if size == SHINGLE else F.size("w") == size).where(F.col("w")[0] != "")
        part = own.select("license", F.lit(size).alias("size"), F.array_distinct(shingle_hashes("w", size)).alias("hashes"))
        out = part if out is None else out.union(part)
    return out.withColumn("width", F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes")))).cast("int"))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per document and license template that it contains: ``doc_id, license, containment, word_start``.

    ``containment`` is the greatest share of the template's shingles found around one window,
    ``word_start`` the first such window's first word.  Null, empty and wordless texts have none.
    Repeated rows under one id are reported once; a null id stays.  Whole texts are scanned; a
    notice may be repeated without bound.  Ties go to the first place.  Empty tables and libraries of no words
    give no rows; other columns aren't read.  More than ``LIBRARY`` template shingles are an error.
    """
    spark = df.sparkSession
    library = template_table(spark, templates or TEMPLATES).collect()
    if sum(len(r["hashes"]) for r in library) > LIBRARY:
        raise ValueError(f"a library of {LIBRARY} shingles at most is searched at once: scan once for each part of it")
    classes = sorted({(r["size"], r["width"]) for r in library})
    if not classes:
        return df.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("word_start")).where("false")
    sizes = sorted({s for s, _ in classes})

    def once(value: Column) -> Column:
        # computed once: the optimiser moves nothing through a generator
        return F.explode(F.array(value))

    docs = df.select(F.col(id_col).alias("doc_id"), once(words_of(F.col(text_col))).alias("w"))
    hashed = docs.select("doc_id", once(F.struct(*[shingle_hashes("w", s).alias(f"h{s}") for s in sizes])).alias("x")).select("doc_id", "x.*")

    margin = 2 * max(w for _, w in classes)
    longest = F.greatest(*[F.size(f"h{s}") for s in sizes], F.lit(1))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((longest - 1) / BLOCK).cast("int")),
        lambda b: F.struct((b * BLOCK).alias("begin"), F.greatest(b * BLOCK - margin, F.lit(0)).alias("low"), *[F.slice(f"h{s}", F.greatest(b * BLOCK - margin, F.lit(0)) + 1, F.lit(BLOCK + 2 * margin)).alias(f"h{s}") for s in sizes]),
    )
    hashed = hashed.select("doc_id", F.explode(blocks).alias("x")).select("doc_id", "x.*")

    def inside(size: int) -> Column:
        """Places in the text of this block's shingles that some template has."""
        known = sorted({h for r in library if r["size"] == size for h in r["hashes"]})
        h, low, begin = F.col(f"h{size}"), F.col("low"), F.col("begin")
        places = F.sequence(begin, F.least(begin + BLOCK, low + F.size(h)) - 1)
        return F.when(begin < low + F.size(h), F.filter(places, lambda i: F.get(h, i - low).isin(known))).otherwise(F.array().cast("array<int>"))

    hits = hashed.select("*", once(F.struct(*[inside(s).alias(f"at{s}") for s in sizes])).alias("x")).select("*", "x.*")
    hits = hits.where(" OR ".join(f"size(at{s}) > 0" for s in sizes))

    def windows(size: int, width: int) -> Column:
        h, step = F.col(f"h{size}"), max(1, width // 4)
        starts = F.array_distinct(F.flatten(F.transform(f"at{size}", lambda p: F.transform(F.sequence(F.lit(0), F.lit((width - 1) // step)), lambda k: (F.floor(p / step) - k).cast("int") * step))))

        def cut(start: Column, length: int) -> Column:
            first = F.greatest(start, F.lit(0))
            return F.array_distinct(F.slice(h, first - F.col("low") + 1, F.greatest(start + length - first, F.lit(0))))

        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size"), F.lit(width).alias("width"), cut(s, width).alias("shingles"), cut(s - width // 2, 2 * width).alias("around")))

    rows = hits.select("doc_id", F.explode(F.concat(*[windows(s, w) for s, w in classes])).alias("x")).select("doc_id", "x.*")
    banded = rows.where(F.size("shingles") > 0).select("doc_id", "start", "size", "width", "around", F.posexplode(signature(F.col("shingles"))).alias("band", "value"))
    own = spark.createDataFrame([(r["license"], r["size"], r["width"], r["hashes"]) for r in library], "license string, size int, width int, hashes array<bigint>")
    own = own.select("license", "size", "width", "hashes", F.posexplode(signature(F.col("hashes"))).alias("band", "value"))
    share = F.size(F.array_intersect("around", "hashes")) / F.size("hashes")
    found = banded.join(F.broadcast(own), ["size", "width", "band", "value"]).select("doc_id", "license", "start", share.alias("share")).where(F.col("share") >= contained)
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("share", (-F.col("start")).alias("at"))).alias("b"))
    return best.select("doc_id", "license", F.round("b.share", 6).alias("containment"), F.greatest(-F.col("b.at"), F.lit(0)).cast("int").alias("word_start"))
