"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

A text is read as words (runs of letters and digits, lower case). Templates are
grouped by their number of 5-word shingles into size classes (a template of fewer
words has shingles of its own length); a class has
windows of one and a half times its largest template, each starting a sixth of
that after the one before, so that every place where a template can stand lies
inside one window. A window's MinHash has ``BANDS`` bands of one value. The
similarity of a window and a template that it contains to 0.75 is at least 0.22,
so the bands miss it with odds of less than 0.0004. Retrieved templates are
verified by exact containment of their shingles in the window. Licenses of one
family have notices that differ in few words: where templates of several of them
reach the containment within ``NEAR`` words, those of the license that comes closest
are reported.

Two exact prunes keep the work small: a text without any of the marker words
cannot hold 0.75 of a template's shingles, and only windows with at least one
template shingle are hashed. Templates, their shingles and their bands are
parameters of fixed size and are broadcast. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.shared import materialise

SHINGLE = 5
CONTAINED = (75, 100)
BANDS = 32
SEED = 20_240_605
#: Templates a scan takes at most, and words of one, as they are sent to all tasks.
MOST_TEMPLATES, MOST_WORDS = 5_000, 20_000
#: Words between the windows of templates of one family that are taken for one place.
NEAR = 200

# Texts of public licenses and of notices that name them.
TEMPLATES: dict[str, tuple[str, str]] = {
    "mit-named": ("MIT", "Released under the MIT License."),
    "apache-2.0-named": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "cc-by-nc-4.0-named": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "gpl-3.0-named": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "mit-grant": (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mit-warranty": (
        "MIT",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache-2.0-notice": (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl-3.0-notice": (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "bsd-conditions": (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "isc-grant": (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "unlicense": (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc-by-4.0-named": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0-named": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "mpl-2.0-notice": (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "gpl-2.0-notice": (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "lgpl-2.1-notice": (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "agpl-3.0-notice": (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "bsd-3-endorsement": (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc0-waiver": (
        "CC0-1.0",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    "all-rights-reserved": ("All rights reserved", "All rights reserved."),
}
#: Licenses whose notices are alike.
FAMILIES = {"GPL-2.0": "GPL", "GPL-3.0": "GPL", "LGPL-2.1": "GPL", "AGPL-3.0": "GPL", "CC-BY-4.0": "CC", "CC-BY-SA-4.0": "CC"}
# End of fixed values.

_BREAK = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    """The words of a template (plain Latin letters and digits)."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def marker_words(templates: dict[str, tuple[str, str]] = TEMPLATES) -> list[str]:
    """Words one of which every text has that contains 0.75 of a template's shingles.

    For each template, the least common words across the templates' shingles
    that together stand in more than a quarter of its shingles; words chosen for
    one template are used again for others first.
    """
    chosen: list[str] = []
    for words in sorted(filter(None, (template_words(text) for _, text in templates.values())), key=lambda w: (len(w), w)):
        n = max(1, len(words) - SHINGLE + 1)
        shingles = [set(words[i : i + SHINGLE]) for i in range(n)]
        while 4 * sum(any(w in s for w in chosen) for s in shingles) <= n:
            uncovered = Counter(w for s in shingles if not any(c in s for c in chosen) for w in s)
            chosen.append(max(uncovered, key=lambda w: (len(w) >= 7, uncovered[w], len(w), w)))
    return sorted(set(chosen))


def _hashes(words: Column, width: int) -> Column:
    """Hashes of an array's shingles of ``width`` words in order; none of fewer words."""
    n = F.size(words)
    at = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n >= width, at).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """The MinHash of an array of shingle hashes: one value for each band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band, F.lit(SEED)))))


def _widths(templates: dict[str, tuple[str, str]]) -> list[int]:
    """The shingle lengths of templates: ``SHINGLE``, or all words of a shorter one."""
    return sorted({min(SHINGLE, len(words)) for _, text in templates.values() if (words := template_words(text))})


def template_table(spark: SparkSession, templates: dict[str, tuple[str, str]]) -> DataFrame:
    """(template, license, family, nth, width, t_shingles, n, span, step): shingles of each template and its class's windows.

    Templates without words are left out.
    """
    rows = [(name, kind, FAMILIES.get(kind, name), nth, words) for nth, (name, (kind, text)) in enumerate(sorted(templates.items())) if (words := template_words(text))]
    if len(rows) > MOST_TEMPLATES or any(len(r[-1]) > MOST_WORDS for r in rows):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of at most {MOST_WORDS} words can be scanned for at once")
    made = spark.createDataFrame(rows, "template string, license string, family string, nth int, words array<string>")
    n = F.size("words")
    width = F.least(F.lit(SHINGLE), n)
    hashed = F.lit(None).cast("array<bigint>")
    for w in _widths(templates):
        hashed = F.when(width == w, _hashes(F.col("words"), w)).otherwise(hashed)
    shingles = made.select("template", "license", "family", "nth", width.alias("width"), F.array_distinct(hashed).alias("t_shingles"), (n - width + 1).alias("length"))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("length").cast("double")))).cast("int")
    step = F.greatest(F.lit(1), F.floor(largest / 4)).cast("int")
    return shingles.select("template", "license", "family", "nth", "width", "t_shingles", F.size("t_shingles").alias("n"), (largest + 2 * step).alias("span"), step.alias("step"))


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The templates that each whole text contains.

    Returns doc_id, template, license, containment (the highest of any window),
    n_windows (windows that reach 0.75) and first_word (where the first of them
    starts), one row for each row of ``docs`` and template found. Texts without
    a template, empty texts and null texts have no row; repeated rows have a row
    each; a null doc_id is carried as it is; templates without words find nothing.
    """
    spark = docs.sparkSession
    out = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, template string, license string, containment double, n_windows long, first_word long"
    markers = marker_words(templates)
    if not markers:
        return spark.createDataFrame([], out)
    table = materialise(template_table(spark, templates), "license_templates")
    # tables of at most MOST_TEMPLATES rows, and what their shingles and bands come to
    small = F.broadcast
    marked = F.lower(F.col(text)).contains(F.lit(markers[0]))
    for word in markers[1:]:
        marked = marked | F.lower(F.col(text)).contains(F.lit(word))
    words = F.filter(F.split(F.lower(F.col(text)), _BREAK), lambda w: w != "")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), _hashes(F.col("words"), w).alias("shingles")) for w in _widths(templates)]))
    held = docs.where(marked).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words.alias("words")).select("row", "doc_id", each.alias("of")).select("row", "doc_id", "of.*")
    held = materialise(held, "license_shingles")
    known = table.select(F.explode("t_shingles").alias("h"), "width", "span", "step").distinct()
    hits = held.select("row", "width", F.posexplode("shingles").alias("at", "h")).join(small(known), ["width", "h"]).select("row", "width", "at", "span", "step").distinct()
    first = F.greatest(F.lit(0), F.floor((F.col("at") - F.col("span")) / F.col("step")) + 1).cast("int")
    windows = hits.select("row", "width", "span", "step", F.explode(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int"))).alias("k")).distinct()
    start = F.col("k") * F.col("step")
    cut = windows.join(held, ["row", "width"]).select("row", "doc_id", "width", "span", start.alias("start"), F.array_distinct(F.slice("shingles", start + 1, F.col("span"))).alias("window"))
    hashed = cut.select("*", F.posexplode(_bands(F.col("window"))).alias("band", "value"))
    t_bands = table.select("template", F.col("width").alias("t_width"), F.col("span").alias("t_span"), F.posexplode(_bands(F.col("t_shingles"))).alias("t_band", "t_value"))
    met = (F.col("width") == F.col("t_width")) & (F.col("span") == F.col("t_span")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value"))
    retrieved = hashed.join(small(t_bands), met).select("row", "doc_id", "start", "window", "template").join(small(table.select("template", "license", "family", "nth", "t_shingles", "n")), "template")
    both = F.size(F.array_intersect("window", "t_shingles"))
    verified = retrieved.select("row", "doc_id", "template", "license", "family", "nth", "start", "n", both.alias("both")).where(F.col("both") * CONTAINED[1] >= F.col("n") * CONTAINED[0]).distinct()
    # the better containment first, then the longer template
    worth = F.col("both") / F.col("n") + F.col("n") * 1e-9 + F.col("nth") * 1e-13
    near = Window.partitionBy("row", "family").orderBy("start").rangeBetween(-NEAR, NEAR)
    best = verified.withColumn("worth", worth).withColumn("best", F.max_by("license", "worth").over(near)).where("license = best")
    return best.groupBy("row", "doc_id", "template", "license").agg(
        F.max(F.col("both") / F.col("n")).alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("start").cast("long").alias("first_word")
    ).drop("row")


def oracle_sql(templates: dict[str, tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL of the same result with every window compared to every template."""
    values = ", ".join(f"('{name}', '{kind}', '{FAMILIES.get(kind, name)}', {nth}, {[*template_words(text)]})" for nth, (name, (kind, text)) in enumerate(sorted(templates.items())))
    shingles = "list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))"
    return rf"""
WITH t0(template, license, family, nth, w) AS (VALUES {values}),
t1 AS (SELECT *, least(5, len(w)) AS s FROM t0),
t2 AS (SELECT template, license, family, nth, list_distinct({shingles}) AS x, CAST(pow(2, ceil(log2(len(w) - s + 1))) AS BIGINT) AS large FROM t1),
t AS (SELECT template, license, family, nth, x, len(x) AS n, large + 2 * greatest(1, large // 4) AS span, greatest(1, large // 4) AS step FROM t2),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, {shingles} AS x FROM w, (SELECT DISTINCT s FROM t1) WHERE len(w) >= s),
u AS (SELECT r, doc_id, unnest(x) AS x, unnest(range(0, len(x))) AS i FROM s),
h AS (SELECT u.r, u.doc_id, u.x, u.i, t.template, t.license, t.family, t.nth, t.n, t.span, t.step FROM u JOIN (SELECT * EXCLUDE (x), unnest(x) AS x FROM t) t USING (x)),
k AS (SELECT *, unnest(range(greatest(0, CAST(floor((i - span) / step) AS BIGINT) + 1), CAST(floor(i / step) AS BIGINT) + 1)) AS k FROM h),
c AS (SELECT r, doc_id, template, license, family, nth, n, k * step AS start, count(DISTINCT x) AS shared FROM k GROUP BY ALL),
v AS (SELECT *, arg_max(license, shared / CAST(n AS DOUBLE) + n * 1e-9::DOUBLE + nth * 1e-13::DOUBLE) OVER (PARTITION BY r, family ORDER BY start RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) AS best FROM c WHERE shared * 100 >= n * 75)
SELECT doc_id, template, license, max(shared / CAST(n AS DOUBLE)) AS containment, count(*) AS n_windows, CAST(min(start) AS BIGINT) AS first_word
FROM v WHERE license = best GROUP BY r, doc_id, template, license
"""
