"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Lower-cased runs of a-z and 0-9 are words. The coefficient of two texts with word bigrams A and B (repeats counted) is
``2 |A and B| / (|A| + |B|)``. It can only reach t if ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``; so a text is only compared with
templates whose size is in that range, and texts that fit no template never get bigrams at all.

What is compared are units (lines, paragraphs, whole texts) and windows: all stretches of as many words as a template has, so that a header
above code and a notice inside a sentence are found. Of a text's windows only those that begin with a bigram of the template, and the
text's last, can be best, and of these only those with enough of its bigrams are compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

#: Licence notices and short licence texts (fixed values), by public licence identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
}

WORD = "[a-z0-9]+"
SEP = "[^a-z0-9]+"
THRESHOLD = 0.8


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(c), SEP, " "))


def bigram_counts(text: str) -> Counter:
    words = re.findall(WORD, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams that a text may have to reach the threshold against n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _is(value: str):
    return lambda x: x == value


def _against(bigrams: Column, template: Counter) -> Column:
    """Dice of an array of bigrams and one template. Only templates that repeat a bigram need counts."""
    n = sum(template.values())
    own = F.array(*[F.lit(b) for b in template])
    shared = F.size(F.array_intersect(bigrams, own))
    for b, k in template.items():
        if k > 1:
            same = F.size(F.filter(bigrams, _is(b)))
            shared = shared + F.greatest(F.lit(0), F.least(F.lit(k), same) - 1)
    return F.lit(2.0) * shared / (F.size(bigrams) + F.lit(n))


def telling_words(template: Counter, threshold: float) -> set[str]:
    """Words of which any text that reaches the threshold has one.

    Such a text shares at least ``t / (2 - t)`` of the template's bigrams. The longest words are taken until the bigrams
    without any of them are fewer than that.
    """
    need, words = sum(template.values()) * threshold / (2 - threshold), set()
    for w in sorted({w for b in template for w in b.split()}, key=lambda w: (-len(w), w)):
        if sum(k for b, k in template.items() if not words & set(b.split())) < need:
            break
        words.add(w)
    return words


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Compares every line, every paragraph between blank lines, the whole of every text, and every window with the templates.

    Returns one row per input row: doc_id, n_units (distinct units that match some template), windows (name, start, dice: for each
    template that some window matches, the best one, ties to the first; start is the number of its first word), licenses (the distinct
    identifiers of both, sorted), best_license and best_dice (null if none matches; ties go to the first identifier). Notices that differ in a few
    words only (those of the GNU licences) are each told when they are at the threshold; the best is the one that is meant. Null and empty
    texts match nothing; repeated rows are each scanned; other columns are ignored. It is one projection: no shuffle.
    """
    known = sorted(((name, bigram_counts(t)) for name, ts in templates.items() for t in ts), key=lambda x: x[0])
    known = [(name, c, *size_bounds(sum(c.values()), threshold)) for name, c in known if c]
    if not known:
        raise ValueError("no template has two words")
    telling = F.array(*[F.lit(w) for w in sorted(set().union(*(telling_words(c, threshold) for _, c, _, _ in known)))])
    has_one = lambda u: F.arrays_overlap(F.split(u, " "), telling)
    # A text of n words has n - 1 bigrams: n - 1 blanks in normal form.
    blanks = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    sized = lambda u: F.lit(False) if not known else _any(blanks(u).between(a, b) for a, b in sorted({(k[2], k[3]) for k in known}))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    rows = rows.select("doc_id", F.when(has_one(normalise(F.col("raw"))), F.col("raw")).alias("raw"))  # the rest match nothing
    rows = rows.select("doc_id", F.transform(F.split("raw", "\n"), normalise).alias("lines"))
    rows = rows.select("doc_id", "lines", F.split(F.array_join("lines", "\n"), "\n\n+").alias("blocks"))
    flat = lambda b: F.trim(F.regexp_replace(b, "\n+", " "))
    units = F.concat("lines", F.transform("blocks", flat), F.array(flat(F.array_join("blocks", "\n"))))
    rows = rows.select("doc_id", F.array_distinct(F.filter(units, lambda u: has_one(u) & sized(u))).alias("units"), F.split(flat(F.array_join("blocks", "\n")), " ").alias("words"))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    no_texts = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id", F.coalesce(F.transform("units", lambda u: pairs(F.split(u, " "))), F.array().cast("array<array<string>>")).alias("units"),
        F.coalesce(F.when(F.size("words") > 1, pairs(F.col("words"))), no_texts).alias("grams"),
    )
    every = sorted(set().union(*(c for _, c, _, _ in known)))
    placed = F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram")))
    rows = rows.select("doc_id", "units", "grams", F.filter(placed, lambda x: x["gram"].isin(every)).alias("hits"))

    def found(u: Column) -> Column:
        scores = [F.when(F.size(u).between(a, b), F.struct(_against(u, c).alias("dice"), F.lit(name).alias("name"))) for name, c, a, b in known]
        return F.filter(F.array(*scores), lambda s: s["dice"] >= threshold)

    def window(name: str, template: Counter) -> Column:
        """The best window of a text, or null."""
        m = sum(template.values())
        k = math.ceil(m * threshold - 1e-9)  # of the template's bigrams a window has at least so many
        last = F.size("grams") - m

        def best_of(at: Column) -> Column:
            starts = F.filter(at, lambda p, i: (p <= last) & (F.get(at, i + (k - 1)) < p + m))
            at_end = F.when((last >= 0) & (F.size(F.filter(at, lambda p: p >= last)) >= k), F.array(last)).otherwise(F.array().cast("array<int>"))
            scores = F.transform(F.concat(starts, at_end), lambda p: F.struct(_against(F.slice(F.col("grams"), p + 1, m), template).alias("dice"), (-p).alias("before")))
            return F.array_max(F.filter(scores, lambda x: x["dice"] >= threshold))

        at = F.transform(F.filter("hits", lambda x: x["gram"].isin(sorted(template))), lambda x: x["at"])
        best = F.get(F.transform(F.array(at), best_of), F.lit(0))  # bound once, not once a use
        return F.transform(F.filter(F.array(best), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(name).alias("name"), (-x["before"]).alias("start"), x["dice"].alias("dice")))

    windows = F.when(F.size("hits") > 0, F.concat(*[window(name, c) for name, c, _, _ in known]))
    no_windows = F.array().cast("array<struct<name: string, start: int, dice: double>>")
    rows = rows.select("doc_id", F.filter(F.transform("units", found), lambda m: F.size(m) > 0).alias("units"), F.coalesce(windows, no_windows).alias("windows"))
    of_windows = F.transform("windows", lambda w: F.struct(w["dice"].alias("dice"), w["name"].alias("name")))
    rows = rows.select("doc_id", "windows", F.size("units").alias("n_units"), F.concat(F.flatten("units"), of_windows).alias("found"))
    best = F.array_max(F.transform("found", lambda s: s["dice"]))
    return rows.select(
        "doc_id", F.col("n_units").cast("bigint").alias("n_units"), "windows",
        F.array_sort(F.array_distinct(F.transform("found", lambda s: s["name"]))).alias("licenses"),
        F.array_min(F.transform(F.filter("found", lambda s: s["dice"] == best), lambda s: s["name"])).alias("best_license"),
        best.alias("best_dice"),
    )


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_units", F.size("windows").cast("bigint").alias("n_windows"), F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")


def _sql() -> str:
    rows = []
    for name, texts in sorted(TEMPLATES.items()):
        for i, t in enumerate(texts):
            rows += [f"('{name}', '{name}/{i}', '{b}', {k})" for b, k in bigram_counts(t).items()]
    return rf"""
WITH tb(name, tid, bigram, k) AS (VALUES {", ".join(rows)}),
tn AS (SELECT name, tid, sum(k) AS n FROM tb GROUP BY name, tid),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, list_transform(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)),
             lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS lines FROM d),
b AS (SELECT rid, lines, regexp_split_to_array(array_to_string(lines, chr(10)), '

+') AS blocks FROM l),
u AS (SELECT DISTINCT rid, unnest(list_concat(list_concat(lines, list_transform(blocks, lambda x: trim(regexp_replace(x, '
+', ' ', 'g')))),
             [trim(regexp_replace(array_to_string(blocks, chr(10)), '
+', ' ', 'g'))])) AS unit FROM b),
w AS (SELECT row_number() OVER () AS uid, rid, string_split(unit, ' ') AS words FROM u WHERE unit <> ''),
g AS (SELECT uid, rid, len(words) - 1 AS n, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram
      FROM w WHERE len(words) BETWEEN 2 AND {max(size_bounds(sum(bigram_counts(t).values()), THRESHOLD)[1] for ts in TEMPLATES.values() for t in ts) + 1}),
c AS (SELECT uid, rid, n, bigram, count(*) AS k FROM g GROUP BY ALL),
s AS (SELECT c.uid, c.rid, tb.name, tb.tid, 2.0::DOUBLE * sum(least(c.k, tb.k)) / (any_value(c.n) + any_value(tn.n)) AS dice
      FROM c JOIN tb USING (bigram) JOIN tn USING (tid) GROUP BY c.uid, c.rid, tb.name, tb.tid),
m AS (SELECT * FROM s WHERE dice >= {THRESHOLD}),
f AS (SELECT rid, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM d),
a AS (SELECT rid, len(words) - 1 AS size, unnest(range(1, len(words))) AS i, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram FROM f),
h AS (SELECT a.rid, a.size, a.i, a.bigram, tb.name, tb.tid, tb.k, tn.n FROM a JOIN tb USING (bigram) JOIN tn USING (tid)),
o AS (SELECT DISTINCT rid, tid, i FROM h WHERE i + n - 1 <= size UNION SELECT DISTINCT rid, tid, size - n + 1 FROM h WHERE n <= size),
q AS (SELECT o.rid, o.tid, o.i, h.name, h.n, h.bigram, least(count(*), h.k) AS shared
      FROM o JOIN h ON h.rid = o.rid AND h.tid = o.tid AND h.i BETWEEN o.i AND o.i + h.n - 1 GROUP BY o.rid, o.tid, o.i, h.name, h.n, h.bigram, h.k),
v AS (SELECT rid, tid, i, name, 2.0::DOUBLE * sum(shared) / (n + n) AS dice FROM q GROUP BY rid, tid, i, name, n HAVING sum(shared) >= {THRESHOLD} * n - 1e-9),
e AS (SELECT rid, name, dice, uid, NULL AS tid FROM m UNION ALL SELECT rid, name, dice, NULL, tid FROM v),
r AS (SELECT rid, count(DISTINCT uid) AS n_units, count(DISTINCT tid) AS n_windows, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best_dice FROM e GROUP BY rid),
x AS (SELECT e.rid, min(name) AS best_license FROM e JOIN r ON e.rid = r.rid AND e.dice = r.best_dice GROUP BY e.rid)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_windows, 0)::BIGINT AS n_windows, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM d LEFT JOIN r USING (rid) LEFT JOIN x USING (rid)
"""


OP10_SQL = _sql()
