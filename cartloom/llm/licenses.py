"""License scans: passages whose word bigrams agree with a license template.

Units of a text are its lines, its paragraphs (between empty lines) and the whole. A unit is
normalised to lower-case ASCII letters and digits separated by single spaces, and compared with
every template by the Dice coefficient over word bigrams, counted with repeats:
2 * common / (bigrams of the unit + bigrams of the template). A coefficient of at least t needs
sizes within a factor of (2 - t) / t, so each template meets units of fitting size only, and units
too small or too long for all templates are dropped before their bigrams are made.

``scan`` has a SQL form and sees these units only. ``passages`` compares every run of words of
the text with every template, so a license is found wherever its text begins and ends.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and license texts as their licensors publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
}

#: Further ones for ``passages``; the SQL form of ``scan`` holds the above.
_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
PASSAGE_TEMPLATES = TEMPLATES | {
    "BSD-2-Clause": f"{_BSD_2} {_AS_IS_BSD}",
    "BSD-3-Clause": f"""{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission. {_AS_IS_BSD}""",
    "GPL-2.0-header": TEMPLATES["GPL-3.0-header"].replace("version 3 of", "version 2 of").replace("free software: you", "free software; you"),
    "LGPL-header": TEMPLATES["GPL-3.0-header"].replace("General Public", "Lesser General Public").replace("program", "library").replace("version 3 of", "version 2.1 of"),
    "AGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("General Public", "Affero General Public"),
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def template_bigrams(templates: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """license, bigram, how often, bigrams of the template; of templates with two words or more."""
    rows = []
    for name, text in templates.items():
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        rows += [(name, p, pairs.count(p), len(pairs)) for p in dict.fromkeys(pairs)]
    return rows


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), "[^a-z0-9]+", " "))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    least: float = 0.8,
) -> DataFrame:
    """A row per row of ``docs`` and license found in it: ``key``, license, dice (of its best
    unit, six digits), units (how many agree).

    Null and empty texts have no units. A passage that is both a line and a paragraph counts as
    both. Repeated rows are scanned each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = template_bigrams(templates)
    known = spark.createDataFrame(rows, "license string, bigram string, m int, total int")
    sizes = [r[3] for r in rows] or [0]
    factor = (2 - least) / least
    low, high = math.ceil(min(sizes) / factor - 1e-9), math.floor(max(sizes) * factor + 1e-9)
    body = F.col("text")
    units = F.concat(F.split(body, "\n"), F.split(body, "\n[ \t\r]*\n"), F.array(body))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    split = source.filter("text IS NOT NULL").select("row", "key", F.posexplode(units).alias("unit", "body"))
    # a word and what separates it from the next take two characters at least
    split = split.filter(F.length("body") >= 2 * low + 1)
    words = split.select("row", "key", "unit", F.split(normalised(F.col("body")), " ").alias("words"))
    size = F.size("words") - 1
    fitting = words.filter((size >= low) & (size <= high)).withColumn("size", size)
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.col("size")), F.slice("words", F.lit(2), F.col("size")), lambda a, b: F.concat_ws(" ", a, b)
    )
    bigrams = fitting.select("row", "key", "unit", "size", F.explode(pairs).alias("bigram"))
    # a few hundred rows of the templates
    met = bigrams.join(F.broadcast(known.select("bigram").distinct()), "bigram")
    counted = met.groupBy("row", "key", "unit", "size", "bigram").agg(F.count("*").alias("n"))
    near = (F.col("size") * factor >= F.col("total") - 1e-9) & (F.col("total") * factor >= F.col("size") - 1e-9)
    common = counted.join(F.broadcast(known), "bigram").filter(near)
    common = common.groupBy("row", "key", "unit", "size", "license", "total").agg(F.sum(F.least("n", "m")).alias("common"))
    dice = (F.lit(2.0) * F.col("common") / (F.col("size") + F.col("total"))).alias("dice")
    scored = common.select("row", "key", "license", dice).filter(F.col("dice") >= least)
    best = scored.groupBy("row", "key", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("units"))
    return best.select(F.col("key").alias(key), "license", F.round("dice", 6).alias("dice"), "units")


class Matcher:
    """Runs of words whose bigrams agree with a template by a coefficient of ``least`` or more."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least, self.licenses, self.of = least, {}, {}
        for name, bigram, m, total in template_bigrams(templates):
            self.licenses.setdefault(name, total)
            a, b = bigram.encode().split(b" ")
            self.of.setdefault((a, b), []).append((name, m))
        self.first = {a for a, _ in self.of}

    def find(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """license, dice of the best passage, its first word, its words, passages that do not
        overlap; of each license found. Words are counted in the normalised text."""
        words = re.findall(rb"[a-z0-9]+", text.encode(errors="replace").lower())
        met: dict[str, list] = {}
        first, of = self.first, self.of
        for i, w in enumerate(words[:-1]):
            if w in first and (hits := of.get((w, words[i + 1]))):
                for name, m in hits:
                    met.setdefault(name, []).append((i, (w, words[i + 1]), m))
        out = []
        for name, places in met.items():
            total = self.licenses[name]
            if len(places) >= self.least * total / (2 - self.least) - 1e-9 and (found := self._runs(places, total)):
                taken: list = []
                for dice, s, e in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                    if all(e < a or b < s for a, b in taken):
                        taken.append((s, e))
                s, e = taken[0]
                best = max(f[0] for f in found)
                out.append((name, round(best, 6), s, e - s + 2, len(taken)))
        return out

    def _runs(self, places: list, total: int) -> list[tuple[float, int, int]]:
        """The best run from each place on: dice, first and last bigram. The best begin and
        end with a bigram of the template; of the longest that fits, the common bigrams bound
        those of all from the same place, so most places are passed over."""
        longest = math.floor(total * (2 - self.least) / self.least + 1e-9)
        needed = self.least * total / (2 - self.least) - 1e-9
        out, inside, common, end = [], Counter(), 0, 0
        for k, (at, bigram, m) in enumerate(places):
            while end < len(places) and places[end][0] < at + longest:
                inside[places[end][1]] += 1
                common += inside[places[end][1]] <= places[end][2]
                end += 1
            if common >= needed:
                seen, both, best = Counter(), 0, (0.0, 0, 0)
                for i, b, n in places[k:end]:
                    seen[b] += 1
                    if seen[b] <= n:
                        both += 1
                        dice = 2 * both / (i - at + 1 + total)
                        if dice > best[0]:
                            best = (dice, at, i)
                if best[0] >= self.least:
                    out.append(best)
            common -= inside[bigram] <= m
            inside[bigram] -= 1
        return out


def passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = PASSAGE_TEMPLATES,
    least: float = 0.8,
) -> DataFrame:
    """A row per row of ``docs`` and license found anywhere in it: ``key``, license, dice (of
    its best passage, six digits), start and n_words (of that passage, in normalised words),
    passages (how many that do not overlap).

    All that ``scan`` finds by the same templates is found, with that coefficient or a higher
    one. Null and empty texts have none, repeated rows are scanned each.
    """
    matcher = Matcher(templates, least)
    kind = docs.select(F.col(key)).schema

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            found = [(k, f) for k, t in enumerate(batch.column(1)) if t.is_valid for f in matcher.find(t.as_py())]
            columns = list(zip(*[f for _, f in found])) or [()] * 5
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            keys = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            arrays = [keys, *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [key, "license", "dice", "start", "n_words", "passages"]
    schema = kind.add("license", "string").add("dice", "double").add("start", "long").add("n_words", "long").add("passages", "long")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def sql(templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> str:
    """The same in SQL, for tables with a unique doc_id."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {m}, {t})" for a, b, m, t in template_bigrams(templates))
    return f"""
WITH templates(license, bigram, m, total) AS (VALUES {values}),
bodies AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT doc_id, text FROM documents WHERE text IS NOT NULL
),
numbered AS (
    SELECT doc_id, row_number() OVER () AS unit,
           string_split(trim(regexp_replace(translate(body, '{_UPPER}', '{_UPPER.lower()}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS words
    FROM bodies
),
bigrams AS (
    SELECT doc_id, unit, len(words) - 1 AS size, unnest(range(1, len(words))) AS i, words FROM numbered WHERE len(words) <= 1000
),
counted AS (
    SELECT doc_id, unit, size, words[i] || ' ' || words[i + 1] AS bigram, count(*) AS n
    FROM bigrams GROUP BY ALL
),
common AS (
    SELECT doc_id, unit, license, 2.0 * sum(least(n, m)) / (size + total) AS dice
    FROM counted JOIN templates USING (bigram) GROUP BY doc_id, unit, size, license, total
)
SELECT doc_id, license, round(CAST(max(dice) AS DOUBLE), 6) AS dice, count(*) AS units
FROM common WHERE dice >= {least} GROUP BY doc_id, license
"""
