"""Licence notices in texts by the Dice coefficient of word bigrams (operator 1). DataFrame functions only.

A text is compared as a whole, by paragraphs (between blank lines), by lines and by windows, each
normalised: lower case, letters, digits and dots within them, one spelling of "license". A template
of m words is held against windows of m words, an eighth of m apart over the whole text, so that a
notice is found wherever it stands, within a line, wrapped over several or among comment signs; what is
shifted against its window loses at most a sixteenth of its bigrams at one end. Of overlapping windows that reach the bar for
one template the best is kept, the earliest of equals.

The Dice coefficient of a unit's distinct bigrams and a template's is 2 * common / (a + b); a window has
as many bigrams as places for one, repeated or not. It can reach t only if a lies between b * t / (2 - t)
and b * (2 - t) / t, which leaves few templates for a unit, and only if the unit holds one of the
template's anchor words: so many of its bigrams have one that a unit without them misses too many. Both
bounds are exact, nothing that reaches t is lost. Sizes are tested on words, before bigrams are made.

What units cannot see: a notice of which less than `dice` is left or that is translated; a whole licence
that is longer than the templates (Apache-2.0, MPL-2.0 and the GPL family have their notices here, not
their full texts); names and years within a notice count as words that differ.

Defined cases: null and empty texts match nothing; the best template of a unit counts, ties go to the
smaller name; equal units of a text are one row each; repeated rows and a null doc_id are scanned like any
other; an empty table gives no rows; further columns are not read.
"""

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import picked, table, written
from .spans import let

# The wording of common notices.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Words too common in any text to anchor a template.
COMMON = frozenset("a all and any any are as at be by following for if in is it of on one or that the this to under was with you".split())
DICE = 0.85


def plain(text: str) -> str:
    text = re.sub(r"[^\w.]+|_+", " ", text.lower())
    return re.sub(r"\.+( |$)", r"\1", text).replace("licence", "license").strip()


def bigrams(text: str) -> list[str]:
    words = [w for w in plain(text).split(" ") if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def notices(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str], int]]:
    """(licence, number of the notice, bigrams, words)"""
    return [(name, k, b, len(plain(t).split())) for name in sorted(templates) for k, t in enumerate(templates[name]) if (b := bigrams(t))]


def step_of(words: int) -> int:
    return max(1, words // 8)


def least_common(b: int, dice: float) -> int:
    """Bigrams of a template of b that any unit at its lower size bound has in common with it."""
    return max(1, int(-(-b * dice // (2 - dice))))


def anchors(templates: dict[str, list[str]], dice: float) -> list[str]:
    """Words of which every unit that reaches `dice` with some template holds one."""
    chosen: list[str] = []
    for _, _, grams, _ in sorted(notices(templates), key=lambda x: (len(x[2]), x)):
        left = [g for g in grams if not set(g.split(" ")) & set(chosen)]
        while len(left) >= least_common(len(grams), dice):
            words = Counter(w for g in left for w in g.split(" "))
            best = min(words, key=lambda w: (w in COMMON, -min(len(w), 8), -words[w], w))  # long words are rare in other texts
            chosen.append(best)
            left = [g for g in left if best not in g.split(" ")]
    return sorted(set(chosen))


def normal(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+", " ")
    return F.trim(F.replace(F.regexp_replace(text, r"\.+( |$)", "$1"), F.lit("licence"), F.lit("license")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Each word but the first, behind the one before it."""
    return F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))


def anchored(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, in any case and either spelling."""
    spelled = sorted({s for w in words for s in (w, w.replace("license", "licence"))})
    return let(F.lower(text), lambda low: reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in spelled]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, dice: float = DICE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, unit (text, paragraph, line or window), place (its number in the text, of a window that of its first word), licence, dice, for each unit that reaches `dice`."""
    templates = templates or TEMPLATES
    forms = notices(templates)
    spark = docs.sparkSession
    sizes, marks = [len(g) for _, _, g, _ in forms], anchors(templates, dice)
    low, high = min(sizes) * dice / (2 - dice), max(sizes) * (2 - dice) / dice
    rows = picked(docs, id_column, text_column).toDF("doc_id", "text").filter(anchored(F.col("text"), marks)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "licences-rows")
    # The templates are fixed by the code, so their bigrams are small enough for every task.
    known = F.broadcast(spark.createDataFrame([(g, name, k, len(grams), m, step_of(m)) for name, k, grams, m in forms for g in grams], "gram string, licence string, notice int, b int, m int, step int"))

    def parts(kind: str, pieces: Column) -> Column:
        return F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), x.alias("part")))

    whole = F.concat(parts("line", F.split("text", "\n")), parts("paragraph", F.split("text", r"\n[ \t\r]*\n")), parts("text", F.array("text")))
    units = rows.select("row", "doc_id", F.inline(F.filter(whole, lambda x: anchored(x["part"], marks))))
    # No more distinct words than bigrams, but the first.
    fits = lambda ws: (F.size(ws) - 1 >= low) & (F.size(F.array_distinct(ws)) - 1 <= high)
    grams = let(words_of(F.col("part")), lambda ws: F.when(fits(ws), F.array_distinct(pairs_of(ws))))
    found = units.select("row", "doc_id", "unit", "place", grams.alias("grams")).filter(F.size("grams").between(low, high))
    pairs = found.select("row", "doc_id", "unit", "place", F.size("grams").alias("a"), F.explode("grams").alias("gram")).join(known, "gram")
    pairs = pairs.filter((F.col("a") * (2 - dice) >= F.col("b") * dice) & (F.col("a") * dice <= F.col("b") * (2 - dice)))
    scored = pairs.groupBy("row", "doc_id", "unit", "place", "licence", "notice", "a", "b").agg(F.count("*").alias("common"))
    score = (2 * F.col("common") / (F.col("a") + F.col("b"))).alias("dice")
    scored = scored.select("row", "doc_id", "unit", "place", "licence", score)

    # Windows: each bigram of a template goes to all windows that it stands in.
    spots = rows.select("row", "doc_id", F.inline(let(words_of(F.col("text")), lambda ws: F.transform(pairs_of(ws), lambda g, i: F.struct(F.size(ws).alias("n"), i.alias("at"), g.alias("gram")))))).join(known, "gram")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("at") + 2 - F.col("m")) / F.col("step"))), F.floor(F.col("at") / F.col("step"))
    spots = spots.select("*", F.explode(F.sequence(first, last)).alias("k")).withColumn("place", (F.col("k") * F.col("step")).cast("int"))
    spots = spots.withColumn("a", F.least(F.col("m"), F.col("n") - F.col("place")) - 1)
    windows = spots.groupBy("row", "doc_id", "place", "licence", "notice", "a", "b", "m").agg(F.count_distinct("gram").alias("common")).select("*", score).filter(F.col("dice") >= dice)
    before = Window.partitionBy("row", "licence", "notice").orderBy("place")
    windows = windows.withColumn("new", F.coalesce((F.col("place") - F.lag("place").over(before) >= F.col("m")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(before))
    windows = windows.groupBy("row", "doc_id", "licence", "notice", "run").agg(F.min(F.struct((-F.col("dice")).alias("d"), "place")).alias("w"))
    scored = scored.filter(F.col("dice") >= dice).union(windows.select("row", "doc_id", F.lit("window"), "w.place", "licence", -F.col("w.d")))

    best = scored.groupBy("row", "doc_id", "unit", "place").agg(F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("m"))
    return best.select("doc_id", "unit", "place", F.col("m.licence").alias("licence"), F.round(-F.col("m.d"), 6).alias("dice"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in the documents."""
    return scan(table(spark, sf_dir, "documents"))


def sql(templates: dict[str, list[str]] | None = None, dice: float = DICE) -> str:
    values = ", ".join(f"('{g}', '{name}', {k}, {len(grams)}, {m}, {step_of(m)})" for name, k, grams, m in notices(templates or TEMPLATES) for g in grams)
    return f"""
WITH known(gram, licence, notice, b, m, step) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT row, doc_id, 'line' AS unit, string_split(text, chr(10)) AS parts FROM docs
          UNION ALL SELECT row, doc_id, 'paragraph', string_split_regex(text, '\\n[ \\t\\r]*\\n') FROM docs UNION ALL SELECT row, doc_id, 'text', [text] FROM docs),
units AS (SELECT row, doc_id, unit, unnest(range(len(parts)))::INT AS place, unnest(parts) AS part FROM parts),
words AS (SELECT row, doc_id, unit, place, list_filter(string_split(replace(regexp_replace(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.+( |$)', '\\1', 'g'), 'licence', 'license'), ' '), lambda w: w <> '') AS w FROM units),
grams AS (SELECT row, doc_id, unit, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
pairs AS (SELECT row, doc_id, unit, place, len(g) AS a, unnest(g) AS gram FROM grams),
scored AS (SELECT row, doc_id, unit, place, licence, 2.0::DOUBLE * count(*) / (a + b) AS d FROM pairs JOIN known USING (gram) GROUP BY row, doc_id, unit, place, licence, notice, a, b),
spots AS (SELECT row, doc_id, len(w) AS n, unnest(range(len(w) - 1)) AS spot, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM words WHERE unit = 'text' AND len(w) > 1),
within AS (SELECT row, doc_id, gram, licence, notice, b, m, n, step * unnest(range(greatest(0, ceil((spot + 2 - m) / step))::BIGINT, spot // step + 1)) AS place FROM spots JOIN known USING (gram)),
windows AS (SELECT row, doc_id, place, licence, notice, m, 2.0::DOUBLE * count(DISTINCT gram) / (least(m, n - place) - 1 + b) AS d FROM within GROUP BY row, doc_id, place, licence, notice, b, m, n),
runs AS (SELECT *, sum(new) OVER (PARTITION BY row, licence, notice ORDER BY place) AS run FROM (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY row, licence, notice ORDER BY place) < m THEN 0 ELSE 1 END AS new FROM windows WHERE d >= {dice})),
kept AS (SELECT row, doc_id, unit, place, licence, d FROM scored WHERE d >= {dice} UNION ALL
         SELECT row, doc_id, 'window', place::INT, licence, d FROM (SELECT *, row_number() OVER (PARTITION BY row, licence, notice, run ORDER BY d DESC, place) AS r FROM runs) WHERE r = 1)
SELECT doc_id, unit, place, licence, round(d, 6) AS dice FROM (SELECT *, row_number() OVER (PARTITION BY row, unit, place ORDER BY d DESC, licence) AS r FROM kept) WHERE r = 1
"""
