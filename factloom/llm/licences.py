"""Licence scans: normalised passages compared to licence templates by Dice coefficient over word bigrams.

The best passage of a text for a template may begin and end anywhere, whatever lines, paragraphs, comment marks or
sentences break there. It begins and ends with bigrams that are also the template's, and taking in one more of those
raises the coefficient unless the template has no more of it to share. So passages begin and end where the text's
shared bigrams do, or next to one that the passage may have too often; no others need to be compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import bind, staged

LEAST_DICE = 0.8

# Public licence notices and usual one-line statements. Blank lines part passages.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)

# Everyday words, taken last when words are chosen that a passage must have.
_EVERYDAY = frozenset("the of to and a in is that for it as with or any by this be not on are at from under you may can its all but".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str) -> list[str]:
    """Words of a template, normalised like those of documents."""
    import re

    return [w for w in re.split(_OTHER, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def bigrams(words: Sequence[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def passages(templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Words of each template as a whole and, where it has several passages, of each."""
    out = []
    for name, text in templates:
        parts = text.split("\n\n")
        out += [(name, plain_words(p)) for p in dict.fromkeys([text, *parts])]
    return [(name, words) for name, words in out if len(words) > 1]


def telling_words(words: Sequence[str], least: float = LEAST_DICE) -> set[str]:
    """Words of which any passage at ``least`` or more has at least one.

    Such a passage shares at least ``least / (2 - least)`` of the template's bigrams. So it has one of any set of
    bigrams larger than the rest, and a word of them: words are taken until their bigrams are that many.
    """
    pairs = bigrams(words)
    need = len(pairs) - _ceil(least / (2 - least) * len(pairs)) + 1
    left, chosen = Counter(pairs), set()
    while len(pairs) - sum(left.values()) < need:
        gain = Counter()
        for (a, b), n in left.items():
            for w in {a, b}:
                gain[w] += n
        best = min(gain, key=lambda w: (w in _EVERYDAY, -gain[w], w))
        chosen.add(best)
        left = Counter({p: n for p, n in left.items() if best not in p})
    return chosen


def _ceil(x: float) -> int:
    return int(-(-round(x, 9) // 1))


def _floor(x: float) -> int:
    return int(round(x, 9) // 1)


def scan(docs: DataFrame, keep: Sequence[str] | None = None, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """The kept columns of each row as ``doc``, with ``licences``: an array of (licence, dice) by name, best passage each.

    docs: ``text``, any other columns. Words are runs of digits, small letters and characters beyond ASCII, A-Z
    lower-cased; bigrams are counted with repeats: dice is twice the shared over the sum of both. A template is
    compared only with passages between ``least / (2 - least)`` and ``(2 - least) / least`` of its size, for others
    cannot reach ``least``, and only with those that have enough of its bigrams, repeats aside. Null and empty texts
    have none; rows stay one by one. Only the templates, a fixed list, are broadcast. A text's shared bigrams, not its words, are grouped by text and template.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    rows, telling = [], set()
    for no, (name, words) in enumerate(passages(templates)):
        pairs = bigrams(words)
        low, high = _ceil(least / (2 - least) * len(pairs)), _floor((2 - least) / least * len(pairs))
        telling |= telling_words(words, least)
        rows += [(no, name, len(pairs), low, high, " ".join(p), n) for p, n in Counter(pairs).items()]
    words = F.filter(F.split(F.translate(F.coalesce(docs["text"], F.lit("")), _UPPER, _LOWER), _OTHER, -1), lambda w: w != "")
    # Words of any passage that is found; other texts are not looked at again.
    gated = lambda w: F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in sorted(telling)])), w).otherwise(F.array().cast("array<string>"))
    base = staged(docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc"), bind(words, gated).alias("w"), F.monotonically_increasing_id().alias("row_no")), "licence-words")
    pair = F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda a, i: F.concat_ws(" ", a, F.element_at("w", i + 2)))
    single = base.where(F.size("w") > 1).select("row_no", F.posexplode(pair).alias("pos", "pair"))
    table = F.broadcast(spark.createDataFrame(rows, "template int, licence string, n_template int, low int, high int, known string, times int"))
    group = ["row_no", "template"]
    met = single.join(table, F.col("pair") == F.col("known")).drop("known")
    counted = met.withColumn("n", F.count("*").over(W.partitionBy(*group))).where(F.col("n") >= F.col("low"))
    hits = staged(counted.withColumn("at", F.row_number().over(W.partitionBy(*group).orderBy("pos"))), "licence-hits")
    # Where a passage may begin or end: its neighbour is not shared, or as often in reach as the template has it.
    same, near = W.partitionBy(*group, "pair").orderBy("pos"), W.partitionBy(*group).orderBy("pos")
    often = sorted({r[-1] for r in rows})
    apart = lambda shift: F.coalesce(*[F.when(F.col("times") == n, shift("pos", n).over(same)) for n in often])
    spare = hits.withColumn("spare_first", apart(F.lead) - F.col("pos") <= F.col("high")).withColumn("spare_last", F.col("pos") - apart(F.lag) <= F.col("high"))
    edge = lambda shift, step, name: F.coalesce((shift("pos", 1).over(near) != F.col("pos") + step) | shift(name, 1).over(near), F.lit(True))
    # Spare or not, a neighbour that is missing settles it; an unknown one next to a shared place does not.
    known = spare.withColumn("spare_first", F.coalesce("spare_first", F.lit(False))).withColumn("spare_last", F.coalesce("spare_last", F.lit(False)))
    edges = known.select(*group, "licence", "n_template", "low", "high", "pos", "at", edge(F.lag, -1, "spare_first").alias("opens"), edge(F.lead, 1, "spare_last").alias("closes"))
    # A passage is no longer than ``high``: its end lies in the stretch of its start or in the next one.
    stretch = F.floor(F.col("pos") / F.col("high"))
    starts = edges.where("opens").select(*group, "licence", "n_template", "low", "high", F.col("pos").alias("start"), F.col("at").alias("first"), stretch.alias("stretch"))
    ends = edges.where("closes").select(*group, F.col("pos").alias("stop"), F.col("at").alias("last"), F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    size = F.col("stop") - F.col("start") + 1
    # No passage shares more than its places with a bigram of the template, nor more than the template has.
    most = F.least(F.col("last") - F.col("first") + 1, F.col("n_template"))
    passage = starts.join(ends, [*group, "stretch"]).where(size.between(F.col("low"), F.col("high")) & (2 * most >= least * (size + F.col("n_template")) - 1e-9))
    inside = passage.drop("stretch").join(hits.select(*group, "pos", "pair", "times"), group).where(F.col("pos").between(F.col("start"), F.col("stop")))
    shared = inside.groupBy(*group, "licence", "n_template", "start", "stop", "pair", "times").agg(F.count("*").alias("n"))
    dice = shared.groupBy(*group, "licence", "n_template", "start", "stop").agg(F.sum(F.least("n", F.col("times").cast("long"))).alias("n")).withColumn("dice", 2.0 * F.col("n") / (size + F.col("n_template")))
    best = dice.where(F.col("dice") >= least).groupBy("row_no", "licence").agg(F.max("dice").alias("dice"))
    found = best.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("licence", "dice"))).alias("licences"))
    none = F.array().cast("array<struct<licence:string,dice:double>>")
    return base.select("doc", "row_no").join(found, "row_no", "left").select("doc", F.coalesce("licences", none).alias("licences"))


def scan_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE) -> str:
    """The same scan over ``documents`` in SQL, without pruning: every passage next to every template."""
    values = ",\n    ".join(
        f"({no}, '{name}', {len(words) - 1}, '{' '.join(p)}', {n})" for no, (name, words) in enumerate(passages(templates)) for p, n in Counter(bigrams(words)).items()
    )
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
with known(template, licence, n_template, pair, times) as (values
    {values}),
worded as (select doc_id, list_filter(string_split_regex({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from documents where text is not null),
pairs as (select doc_id, unnest(range(1, len(w))) as pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as pair from worded where len(w) > 1),
hits as (select doc_id, template, licence, n_template, pos, pair, times from pairs join known using (pair)),
spare as (
  select *, lead(pos, times) over same - pos <= 2 * n_template as spare_first, pos - lag(pos, times) over same <= 2 * n_template as spare_last
  from hits window same as (partition by doc_id, template, pair order by pos)),
edges as (
  select *, lag(pos) over near is distinct from pos - 1 or coalesce(lag(spare_first) over near, false) as opens,
    lead(pos) over near is distinct from pos + 1 or coalesce(lead(spare_last) over near, false) as closes
  from spare window near as (partition by doc_id, template order by pos)),
passages as (
  select a.doc_id, a.template, a.licence, a.n_template, a.pos as start, b.pos as stop, b.pos - a.pos + 1 as size
  from edges a join edges b on a.doc_id = b.doc_id and a.template = b.template and b.pos >= a.pos and b.pos - a.pos < 2 * a.n_template
  where a.opens and b.closes),
counted as (
  select p.doc_id, p.template, p.licence, p.n_template, start, stop, size, pair, times, count(*) as n
  from passages p join hits h on p.doc_id = h.doc_id and p.template = h.template and h.pos between start and stop group by all),
scored as (
  select doc_id, licence, 2.0::double * sum(least(n, times)) / (size + n_template) as dice
  from counted group by doc_id, licence, template, n_template, start, stop, size),
best as (select doc_id, licence, max(dice) as dice from scored where dice >= {least} group by doc_id, licence),
listed as (select doc_id, count(*) as n, string_agg(licence || ':' || cast(round(dice * 1000000)::bigint as varchar), ',' order by licence) as licences from best group by doc_id)
select d.doc_id, coalesce(l.n, 0) as n_licences, coalesce(l.licences, '') as licences from documents d left join listed l on d.doc_id = l.doc_id
"""
