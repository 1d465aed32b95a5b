"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised to words, across lines and punctuation, and compared with licence templates: twice the common
bigrams over the sum of both sets. A notice may stand anywhere in a text, wrapped in lines or among other prose, so
what is compared is a window of as many words as the template has. A short list of words is derived from the templates
such that every set of bigrams close enough to a template has one of them in a common bigram. Where such a word stands
in the text and in the template, the two are laid over each other, which gives the window; every such place is tried.
For a coefficient of ``LEAST`` or more the sizes of the sets must lie within a factor of each other, which prunes
templates too long for a text; texts with none of the words go before they are split.

Defined cases: null and empty texts match nothing; a text shorter than the template is one window; of equal
coefficients the first window counts; rows are scanned one by one, without a shuffle, so repeated rows come out
repeated; rows without doc_id keep a null one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Notices of public licences, word for word.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> list[str]:
    """Words such that every set of bigrams close enough to a template has one of them in a common bigram."""
    chosen: set[str] = set()
    for text in templates.values():
        grams = bigrams_of(text)
        need = math.ceil(least * len(grams) / (2 - least) - 1e-9)  # fewest common bigrams of a match
        left = [g for g in grams if not chosen & set(g.split())]
        while len(left) >= max(need, 1):
            counts: dict[str, int] = {}
            for g in left:
                for w in set(g.split()):
                    counts[w] = counts.get(w, 0) + 1
            best = max(counts, key=lambda w: (len(w) > 4, counts[w], len(w), w))
            chosen.add(best)
            left = [g for g in left if best not in g.split()]
    return sorted(chosen)


def places(text: str, words: list[str]) -> list[tuple[str, int]]:
    """Where the words stand in a template, from 0."""
    return [(w, k) for k, w in enumerate(words_of(text)) if w in set(words)]


def _templates(templates: dict[str, str], words: list[str]) -> Column:
    each = []
    for name, text in templates.items():
        at = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("at")) for w, k in places(text, words)))
        each.append(F.struct(F.lit(name).alias("license"), F.lit(len(words_of(text))).alias("k"), F.array(*map(F.lit, bigrams_of(text))).alias("grams"), at.alias("places")))
    return F.array(*each)


def _dice(window: Column, grams: Column) -> Column:
    pairs = F.array_distinct(F.zip_with(F.slice(window, 1, F.size(window) - 1), F.slice(window, 2, F.size(window)), lambda a, b: F.concat_ws(" ", a, b)))
    own = F.filter(pairs, lambda g: g.contains(" "))  # the last word has no pair
    both = F.struct(F.size(F.array_intersect(own, grams)).alias("common"), F.size(own).alias("n"))
    return F.element_at(F.transform(F.array(both), lambda x: 2.0 * x["common"] / (x["n"] + F.size(grams))), 1)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words): each licence found in a row, and the window where it fits best."""
    chosen = anchors(templates, least)
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    rows = docs.select("doc_id", plain.alias("plain")).where(F.col("plain").rlike(" (?:" + "|".join(chosen) + ") "))
    rows = rows.select("doc_id", F.split(F.trim("plain"), " ").alias("w"))
    known = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda p: p["w"].isin(chosen))
    rows = rows.select("doc_id", "w", known.alias("known")).where(F.size("w") > 1)
    factor = least / (2 - least)
    fits = lambda t: F.size("w") - 1 >= F.size(t["grams"]) * factor - 1e-9
    near = F.filter(_templates(templates, chosen), lambda t: fits(t) & F.exists(t["places"], lambda p: F.exists("known", lambda q: q["w"] == p["w"])))
    rows = rows.select("doc_id", "w", "known", F.explode(near).alias("t"))
    begin = lambda q, p: F.greatest(F.lit(0), F.least(q["i"] - p["at"], F.size("w") - F.col("t.k")))
    starts = F.flatten(F.transform("t.places", lambda p: F.transform(F.filter("known", lambda q: q["w"] == p["w"]), lambda q: begin(q, p))))
    windows = F.transform(F.array_distinct(starts), lambda s: F.struct(_dice(F.slice("w", s + 1, F.col("t.k")), F.col("t.grams")).alias("dice"), (-s).alias("s")))
    best = rows.select("doc_id", "t.license", "t.k", F.size("w").alias("n"), F.array_max(windows).alias("b")).where(F.col("b.dice") >= least)
    return best.select("doc_id", "license", F.round("b.dice", 9).alias("dice"), (-F.col("b.s")).alias("first_word"), F.least("k", "n").alias("n_words"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_template(name: str, text: str) -> str:
    at = ", ".join(f"{{'w': {_quoted(w)}, 'pos': {k}}}" for w, k in places(text, anchors()))
    return f"({_quoted(name)}, {len(words_of(text))}, [{', '.join(map(_quoted, bigrams_of(text)))}], [{at}])"


ORACLE = f"""
WITH template(license, k, grams, places) AS (VALUES {", ".join(_sql_template(n, t) for n, t in TEMPLATES.items())}),
docs AS (
  SELECT row_number() OVER () AS own, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM documents),
known AS (SELECT own, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM docs),
place AS (SELECT license, k, unnest(places, max_depth := 2) FROM template),
starts AS (
  SELECT DISTINCT own, license, greatest(0, least(i - pos, len(docs.w) - k)) AS s
  FROM known JOIN place ON known.w = place.w JOIN docs USING (own)),
windows AS (
  SELECT own, license, s, list_slice(docs.w, s + 1, s + k) AS x, template.grams AS grams
  FROM starts JOIN template USING (license) JOIN docs USING (own)
  WHERE len(docs.w) > 1 AND len(docs.w) - 1 >= len(template.grams) * {LEAST} / (2 - {LEAST}) - 1e-9),
scored AS (
  SELECT own, license, s, len(x) AS n, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS g, grams
  FROM windows),
found AS (
  SELECT own, license, n, s, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY own, license ORDER BY dice DESC, s) AS turn FROM found WHERE dice >= {LEAST})
SELECT doc_id, license, round(dice, 9) AS dice, CAST(s AS INTEGER) AS first_word, CAST(n AS INTEGER) AS n_words
FROM best JOIN docs USING (own) WHERE turn = 1
"""
