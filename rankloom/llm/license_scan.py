"""License scans: parts of a text compared with licence templates by Dice over word bigrams.

Texts are normalised to words: A-Z lowered, every run of other characters than a-z and
0-9 is a gap, so comment leaders and line breaks leave no trace. With a and b the numbers
of bigrams of a part and a template, Dice is 2 * common / (a + b), counting repetitions.
Two kinds of parts are compared:

Units are the whole text, its blocks (parted by blank lines), its lines and the sentences
of its lines. As common <= min(a, b), only templates with ``b * t <= a * (2 - t)`` and
``a * t <= b * (2 - t)`` can reach the threshold t; the sizes leave a few candidates
before any bigram is compared.

Windows find a notice wherever it stands: in the middle of a line, wrapped over several, in
a comment between lines of code. A window is as long as its template (at the text's ends
what there is of it) and starts where a bigram of the template, at its own place in it,
occurs in the text. A window leaves before it is compared if it holds too few of the
template's bigrams to reach the threshold. Texts that share no bigram with any template
leave before all that.

The templates are a small fixed table shipped with every task. Per document the best
match counts (highest Dice, then the first template by name); n_units is the number of
different units, and of windows by place and template, that match. No shuffle.

Defined cases: a null or empty text, or one of fewer than two words, matches nothing
(license null, dice 0); repeated rows give repeated results; a null doc_id passes
through; texts of any length are compared whole, one at a time in memory; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.textops import mapped, per_batch

THRESHOLD_PERCENT = 80
#: Notices and licence texts as their publishers word them.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CONDITIONS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [f"{BSD_OPENING} {BSD_CONDITIONS} {BSD_DISCLAIMER}"],
    "BSD-3-Clause": [
        BSD_OPENING,
        f"{BSD_OPENING} {BSD_CONDITIONS} {BSD_THIRD} {BSD_DISCLAIMER}",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "ISC": [ISC_GRANT, f"{ISC_GRANT} {ISC_DISCLAIMER}"],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        MIT_GRANT,
        MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + MIT_DISCLAIMER,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WORD = re.compile(rb"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")


def normal_words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def units(text: str) -> list[str]:
    """The distinct units of a text, the larger first."""
    out = [text, *re.split(r"\n[ \t]*\n", text)]
    for line in text.split("\n"):
        out.append(line)
        out += _SENTENCE.split(line)
    return list(dict.fromkeys(out))


class Template:
    """Bigrams of a template with their numbers, and their places in it."""

    def __init__(self, name: str, text: str):
        w = normal_words(text)
        self.name, self.size, self.grams = name, len(w) - 1, bigrams(w)
        self.places: dict[tuple[bytes, bytes], list[int]] = {}
        for i, g in enumerate(zip(w, w[1:])):
            self.places.setdefault(g, []).append(i)

    def common(self, grams: Counter) -> int:
        return sum(min(n, self.grams[g]) for g, n in grams.items() if g in self.grams)


class Templates:
    """Templates by size, and the bigrams of all of them."""

    def __init__(self, templates: dict[str, list[str]], percent: int):
        self.percent = percent
        self.known = sorted((Template(name, t) for name, texts in templates.items() for t in texts), key=lambda t: (t.size, t.name))
        self.any = {g for t in self.known for g in t.grams}

    def candidates(self, size: int) -> list[Template]:
        p = self.percent
        return [t for t in self.known if t.size * p <= size * (200 - p) and size * p <= t.size * (200 - p)]

    def hit(self, t: Template, grams: Counter, size: int) -> list[tuple[float, str]]:
        common = t.common(grams)
        return [(-2.0 * common / (size + t.size), t.name)] if 200 * common >= self.percent * (size + t.size) else []

    def in_units(self, text: str) -> tuple[list[tuple[float, str]], int]:
        found, matching = [], 0
        largest = self.known[-1].size * (200 - self.percent)
        for unit in units(text):
            own = normal_words(unit)
            if (len(own) - 1) * self.percent > largest or self.any.isdisjoint(zip(own, own[1:])):
                continue
            grams, size = bigrams(own), len(own) - 1
            hits = [h for t in self.candidates(size) for h in self.hit(t, grams, size)]
            matching += bool(hits)
            found += hits
        return found, matching

    def in_windows(self, words: list[bytes]) -> tuple[list[tuple[float, str]], int]:
        grams = [*zip(words, words[1:])]
        known = [(i, g) for i, g in enumerate(grams) if g in self.any]
        found = []
        for t in self.known:
            at = [(i, t.places[g]) for i, g in known if g in t.places]
            # common is at most the number of the template's bigrams in the window
            if len(at) * 200 < self.percent * t.size:
                continue
            occur = [i for i, _ in at]
            for start in {i - q for i, places in at for q in places}:
                low, end = max(start, 0), min(start + t.size, len(grams))
                inside = bisect_left(occur, end) - bisect_left(occur, low)
                if inside * 200 >= self.percent * (end - low + t.size):
                    found += self.hit(t, Counter(grams[low:end]), end - low)
        return found, len(found)

    def best(self, text: str | None) -> tuple[str | None, float, int]:
        """The licence, its Dice and the number of units and windows that match any template."""
        words = normal_words(text) if text else []
        if self.any.isdisjoint(zip(words, words[1:])):
            return None, 0.0, 0
        found, matching = self.in_units(text or "")
        placed, windows = self.in_windows(words)
        found += placed
        if not found:
            return None, 0.0, 0
        dice, name = min(found)
        return name, -dice, matching + windows


@cache
def default_templates(percent: int = THRESHOLD_PERCENT) -> Templates:
    return Templates(TEMPLATES, percent)


def scan(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per document: doc_id, license, dice, n_units."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = default_templates(percent)
        rows = [t.best(x) for x in batch.column(1).to_pylist()]
        name, dice, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "license", "dice", "n_units"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), per_batch(run, 512), f"doc_id {kind}, license string, dice double, n_units long")


def scan_sql(percent: int = THRESHOLD_PERCENT) -> str:
    """The scan in DuckDB SQL, without any pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(t)})" for name, texts in TEMPLATES.items() for t in texts)
    return rf"""
WITH templates AS (SELECT row_number() OVER () AS t, name, body FROM (VALUES {rows}) AS v(name, body)),
pieces AS (
  SELECT doc_id, unnest(list_distinct(list_concat(
           [text], regexp_split_to_array(text, '\n[ \t]*\n'), string_split(text, chr(10)),
           flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(regexp_replace(x, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))))))) AS body
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
units AS (SELECT row_number() OVER () AS u, doc_id, body FROM pieces),
bodies AS (
  SELECT 'u' AS side, u AS id, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM units
  UNION ALL
  SELECT 't', t, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') FROM templates),
sizes AS (SELECT side, id, len(w) - 1 AS n FROM bodies WHERE len(w) >= 2),
grams AS (
  SELECT side, id, g, count(*) AS c FROM (
    SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM bodies WHERE len(w) >= 2) GROUP BY ALL),
common AS (
  SELECT a.id AS u, b.id AS t, sum(least(a.c, b.c)) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.side = 'u' AND b.side = 't' GROUP BY ALL),
unit_hits AS (
  SELECT un.doc_id, 'u' || c.u AS part, te.name, 2.0::DOUBLE * common / (su.n + st.n) AS dice
  FROM common c JOIN sizes su ON su.side = 'u' AND su.id = c.u JOIN sizes st ON st.side = 't' AND st.id = c.t
  JOIN units un ON un.u = c.u JOIN templates te ON te.t = c.t WHERE 200 * common >= {percent} * (su.n + st.n)),
whole AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
placed AS (
  SELECT id, i - 1 AS i, w[i] || ' ' || w[i + 1] AS g, len(w) - 1 AS n FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM whole WHERE len(w) >= 2)),
template_placed AS (
  SELECT id AS t, i - 1 AS q, w[i] || ' ' || w[i + 1] AS g, len(w) - 1 AS n FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM bodies WHERE side = 't')),
near AS (SELECT * FROM placed WHERE g IN (SELECT g FROM template_placed)),
starts AS (
  SELECT DISTINCT p.id, t.t, t.n AS size, greatest(p.i - t.q, 0) AS low, least(p.i - t.q + t.n, p.n) AS high, p.i - t.q AS start FROM near p JOIN template_placed t ON p.g = t.g),
window_common AS (
  SELECT id, t, size, start, low, high, sum(least(c, tc)) AS common FROM (
    SELECT s.id, s.t, s.size, s.start, s.low, s.high, p.g, count(*) AS c, any_value(tg.c) AS tc
    FROM starts s JOIN near p ON p.id = s.id AND p.i >= s.low AND p.i < s.high JOIN grams tg ON tg.side = 't' AND tg.id = s.t AND tg.g = p.g GROUP BY ALL) GROUP BY ALL),
hits AS (
  FROM unit_hits
  UNION ALL SELECT id, 'w' || t || ':' || start, te.name, 2.0::DOUBLE * common / (high - low + size)
  FROM window_common JOIN templates te USING (t) WHERE 200 * common >= {percent} * (high - low + size)),
best AS (
  SELECT doc_id, count(DISTINCT part) AS n_units, max(dice) AS dice FROM hits GROUP BY doc_id),
named AS (SELECT b.doc_id, b.n_units, b.dice, min(h.name) AS license FROM best b JOIN hits h ON h.doc_id = b.doc_id AND h.dice = b.dice GROUP BY ALL)
SELECT d.doc_id, n.license, coalesce(n.dice, 0.0::DOUBLE) AS dice, coalesce(n.n_units, 0)::BIGINT AS n_units
FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id
"""
