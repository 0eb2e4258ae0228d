"""Licence scans: texts and their lines against licence templates, by the Dice coefficient of word bigrams.

Besides, runs of words inside a text are compared, across line ends.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Public licence notices.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_GRANT = TEMPLATES["MIT"]
_NO_WARRANTY = 'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
_DEALINGS = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# Whole licences. Those in files are as Debian hands them out.
FULL_TEXTS = {
    "MIT-text": f"{_GRANT} {_AS_IS} OR COPYRIGHT HOLDERS {_DEALINGS}",
    "BSD-2-Clause-text": f"{_BSD} THIS SOFTWARE {_NO_WARRANTY}",
    "BSD-3-Clause-text": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE {_NO_WARRANTY}",
    "ISC-text": TEMPLATES["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense-text": TEMPLATES["Unlicense"] + f" In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} {_DEALINGS} For more information, please refer to <http://unlicense.org/>",
} | {f"{f.stem}-text": f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
SIMILARITY = 0.8
# a-z and 0-9 stand for themselves, A-Z for a-z, a newline for itself, all else for a space.
_FOLD = bytes(c if chr(c).isascii() and (chr(c).islower() or chr(c).isdigit()) or c == 10 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def fold(text: str) -> bytes:
    return text.encode().translate(_FOLD)


class Matcher:
    """Templates by the number of their bigrams: Dice of at least s needs sizes within a factor (2 - s) / s."""

    def __init__(self, templates: dict[str, str], similarity: float):
        self.sets = {k: bigrams(fold(t).split()) for k, t in templates.items()}
        self.similarity, self.factor = similarity, (2 - similarity) / similarity
        self.all = set().union(*self.sets.values())
        self.largest = max(map(len, self.sets.values()), default=0) * self.factor

    def match(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(licence, Dice) of the templates that are similar enough."""
        own = bigrams(words)
        n = len(own)
        if not n or n > self.largest:
            return []
        shared = own & self.all
        if not shared:
            return []
        out = []
        for name, theirs in self.sets.items():
            m = len(theirs)
            if n <= m * self.factor and m <= n * self.factor:
                dice = 2 * len(shared & theirs) / (n + m)
                if dice >= self.similarity:
                    out.append((name, dice))
        return out


class Finder:
    """Runs of words inside a text that are similar enough to a template.

    Shared less (similarity / 2) * own bigrams must reach (similarity / 2) * the template's, both counted once. A run begins
    and ends with a shared bigram, as others only lower it, and is of at most factor times the template's words. Inside
    a line that is within the size bounds itself no run is sought: that line was compared as a whole.
    """

    def __init__(self, templates: dict[str, str], matcher: Matcher):
        self.weight = matcher.similarity / 2
        self.words: dict[bytes, int] = {}
        codes = {}
        for name, text in templates.items():
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in fold(text).split()], np.int64)
            codes[name] = ids
        self.span = len(self.words) + 1
        codes = {k: v[:-1] * self.span + v[1:] for k, v in codes.items()}
        self.known = np.unique(np.concatenate([np.empty(0, np.int64), *codes.values()]))
        self.names, self.sizes = list(codes), np.array([len(np.unique(c)) for c in codes.values()])
        self.reach = [int(len(c) * matcher.factor) for c in codes.values()]
        self.member = np.array([np.isin(self.known, c) for c in codes.values()]).T
        # n >= m / factor and shared >= weight * (n + m)
        self.need = np.ceil(self.weight * (self.sizes + self.sizes / matcher.factor) - 1e-9)
        self.similarity, self.factor = matcher.similarity, matcher.factor

    def find(self, words: list[bytes], taken: dict[str, list[tuple[int, int]]], lines: list[tuple[int, int]] = ()) -> list[tuple[str, float]]:
        """(licence, Dice) of runs that meet neither each other nor what is ``taken`` (first and last word) by the same template.

        ``lines`` has the number of words and of bigrams of each line.
        """
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        if len(ids) < 2 or not len(self.known):
            return []
        code = ids[:-1] * self.span + ids[1:]
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        row = np.minimum(np.searchsorted(self.known, code[at]), len(self.known) - 1)
        hit = self.known[row] == code[at]
        at, row = at[hit], row[hit]
        if len(at) < self.need.min():
            return []
        likely = np.flatnonzero(self.member[np.unique(row)].sum(axis=0) >= self.need)
        if not len(likely):
            return []
        last, before = {}, np.empty(len(words) - 1, np.int64)  # where the same bigram was last
        for i, pair in enumerate(zip(words, words[1:])):
            before[i] = last.get(pair, -1)
            last[pair] = i
        ends = np.repeat(np.cumsum([k for k, _ in lines], dtype=np.int64) - 1, [k for k, _ in lines]) if lines else np.zeros(len(words), np.int64)
        within = np.repeat([n for _, n in lines], [k for k, _ in lines]) if lines else np.full(len(words), len(words))
        out = []
        for t in likely:
            own = at[self.member[row, t]]
            shared = np.zeros(len(before), bool)
            shared[own] = True
            edges = sorted(taken.get(self.names[t], []))
            free, start = [], 0
            for a, b in edges:
                free.append((start, a - 1))
                start = max(start, b + 1)
            free.append((start, len(before)))
            while free:
                lo, hi = free.pop()
                best = self.best(own[np.searchsorted(own, lo):np.searchsorted(own, hi)], shared, before, hi, t, ends, within <= self.sizes[t] * self.factor)
                if best:
                    dice, a, b = best
                    out.append((self.names[t], dice))
                    free += [(lo, a - 1), (b + 2, hi)]
        return out

    def best(self, own: np.ndarray, shared: np.ndarray, before: np.ndarray, end: int, t: int, ends: np.ndarray, judged: np.ndarray) -> tuple[float, int, int] | None:
        """(Dice, first, last bigram) of the closest run, the earliest of several; all starts that can reach the least are tried."""
        reach, m, found = self.reach[t], self.sizes[t], None
        enough = np.searchsorted(own, own + reach) - np.arange(len(own)) >= self.need[t]
        for i in own[enough]:
            stop = min(i + reach, end)
            new = before[i:stop] < i
            n, s = np.cumsum(new), np.cumsum(new & shared[i:stop])
            dice = 2 * s / (n + m)
            if judged[i]:
                dice[:max(0, ends[i] - i)] = 0
            k = int(np.argmax(dice))
            if dice[k] >= self.similarity and (found is None or dice[k] > found[0]):
                found = float(dice[k]), int(i), int(i) + k
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, licences, n_places, best, score`` of every row: what is found, in how many places, and the closest one.

    The whole text, each of its lines and runs of words across lines are compared with notices and whole licences; words
    are runs of a-z and 0-9 with A-Z lowered, bigrams count once. ``n_places`` is the number of similar pairs of a line and a
    template, plus that of the whole text of more than one line, plus that of runs (see ``Finder``) outside what
    the same template has been found in. Ties of ``best`` go to the smaller name. Null and empty texts, and clean ones, have no
    licences, no best and score 0. Other columns are not read; rows that repeat are rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast((templates or TEMPLATES | FULL_TEXTS, similarity))

    def run(batches):
        matcher = Matcher(*shared.value)
        finder = Finder(shared.value[0], matcher)
        kinds = [pa.list_(pa.string()), pa.int64(), pa.string(), pa.float64()]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                lines = fold(text).split(b"\n") if text else []
                found, taken, words, sizes = [], {}, [], []
                for line in lines:
                    own = line.split()
                    for m in matcher.match(own):
                        found.append(m)
                        taken.setdefault(m[0], []).append((len(words), len(words) + len(own) - 1))
                    words += own
                    sizes.append((len(own), len(bigrams(own))))
                if len(lines) > 1:
                    for m in matcher.match(words):
                        found.append(m)
                        taken.setdefault(m[0], []).append((0, len(words) - 1))
                found += finder.find(words, taken, sizes)
                best = min(found, key=lambda m: (-m[1], m[0]), default=(None, 0.0))
                rows.append((sorted({m[0] for m in found}), len(found), *best))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "licences", "n_places", "best", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licences array<string>, n_places long, best string, score double")


def oracle_sql() -> str:
    """The same over ``documents`` in SQL, with the licences comma-joined and the score rounded to 9 digits."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in TEMPLATES.items())
    pairs = lambda col: f"""list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"""
    words = lambda col: f"regexp_extract_all(translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
with templates(name, text) as (values {values}),
t as (select name, {pairs('w')} as b from (select name, {words('text')} as w from templates)),
units as (select doc_id, unnest(string_split(text, chr(10))) as unit from documents where text is not null
    union all select doc_id, text from documents where contains(text, chr(10))),
u as (select doc_id, {pairs('w')} as b from (select doc_id, {words('unit')} as w from units)),
m as (select doc_id, name, 2 * len(list_intersect(u.b, t.b)) / cast(len(u.b) + len(t.b) as double) as dice
    from u join t on len(u.b) > 0 and len(u.b) <= len(t.b) * 1.5 and len(t.b) <= len(u.b) * 1.5),
g as (select doc_id, string_agg(distinct name, ',' order by name) as licences, count(*) as n_places, max(dice) as score, arg_min(name, (-dice, name)) as best
    from m where dice >= {SIMILARITY} group by doc_id)
select d.doc_id, coalesce(g.licences, '') as licences, coalesce(g.n_places, 0) as n_places, g.best as best, round(coalesce(g.score, 0.0), 9) as score
from documents d left join g using (doc_id)"""
