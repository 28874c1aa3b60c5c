"""License scans: normalised text against licence templates, by the Dice coefficient over word bigrams.

Texts are lower-cased and cut into words of letters a-z and digits. With windows, every run of words is compared,
wherever lines, comment marks or carriage returns stand. Only texts with enough bigrams of a template are looked at
closely; there runs start and end at bigrams of the template, and a run grows until it cannot reach the threshold or
its first bigram returns, where a later start does as well. So no run that could match is left out, and the work on
a text grows with its length times the template's size at most. Of runs of one template that overlap, the best
counts; a run of a smaller template within it is dropped unless it is whole lines.

Without windows, the units compared are the lines of a text, its paragraphs (runs of lines between empty ones) and
the whole text. Two bigram sets of sizes a and b have a Dice coefficient of at most 2 min(a, b) / (a + b), so a unit
meets only the templates whose size is within bounds, and units beyond all bounds are not even cut into bigrams.
Work is per row in Arrow batches: no shuffle.

Defined cases: null texts and texts without two words in a row have no licence and score 0; of equal scores
the template first by name wins; repeated rows get equal results; empty tables give empty results; without
templates nothing has a licence.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
WORDS = re.compile(r"[a-z0-9]+")

# Well-known licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
    "SUCH DAMAGE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE '
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def full_texts() -> dict[str, str]:
    """Whole licences: short ones from here, long ones from the folder license_texts."""
    short = {
        "bsd-2-clause": _BSD_CLAUSES + _BSD_WARRANTY,
        "bsd-3-clause": _BSD_CLAUSES + _BSD_NAMES + _BSD_WARRANTY,
        "isc-text": TEMPLATES["isc"] + " " + _ISC_WARRANTY,
        "mit-text": TEMPLATES["mit-notice"] + " " + _MIT_WARRANTY,
    }
    folder = resources.files(__package__) / "license_texts"
    return short | {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Templates:
    """Bigram sets of the templates by bigram, and the unit sizes at which each can reach the threshold."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.names, self.threshold = sorted(texts), threshold
        sets = [bigrams(words_of(texts[n])) for n in self.names]
        self.sizes = [len(s) for s in sets]
        self.bounds = [(threshold / (2 - threshold) * n - 1e-9, (2 - threshold) / threshold * n + 1e-9) for n in self.sizes]
        self.least = min((lo for lo, _ in self.bounds), default=1)
        self.most = max((hi for _, hi in self.bounds), default=0)
        self.having: dict[tuple[str, str], list[int]] = {}
        for k, s in enumerate(sets):
            for b in s:
                self.having.setdefault(b, []).append(k)
        self.sets = sets
        self.words = {w for b in self.having for w in b}

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """Score and name of the best template of a unit that reaches the threshold."""
        # A unit has at most as many distinct bigrams as word pairs.
        if len(words) - 1 < self.least:
            return None
        own = bigrams(words)
        n = len(own)
        if n > self.most or not any(lo <= n <= hi for lo, hi in self.bounds):
            return None
        shared = Counter(k for b in own if b in self.having for k in self.having[b])
        found = [(2.0 * c / (n + self.sizes[k]), k) for k, c in shared.items() if self.bounds[k][0] <= n <= self.bounds[k][1]]
        score, k = max(found, key=lambda x: (x[0], -x[1]), default=(0.0, 0))
        return (score, self.names[k]) if score >= self.threshold else None


    def runs(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """score, template, first and last word of the best of the overlapping runs of words that match a template."""
        known = list(map(self.words.__contains__, words))
        hits = [p for p, (a, b) in enumerate(zip(known, known[1:], strict=False)) if a and b and (words[p], words[p + 1]) in self.having]
        shared = Counter(k for b in {(words[p], words[p + 1]) for p in hits} for k in self.having[b])
        # A run has as many bigrams as it shares at least: 2 c / (c + size) bounds its score.
        near = [k for k, c in shared.items() if 2.0 * c / (c + self.sizes[k]) >= self.threshold - 1e-9]
        if not near:
            return []
        number: dict[tuple[str, str], int] = {}
        codes = [number.setdefault(b, len(number)) for b in zip(words, words[1:], strict=False)]
        return [x for k in sorted(near) for x in self._runs_of(k, codes, {number[b] for b in self.sets[k] if b in number}, hits)]

    def _runs_of(self, k: int, codes: list[int], own: set[int], hits: list[int]) -> list[tuple[float, int, int, int]]:
        size, found, held = self.sizes[k], [], None
        starts = [p for p in hits if codes[p] in own]
        # Distinct bigrams of the template from each start to the end of the text.
        ahead, seen = [], set()
        for p in reversed(starts):
            seen.add(codes[p])
            ahead.append(len(seen))
        for p, most in zip(starts, reversed(ahead), strict=True):
            if held and p > held[3] - 1:
                found.append(held)
                held = None
            seen, shared, first = set(), 0, codes[p]
            for q in range(p, len(codes)):
                x = codes[q]
                if x in seen:
                    if x == first:
                        break
                    continue
                seen.add(x)
                if x in own:
                    shared += 1
                    score = 2.0 * shared / (len(seen) + size)
                    if score > held[0] if held else score >= self.threshold:
                        held = (score, k, p, q + 1)
                other = len(seen) - shared
                bound = 2.0 * most / (most + other + size)
                if bound <= held[0] if held else bound < self.threshold - 1e-9:
                    break
        return [*found, held] if held else found


def scan_windows(text: str | None, templates: Templates) -> list[tuple[float, str, int, int]]:
    """score, licence, first and last line of the runs of words that match, best first."""
    runs = templates.runs(words_of(text or ""))
    if not runs:
        return []
    line = [i for i, x in enumerate(text.split("\n")) for _ in words_of(x)]
    whole = lambda a, b: (a == 0 or line[a - 1] < line[a]) and (b == len(line) - 1 or line[b] < line[b + 1])
    by: dict[int, list[tuple[int, int]]] = {}
    for _, k, a, b in runs:
        by.setdefault(k, []).append((a, b))

    def inside(k: int, a: int, b: int) -> bool:
        for other, spans in by.items():
            if templates.sizes[other] > templates.sizes[k]:
                at = bisect_right(spans, a, key=lambda x: x[0]) - 1
                if at >= 0 and spans[at][1] >= b:
                    return True
        return False

    found = [(score, templates.names[k], line[a], line[b]) for score, k, a, b in runs if whole(a, b) or not inside(k, a, b)]
    return sorted(found, key=lambda x: (-x[0], x[1], x[2], x[3]))


def scan_text(text: str | None, templates: Templates) -> list[tuple[float, str, int, int]]:
    """score, licence, first and last line of the lines, paragraphs and the text that match, best first."""
    lines = [words_of(x) for x in (text or "").split("\n")]
    blank = [not x for x in (text or "").split("\n")]
    units = [(i, i) for i in range(len(lines))]
    first = 0
    for i, empty in enumerate([*blank, True]):
        if empty:
            if i - 1 > first:
                units.append((first, i - 1))
            first = i + 1
    if len(lines) > 1 and (0, len(lines) - 1) not in units[len(lines) :]:
        units.append((0, len(lines) - 1))
    found = []
    for a, b in units:
        # Long runs of lines that repeat few words may still have few distinct bigrams: they are cut as well.
        hit = templates.best(lines[a] if a == b else [w for x in lines[a : b + 1] for w in x])
        if hit:
            found.append((*hit, a, b))
    return sorted(found, key=lambda x: (-x[0], x[1], x[2], x[3]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """One row per document: id, license (null: none), score (0: none), matches (array of struct(license, score, first_line, last_line)).

    windows: compare every run of words instead of lines, paragraphs and whole texts only.
    """
    scan_one = scan_windows if windows else scan_text
    texts = TEMPLATES if templates is None else templates
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    match = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, threshold)
        for b in batches:
            found = [scan_one(t.as_py(), known) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([f[0][1] if f else None for f in found], pa.string()),
                    pa.array([f[0][0] if f else 0.0 for f in found], pa.float64()),
                    pa.array([[{"license": n, "score": s, "first_line": i, "last_line": j} for s, n, i, j in f] for f in found], match),
                ],
                names=["doc", "license", "score", "matches"],
            )

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"doc {kind}, license string, score double, matches array<struct<license:string,score:double,first_line:int,last_line:int>>")
    return out.withColumnRenamed("doc", id_col)
