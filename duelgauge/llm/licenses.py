"""License scan: Dice coefficient over word bigrams against license templates.

A text is compared as a whole, paragraph by paragraph and line by line, and through windows of words that
start at every word of it, whatever line ends and comment marks lie inside. A unit is normalised to words of
a-z and 0-9 after lower-casing A-Z; its bigrams are a set (one word: the word alone). A template matches
where 2 |A and B| / (|A| + |B|) reaches the threshold t. Since |A and B| cannot exceed the smaller set, only
templates with t / (2 - t) <= |A| / |B| <= (2 - t) / t are compared, and texts that do not hold t / (2 - t)
of a template's bigrams are passed over for it. Windows have the template's number of words and SPREAD
times that number; the distinct bigrams of all windows of one length are counted together.

Where licenses overlap, the one that shares most bigrams counts, then the one of the higher score; another is
left out if less than a tenth of what it shares lies outside the better template (a variant, or an
excerpt of it), and kept if it has wording of its own. A window is reported where no unit or better window of
its license shares as many. A full license text carries its family's name (GPL-3.0), since only a notice says
whether later versions count.

Defined cases: a null or empty text matches nothing; units that occur again in a batch are compared once;
a unit that equals its paragraph or text is reported once, as the smaller kind; repeated rows are rows of
their own; other columns are not read; a template of one word is compared with whole units alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duelgauge.llm.common import ship

THRESHOLD = 0.8
PARAGRAPH = re.compile(r"\n(?:[ \t\v\f\r]*\n)+")
WORDS = re.compile("[a-z0-9]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Wording of common licenses and of the notices that refer to them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} License as published by "
    "the Free Software Foundation{2}either version {3} of the License, or (at your option) any later version."
)
MIT_TERM = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
# Further notices; kept apart, since the registered SQL states TEMPLATES.
FURTHER: tuple[tuple[str, str], ...] = (
    ("LGPL-2.1-or-later", GNU.format("library", "GNU Lesser General Public", "; ", "2.1")),
    ("LGPL-2.0-or-later", GNU.format("library", "GNU Library General Public", "; ", "2")),
    ("LGPL-3.0-or-later", GNU.format("program", "GNU Lesser General Public", ", ", "3")),
    ("AGPL-3.0-or-later", GNU.format("program", "GNU Affero General Public", ", ", "3")),
    ("LGPL-2.1-only", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License version 2 as published by the Free Software Foundation.",
    ),
    (
        "EPL-1.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at",
    ),
    ("EPL-2.0", "This work is licensed under the terms of the Eclipse Public License, version 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    ("MIT", " ".join(text for name, text in TEMPLATES if name == "MIT" and len(text) > 200).replace("conditions: ", "conditions: " + MIT_TERM)),
    ("BSD-2-Clause", BSD_TERMS + BSD_END),
    ("BSD-3-Clause", BSD_TERMS + next(text for name, text in TEMPLATES if name == "BSD-3-Clause") + " " + BSD_END),
    ("ISC", next(text for name, text in TEMPLATES if name == "ISC") + " " + ISC_END),
)
# Whole license texts, a file for each.
FULL: tuple[tuple[str, str], ...] = tuple(
    (path.stem, path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
)
SPREAD = (1.0, 2 / 3, 0.8, 0.9, 1.1, 1.25, 1.5)

MATCHES = "doc_id long, matches array<struct<license:string,start:long,stop:long,score:double>>"
Match = tuple[int, float, int]  # shared bigrams, score, template
Place = tuple[int, float, str, int, int]  # the same with start and stop


def word_list(text: str) -> list[str]:
    return WORDS.findall(text.translate(UPPER))


def bigrams(words: list[str]) -> frozenset[str]:
    return frozenset(words) if len(words) == 1 else frozenset(f"{a} {b}" for a, b in zip(words, words[1:]))


def distinct(before: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Different values among the counted ones of every run of `width` places; `before` is the last place of the same value."""
    total = np.concatenate([[0], np.cumsum(counts)])
    total = total[width:] - total[:-width]
    again = np.flatnonzero(counts & (before >= 0) & (np.arange(len(before)) - before < width))
    low, high = np.maximum(again - width + 1, 0), np.minimum(before[again], len(total) - 1)
    low, high = low[low <= high], high[low <= high]
    change = np.bincount(low, minlength=len(total) + 1) - np.bincount(high + 1, minlength=len(total) + 1)
    return total - np.cumsum(change)[: len(total)]


def apart(spans: Iterable[tuple], size: int) -> Iterator[tuple]:
    """Those spans (start and stop come last), in the given order, that overlap none given before."""
    taken = np.zeros(size, bool)
    for span in spans:
        if not taken[span[-2] : span[-1]].any():
            taken[span[-2] : span[-1]] = True
            yield span


class Templates:
    """Bigram sets of the templates and which of them a text can hold."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold, self.bound = threshold, threshold / (2 - threshold)
        lists = [(name, word_list(text)) for name, text in templates]
        lists = [(name, words) for name, words in lists if words]
        self.sets = [(name, bigrams(words)) for name, words in lists]
        self.words = [len(words) for _, words in lists]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in lists for w in words}))}
        coded = [np.unique(self.coded(self.numbers(words))) for _, words in lists]
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *coded]))
        self.holds = np.zeros((len(coded), len(self.codes)), bool)
        for row, own in zip(self.holds, coded):
            row[np.searchsorted(self.codes, own)] = True
        self.sizes = self.holds.sum(1)
        self.known: dict[tuple[str, tuple[int, ...]], list[Match]] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def coded(self, numbers: np.ndarray) -> np.ndarray:
        """Bigrams of template words as numbers, -1 where a word is none."""
        a, b = numbers[:-1], numbers[1:]
        return np.where((a >= 0) & (b >= 0), a * len(self.vocabulary) + b, -1)

    def places(self, words: list[str]) -> np.ndarray:
        """Place in `codes` of every bigram of a text, -1 where no template holds it."""
        own = self.coded(self.numbers(words))
        if not len(self.codes):
            return np.full(len(own), -1)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        return np.where(self.codes[at] == own, at, -1)

    def candidates(self, places: np.ndarray) -> tuple[int, ...]:
        """Templates of which the text holds enough bigrams; those of one word always."""
        got = np.unique(places[places >= 0])
        enough = self.holds[:, got].sum(1) >= self.bound * self.sizes - 1e-9
        return tuple(np.flatnonzero(enough).tolist())

    def best(self, text: str, among: tuple[int, ...]) -> list[Match]:
        """The best template of every license that one unit matches."""
        words = word_list(text)
        if not words:
            return []
        own = bigrams(words)
        found: dict[str, Match] = {}
        for k in among:
            name, other = self.sets[k]
            if self.bound * len(other) <= len(own) and self.bound * len(own) <= len(other):
                shared = len(own & other)
                score = 2 * shared / (len(own) + len(other))
                if score >= self.threshold and (name not in found or score > found[name][1]):
                    found[name] = (shared, score, k)
        return list(found.values())

    def of(self, text: str, among: tuple[int, ...]) -> list[Match]:
        got = self.known.get((text, among))
        if got is None:
            got = self.best(text, among)
            if len(self.known) < 50_000 and len(text) < 4_000:
                self.known[text, among] = got
        return got

    def windows(self, words: list[str], places: np.ndarray, among: tuple[int, ...]) -> list[Place]:
        """Windows that reach the threshold, for each template the best that do not overlap; places are words."""
        ids: dict[str, int] = {}
        numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        bigram = numbers[:-1] * len(ids) + numbers[1:]
        order = np.argsort(bigram, kind="stable")
        before, same = np.full(len(bigram), -1), bigram[order][1:] == bigram[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        every, sizes, out = np.ones(len(bigram), bool), {}, []
        for k in among:
            if self.words[k] < 2:
                continue
            hits = (places >= 0) & self.holds[k][places]
            found = []
            for width in sorted({min(max(round(self.words[k] * f) - 1, 1), len(bigram)) for f in SPREAD}):
                if width not in sizes:
                    sizes[width] = distinct(before, every, width)
                shared = distinct(before, hits, width)
                score = 2 * shared / (sizes[width] + self.sizes[k])
                edge = np.concatenate([[0.0], score, [0.0]])
                for at in np.flatnonzero((score >= self.threshold) & (score >= edge[:-2]) & (score >= edge[2:])).tolist():
                    found.append((-float(score[at]), int(shared[at]), at, at + width + 1))
            out += [(shared, -low, k, a, b) for low, shared, a, b in apart(sorted(found), len(words))]
        return out

    def matches(self, text: str) -> list[Place]:
        """All matches of a text by place; places are code points."""
        lower = text.translate(UPPER)
        words = WORDS.findall(lower)
        if not words:
            return []
        places = self.places(words)
        among = self.candidates(places)
        if not among:
            return []
        name = [n for n, _ in self.sets]
        whole = [(*m, a, b) for a, b in units(text) for m in self.of(text[a:b], among)]
        spans = [m.span() for m in WORDS.finditer(lower)]
        cut = [(shared, score, k, spans[a][0], spans[b - 1][1]) for shared, score, k, a, b in self.windows(words, places, among)] if len(words) > 1 else []
        found = self.strongest(text, whole + cut) if len({name[m[2]] for m in whole + cut}) > 1 else whole + cut
        units_kept = set(found) & set(whole)
        held: dict[str, np.ndarray] = {}  # by license: most bigrams that a match over each place shares
        out = []
        for m in sorted(found, key=lambda m: (m not in units_kept, -m[0], -m[1], m[3:], m[2])):
            most = held.setdefault(name[m[2]], np.zeros(len(text), np.int64))[m[3] : m[4]]
            if m in units_kept or m[0] > most.max():
                np.maximum(most, m[0], out=most)
                out.append(m)
        return sorted(out, key=lambda m: (m[3], m[4], name[m[2]]))

    def strongest(self, text: str, found: list[Place]) -> list[Place]:
        """Without those that a better match of another license over the same place explains."""
        kept: list[Place] = []
        covered: dict[int, tuple[np.ndarray, tuple[int, float]]] = {}  # by template: where, and the best rank
        for m in sorted(found, key=lambda m: (-m[0], -m[1], m[3:], m[2])):
            name, own = self.sets[m[2]]
            rivals = [k for k, (where, rank) in covered.items() if self.sets[k][0] != name and rank > m[:2] and where[m[3] : m[4]].any()]
            if rivals:
                shared = bigrams(word_list(text[m[3] : m[4]])) & own
                if any(10 * len(shared - self.sets[k][1]) < len(shared) for k in rivals):
                    continue
            kept.append(m)
            covered.setdefault(m[2], (np.zeros(len(text), bool), m[:2]))[0][m[3] : m[4]] = True
        return kept


def units(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of lines, then of paragraphs, then of the whole, without repeats."""
    seen, at = set(), 0
    spans = []
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    edges = [0, *[x for m in PARAGRAPH.finditer(text) for x in m.span()], len(text)]
    spans += list(zip(edges[::2], edges[1::2]))
    spans.append((0, len(text)))
    for span in spans:
        if span not in seen and span[0] < span[1]:
            seen.add(span)
            yield span


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + FURTHER + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and all matches of every document: license, place in the text (code points) and score."""
    ship(__name__)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = known.matches(text) if text else ()
                out.append([{"license": known.sets[k][0], "start": a, "stop": b, "score": score} for _, score, k, a, b in found])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "matches": pa.array(out, kind)})

    return docs.select("doc_id", "text").mapInArrow(search, MATCHES)
