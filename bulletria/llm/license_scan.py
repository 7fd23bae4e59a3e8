"""License scan: normalised text against templates by Dice over word bigrams.

A document is compared as a whole, by paragraph (runs of lines between blank
ones) and by line, so that a license line in a long text counts for itself. A
unit's words are its runs of lower-case ASCII letters and digits; Dice is twice
the number of shared distinct bigrams over the sum of both numbers. A template of
b bigrams can reach a threshold t only for units of b * t / (2 - t) to
b * (2 - t) / t bigrams: others are never compared. Bigrams that no template
has are looked up, and counted, but lead nowhere.

With ``embedded``, windows that slide over all words of the document are
compared as well, so a license counts whatever shares its line or paragraph, and
however its paragraphs are set. They have the size of the template, or up to
(2 - t) / t times it in steps of an eighth. A template is slid only over
documents that have b * t / (2 - t) of its bigrams, the least that reach t.

Long licenses are told by their opening, short ones by the whole text, all by the
usual notices and sentences that name them.

Defined results: null and empty texts, and units under two words, match nothing;
texts of any length are scanned whole. No rows match nothing. Columns other than
doc_id and text aren't looked at; a doc_id must be a number, or null. Rows are
scanned one by one, so repeated ones repeat. Of several units, or
templates, of one license the best score counts. Equal scores of two licenses
are both reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_WORD = re.compile(r"[a-z0-9]+")
_BLANK = re.compile(r"\n[ \t\r]*\n")

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    (
        "BSD-3-Clause",
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. " + _BSD_TAIL,
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to "
        "copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _WARRANTY,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Templates by their bigrams, and by the sizes that can reach the threshold."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be over 0 and at most 1")
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        sets = [set(pairwise(words(text))) for _, text in templates]
        self.sizes = [len(s) for s in sets]
        self.lengths = [max(0, len(words(text)) - 1) for _, text in templates]
        self.index: dict[tuple[str, str], list[int]] = {}
        for i, s in enumerate(sets):
            for bigram in s:
                self.index.setdefault(bigram, []).append(i)
        some = [n for n in self.sizes if n]
        self.least = min(some, default=1) * threshold / (2 - threshold) - 1e-9
        self.most = max(some, default=0) * (2 - threshold) / threshold + 1e-9

    def scan(self, unit: list[str], best: dict[str, float]) -> None:
        """Raise best with the scores of one unit."""
        if len(unit) - 1 < self.least:
            return
        bigrams = set(pairwise(unit))
        n = len(bigrams)
        if not self.least <= n <= self.most:
            return
        shared: dict[int, int] = {}
        for hits in filter(None, map(self.index.get, bigrams)):
            for i in hits:
                shared[i] = shared.get(i, 0) + 1
        for i, common in shared.items():
            score = 2 * common / (n + self.sizes[i])
            if score >= self.threshold and score > best.get(self.names[i], 0):
                best[self.names[i]] = score

    def slide(self, unit: list[str], best: dict[str, float]) -> None:
        """Raise best with the scores of windows of a unit."""
        bigrams = list(pairwise(unit))
        found: dict[int, int] = {}
        for hits in filter(None, map(self.index.get, set(bigrams))):
            for i in hits:
                found[i] = found.get(i, 0) + 1
        for i, common in found.items():
            if common < self.sizes[i] * self.threshold / (2 - self.threshold) - 1e-9:
                continue
            own = [i in self.index.get(g, ()) for g in bigrams]
            most = int(self.lengths[i] * (2 - self.threshold) / self.threshold + 1e-9)
            for width in {min(most, ceil(self.lengths[i] * eighths / 8)) for eighths in range(8, max(9, ceil(8 * most / self.lengths[i]) + 1))}:
                score = self._best_window(bigrams, own, width, self.sizes[i])
                if score >= self.threshold and score > best.get(self.names[i], 0):
                    best[self.names[i]] = score

    @staticmethod
    def _best_window(bigrams: list[tuple[str, str]], own: list[bool], width: int, size: int) -> float:
        """The best Dice of so many bigrams in a row; own: those of the template, which has size distinct ones."""
        inside: dict[tuple[str, str], int] = {}
        shared, top = 0, 0.0
        for p, g in enumerate(bigrams):
            inside[g] = inside.get(g, 0) + 1
            shared += own[p] and inside[g] == 1
            if p >= width:
                old = bigrams[p - width]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                    shared -= own[p - width]
            if p >= width - 1:
                top = max(top, 2 * shared / (len(inside) + size))
        return top

    def document(self, text: str, embedded: bool = False) -> dict[str, float]:
        best: dict[str, float] = {}
        whole = text.lower()
        paragraphs = _BLANK.split(whole)
        all_words: list[str] = []
        for paragraph in paragraphs:
            lines = [_WORD.findall(line) for line in paragraph.split("\n")]
            for line in lines:
                self.scan(line, best)
            joined = [w for line in lines for w in line] if len(lines) > 1 else lines[0]
            if len(lines) > 1:
                self.scan(joined, best)
            all_words += joined
        if len(paragraphs) > 1:
            self.scan(all_words, best)
        if embedded:
            self.slide(all_words, best)
        return best


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, embedded: bool = False) -> DataFrame:
    """(doc_id, license, score) of each license that a document names or contains."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            ids, names, scores = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for name, score in matcher.document(text.as_py() or "", embedded).items():
                    ids.append(doc_id)
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "license", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return own.mapInArrow(run, "doc_id long, license string, score double")
