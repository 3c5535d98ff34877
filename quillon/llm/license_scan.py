"""Finds license notices in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as c
from quillon.llm.decontamination import FOLD, fold_words

#: Fixed texts: usual notices and short licenses, by SPDX identifier and form.
TEMPLATES = {
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT/short": "Released under the MIT License.",
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED."
    ),
    "BSD-3-Clause/endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "ISC/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1/header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "Unlicense/start": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Reserved/short": "All rights reserved.",
}

GRAM, WINDOW = 3, 2  # words in a fingerprint; fingerprints of which the least is kept


def winnow(grams: np.ndarray) -> np.ndarray:
    """The places of the kept fingerprints: the least (of equals the last) of every WINDOW in a row; all of a shorter list."""
    if len(grams) < WINDOW:
        return np.arange(len(grams))
    rows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(rows)) + WINDOW - 1 - rows.argmin(1))


class Library:
    """The templates' words and the inverted index of their winnowed fingerprints: (template, place) by hash.

    All fingerprints of a document are looked up: GRAM + WINDOW - 1 of a template's words in a row, or all of a
    template of GRAM words, always hold one that was kept.
    """

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [fold_words(templates[n].encode()) for n in self.names]
        index = defaultdict(list)
        for t, words in enumerate(self.words):
            grams = c.mix(c.window_hash(c.hash_words(words), GRAM))
            for at in winnow(grams).tolist():
                index[int(grams[at])].append((t, at))
        self.index = dict(index)
        self.prints = np.array(sorted(index), np.uint64)


def band_of(length: int) -> int:
    return max(1, min(16, length // 4))


def banded(template: list[bytes], words: list[bytes], start: int) -> tuple[int, int, int]:
    """(matched, first, end): the longest common subsequence of the template with the document near the diagonal from ``start``.

    A template word i may match words start+i-band to start+i+band. Of equal results the one that begins last, then ends
    first; first and end bound the matched words in the document.
    """
    band, none = band_of(len(template)), (0, -1, 0)
    before: dict[int, tuple[int, int, int]] = {}  # by place in the document: matched, first, -end
    for i, word in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, start + i - band), min(len(words), start + i + band + 1)):
            best = max(before.get(j, none), now.get(j - 1, none), before.get(j - 1, none))
            if words[j] == word:
                matched, first, _ = before.get(j - 1, none)
                best = max(best, (matched + 1, first if matched else j, -(j + 1)))
            now[j] = best
        before = now or before
    matched, first, end = max(before.values(), default=none)
    return matched, first, -end


def find(library: Library, text: bytes, coverage: float) -> list[tuple[str, float, int, int, int, int]]:
    """(template, coverage, first word, end word, first byte, end byte) of the notices in a text, in order."""
    words = fold_words(text)
    grams = c.mix(c.window_hash(c.hash_words(words), GRAM))
    if not len(grams):
        return []
    kept = np.flatnonzero(np.isin(grams, library.prints))
    if not len(kept):
        return []
    diagonals = defaultdict(set)
    for at in kept.tolist():
        for t, place in library.index[int(grams[at])]:
            diagonals[t].add(at - place)
    found = []
    for t, starts in diagonals.items():
        template, group = library.words[t], []
        results = []
        for s in [*sorted(starts), None]:
            if group and (s is None or s - group[0] > band_of(len(template))):
                matched, first, end = max((banded(template, words, x) for x in {group[0], group[len(group) // 2], group[-1]}), key=lambda r: (r[0], r[1]))
                if matched >= coverage * len(template):
                    results.append((matched, first, end))
                group = []
            if s is not None:
                group.append(s)
        taken: list[tuple[int, int]] = []
        for matched, first, end in sorted(results, key=lambda r: (-r[0], r[1])):  # of overlapping ones of a template the best
            if all(end <= a or first >= b for a, b in taken):
                taken.append((first, end))
                found.append((library.names[t], matched / len(template), first, end))
    if not found:
        return []
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(FOLD))]
    return sorted(((n, v, a, b, spans[a][0], spans[b - 1][1]) for n, v, a, b in found), key=lambda r: (r[2], r[3], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8, most_words: int = 1_000_000) -> DataFrame:
    """One row per notice found: id, license (template name), coverage (matched share of its words), start_word, end_word, start_byte, end_byte.

    Words as in decontamination: ASCII case and punctuation don't count. A notice is found if it has four words in a row of a
    template (all three of one of three words; shorter templates are never found) and an alignment within a quarter of its length
    covers ``coverage`` of it. TEMPLATES has usual notices and short licenses; whole texts of long ones can be given in ``templates``. Notices of different templates may overlap, those
    of one don't. Documents without any give no row; null and empty texts have none; repeated rows and ids give their rows each.

    Templates go to every task; their size is checked against ``most_words``. No shuffle; texts are scanned whole.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(x.split()) for x in templates.values()) > most_words:
        raise ValueError(f"templates of over {most_words} words: scan in several calls")
    c.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Library(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in c.chunks(batches, "text"):
            source, rows = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for r in find(own, text, coverage) if text else ():
                    source.append(i)
                    rows.append(r)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [batch["id"].take(pa.array(source, pa.int32())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), *(pa.array(x, pa.int64()) for x in columns[2:])]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, license string, coverage double, {', '.join(f'{x} long' for x in NAMES[3:])}").withColumnRenamed("id", id_col)


NAMES = ["id", "license", "coverage", "start_word", "end_word", "start_byte", "end_byte"]
