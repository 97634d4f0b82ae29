"""License scans with a generalised suffix automaton over the words of licence templates.

The automaton is built once on the driver from fixed templates and phrases. Each task streams the words of its texts
through it, which gives matching statistics: at every word the longest run ending there that some template holds. Maximal
runs of at least min_match words become (template, place) anchors; anchors of one template that keep their order and lie
close are chained into spans, and a span whose template is covered enough gives its label. Phrases are templates that
must be covered whole, and are found at all their places. Words that no template holds end every run, so only runs of
known words are streamed.

Null and empty texts have no words and no spans. Very long texts are streamed whole. Repeated rows repeat their results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundwork.llm.common import pick, text_blocks, tidy

# Phrases and labels that count as a base hit.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public notices of well-known licences, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "Released under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3-clause": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "The accompanying program is provided under the terms of this Eclipse Public License (\"Agreement\"). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0."],
}

#: Lower-cases A-Z and turns every other ASCII character but digits and a-z into a space.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised: every text is added from the start state, so no match runs from one text into another."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [[]]
        self.ends = ends  # per state: (text, place of the last word) of its strings
        for n, text in enumerate(texts):
            last = 0
            for place, word in enumerate(text):
                last = self._extend(last, word)
                ends[last].append((n, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] = sorted({*ends[self.link[state]], *ends[state]})

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def find(self, text: list[int]) -> int:
        state = 0
        for word in text:
            state = self.next[state][word]
        return state

    def stream(self, text: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest match that ends there."""
        state = length = 0
        for word in text:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_match: int, max_gap: int, coverage: float):
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage
        self.code: dict[bytes, int] = {}
        coded = lambda text: [self.code.setdefault(w, len(self.code) + 1) for w in words_of(text.encode())]
        self.labels, texts = [], []
        for label, options in templates.items():
            for text in options:
                self.labels.append(label)
                texts.append(coded(text))
        self.sizes = [len(t) for t in texts]
        of_phrases = [(coded(p), label) for p, label in phrases.items()]
        self.automaton = SuffixAutomaton(texts + [p for p, _ in of_phrases])
        self.shortest = min([min_match, *(len(p) for p, _ in of_phrases)])
        # Phrases that end where a state's strings end: those of its suffix-link ancestors and itself.
        own: dict[int, list[tuple[int, str]]] = {}
        for p, label in of_phrases:
            own.setdefault(self.automaton.find(p), []).append((len(p), label))
        self.phrases_at: list[list[tuple[int, str]]] = []
        for state in range(len(self.automaton.link)):
            at, found = state, []
            while at > 0:
                found += own.get(at, [])
                at = self.automaton.link[at]
            self.phrases_at.append(found)

    def scan(self, words: list[bytes]) -> list[dict]:
        """Spans of one text: kind (phrase or template), label, first word, number of words, and covered share."""
        known = self.code
        codes = np.array([0, *[known.get(w, 0) for w in words], 0], np.int32)
        edge = np.flatnonzero(np.diff((codes > 0).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]  # runs of known words, as places in words
        spans: list[dict] = []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for run in np.flatnonzero(ends - starts >= self.shortest).tolist():
            first = int(starts[run])
            state_before = length_before = 0
            for i, (state, length) in enumerate([*self.automaton.stream(codes[first + 1 : int(ends[run]) + 1].tolist()), (0, 0)]):
                for size, label in self.phrases_at[state]:
                    if size <= length:
                        spans.append({"kind": "phrase", "label": label, "first_word": first + i - size + 1, "n_words": size, "coverage": 1.0})
                if length != length_before + 1 and length_before >= self.min_match:
                    for text, end in self.automaton.ends[state_before]:
                        if text < len(self.labels):
                            anchors.setdefault(text, []).append((first + i - length_before, end - length_before + 1, length_before))
                state_before, length_before = state, length
        return spans + self._best([s for text, found in anchors.items() for s in self._chains(text, sorted(found))])

    def _best(self, spans: list[dict]) -> list[dict]:
        """Template spans without those that lie inside one of another label that covers more words: a notice of one licence
        holds most words of its relatives' notices."""
        reach = max((s["n_words"] for s in spans), default=0)
        spans.sort(key=lambda s: (s["first_word"], s["label"]))
        starts = [s["first_word"] for s in spans]

        def inside(s: dict) -> bool:
            near = spans[bisect_left(starts, s["first_word"] - reach) : bisect_right(starts, s["first_word"])]
            return any(t["label"] != s["label"] and t["covered"] > s["covered"] and t["first_word"] <= s["first_word"] and s["first_word"] + s["n_words"] <= t["first_word"] + t["n_words"] for t in near)

        kept = [s for s in spans if not inside(s)]
        return [{k: v for k, v in s.items() if k != "covered"} for s in kept]

    def _chains(self, text: int, anchors: list[tuple[int, int, int]]) -> list[dict]:
        """Chains anchors (place, template place, length) that advance in both and leave gaps of at most max_gap words."""
        out, best = [], []  # best: covered words, place before, of the best chain that ends with each anchor
        for i, (at, place, size) in enumerate(anchors):
            top = (size, -1)
            for j in range(i - 1, -1, -1):
                b_at, b_place, b_size = anchors[j]
                if at - (b_at + b_size) > self.max_gap + max(self.sizes):
                    break
                over = max(0, b_at + b_size - at, b_place + b_size - place)
                if b_at < at and b_place < place and over < size and at - (b_at + b_size) <= self.max_gap and place - (b_place + b_size) <= self.sizes[text]:
                    top = max(top, (best[j][0] + size - over, j))
            best.append(top)
        used = set()
        for i in sorted(range(len(anchors)), key=lambda i: (-best[i][0], i)):
            chain, at = [], i
            while at >= 0 and at not in used:
                chain.append(at)
                at = best[at][1]
            used.update(chain)
            share = min(1.0, best[i][0] / self.sizes[text])
            if chain and at < 0 and share >= self.coverage:  # a chain that runs into a better one is part of it
                first, (last, _, size) = anchors[chain[-1]][0], anchors[i]
                out.append({"kind": "template", "label": self.labels[text], "first_word": first, "n_words": last + size - first, "coverage": share, "covered": best[i][0]})
        return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("coverage", T.DoubleType())])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = 4, max_gap: int = 12, coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans): one row for each document, spans an array of (kind, label, first_word, n_words, coverage)."""
    rows = pick(docs, id_col, text_col)
    scanner = LicenseScanner(templates, phrases, min_match, max_gap, coverage)  # of fixed size, sent with the function

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            sizes, spans = [], []
            for text in texts:
                words = words_of(text)
                sizes.append(len(words))
                spans.append(scanner.scan(words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, _SPANS)], names=["id", "n_words", "spans"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
