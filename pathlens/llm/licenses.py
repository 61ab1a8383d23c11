"""License scans: a generalised suffix automaton of licence templates' tokens.

Texts stream through the automaton, which gives for each place the longest run of tokens that
ends there and occurs in a template. Long runs are chained in the order of their template
into covered spans. Phrases are sequences of the same automaton, found where they end a run.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM_WORDS, Words, slices

# Phrases that carry a label wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label and words of well-known licence notices and of parts of licence texts.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]
#: Runs that may be chained have so many tokens, or all of a shorter template; a template is found when
#: so much of it is covered, by a span not much longer than itself.
LEAST_RUN, LEAST_COVER, STRETCH = 4, 0.8, 1.5


def tokens(text: str) -> list[bytes]:
    words = Words(pa.array([text]), ALNUM_WORDS)
    return [words.word(i) for i in range(len(words.starts))]


class SuffixAutomaton:
    """Of several token sequences. A state keeps every template's last place where its runs end.

    The last sequences, `whole` of them, count only where they stand as a whole: a state keeps
    those that end its runs, with their length.
    """

    def __init__(self, sequences: list[list[int]], whole: int = 0):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        spoken: dict[int, list[int]] = {}
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                if number < len(sequences) - whole:
                    self.ends[last].setdefault(number, set()).add(place)
        by_length = sorted(range(1, len(self.length)), key=lambda s: self.length[s])
        for state in reversed(by_length):
            for number, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, set()).update(places)
        for i, sequence in enumerate(sequences[len(sequences) - whole :]):
            state = 0
            for token in sequence:
                state = self.next[state][token]
            spoken.setdefault(state, []).append(i)
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for state in by_length:
            own = tuple((i, len(sequences[len(sequences) - whole + i])) for i in spoken.get(state, ()))
            self.whole[state] = own + self.whole[self.link[state]]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, state: int, token: int) -> int:
        """The state that `state` reaches by the token, cut off at the runs of that length."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def walk(self, sequence: list[int]):
        """Matching statistics: at each place the state and the length of the longest run that ends there."""
        state, length = 0, 0
        for token in sequence:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                length = 0
            yield state, length

    def runs(self, sequence: list[int]):
        """Matching statistics, reduced to runs that can't be longer: (end, length, state)."""
        return longest(self.walk(sequence))


def longest(statistics):
    """The places of matching statistics after which the run isn't one longer."""
    before, place = (0, 0), -1
    for place, (state, length) in enumerate(statistics):
        if before[1] and length <= before[1]:
            yield place - 1, before[1], before[0]
        before = state, length
    if before[1]:
        yield place, before[1], before[0]


def chains(found: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int, int]]:
    """(covered tokens, first word, last word) of chains of runs (word, place in the template, length; sorted) that cover
    enough of a template of that size: the best one, then the best of what lies beside it, and so on.

    A chain is at most STRETCH times as long as its template. So when one is taken, only the runs
    behind it are looked at anew, until nothing has changed within that reach; all copies of a
    notice cost as much as their words.
    """
    reach, n = STRETCH * size, len(found)
    alive, best, queue = [True] * n, [None] * n, []

    def renew(start: int, changed: float) -> None:
        for i in range(start, n):
            if not alive[i]:
                continue
            word, place, length = found[i]
            if word - changed > reach:
                return
            cover, first = length, word
            for j in range(i - 1, -1, -1):
                w, p, m = found[j]
                if word - w > reach:
                    break
                if alive[j] and w + m <= word and p + m <= place and word + length - best[j][1] <= reach and best[j][0] + length > cover:
                    cover, first = best[j][0] + length, best[j][1]
            if best[i] != (cover, first):
                best[i], changed = (cover, first), max(changed, word)
                if cover >= LEAST_COVER * size:
                    heapq.heappush(queue, (-cover, first, -(word + length - 1), i))

    renew(0, float("inf"))
    while queue:
        cover, first, last, i = heapq.heappop(queue)
        if not alive[i] or best[i] != (-cover, first):
            continue
        yield -cover, first, -last
        start = at = bisect.bisect_left(found, (first - size,))
        while at < n and found[at][0] <= -last:
            alive[at] = alive[at] and found[at][0] + found[at][2] <= first
            at += 1
        renew(start, -last)


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        sequences = [tokens(text) for _, text in templates]
        spoken = [tokens(text) for text in phrases]
        vocabulary = sorted({t for s in [*sequences, *spoken] for t in s})
        number = {t: i for i, t in enumerate(vocabulary)}
        self.sizes = [len(s) for s in sequences]
        self.phrases = list(phrases.values())
        self.shortest = min(LEAST_RUN, *self.sizes, *(len(s) for s in spoken))
        self.automaton = SuffixAutomaton([[number[t] for t in s] for s in [*sequences, *spoken]], len(spoken))
        names = Words(pa.array([b" ".join(vocabulary).decode()]), ALNUM_WORDS).names
        self.order = np.argsort(names)
        self.names = names[self.order]

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary number of each word, -1 for words of no template and no phrase."""
        at = np.minimum(np.searchsorted(self.names, words.names), len(self.names) - 1)
        return np.where(self.names[at] == words.names, self.order[at], -1)

    def scan(self, sequence: list[int], places: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, float, int, int]]]:
        """(phrase, first word) of all phrases, and (template, covered share, first word, last word) of covered spans.

        `sequence` holds the numbers of the words at `places`; words that are left out lie
        within gaps that -1 stands for.
        """
        statistics = list(self.automaton.walk(sequence))
        spoken = [(i, places[at] - n + 1) for at, (state, length) in enumerate(statistics) if length >= self.shortest for i, n in self.automaton.whole[state] if n <= length]
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in longest(statistics):
            for template, ends in self.automaton.ends[state].items():
                if length >= min(LEAST_RUN, self.sizes[template]):
                    by_template.setdefault(template, []).extend((places[end] - length + 1, p - length + 1, length) for p in ends)
        out = []
        for template, found in by_template.items():
            out += [(template, cover / self.sizes[template], first, last) for cover, first, last in chains(sorted(found), self.sizes[template])]
        return spoken, out

def license_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row for each row of docs.

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of characters beyond
    ASCII. n_base counts the places where a phrase's words stand consecutively; first_word and
    last_word are the smallest and largest start, else null. labels joins the phrases' labels
    and those of templates that chained runs cover; score is the largest covered share, 1 with
    a phrase, 0 without a label. `spans` are the covered spans: label, first and last word,
    share. Null and empty texts have no words. Other columns are ignored; no rows give none.
    """

    def run(batches):
        scanner = LicenseScanner(templates, phrases)
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), ALNUM_WORDS)
            number, offsets, n = scanner.numbers(words), words.offsets, batch.num_rows
            base, labels, spans = [[] for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
            # stretches of words of the vocabulary, as many as the shortest sequence has; rows never join
            inside = np.concatenate([[False], number >= 0, [False]])
            cut = np.zeros(len(number) + 1, bool)
            cut[offsets] = True
            begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
            end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
            long = end - begin >= scanner.shortest
            begin, end = begin[long], end[long]
            rows = np.searchsorted(offsets, begin, "right") - 1
            bounds = np.searchsorted(rows, np.arange(n + 1))
            for r in np.unique(rows).tolist():
                sequence, places = [], []
                for a, b in zip(begin[bounds[r] : bounds[r + 1]].tolist(), end[bounds[r] : bounds[r + 1]].tolist(), strict=True):
                    sequence += [-1, *number[a:b].tolist()]
                    places += [a - int(offsets[r]), *range(a - int(offsets[r]), b - int(offsets[r]))]
                spoken, covered = scanner.scan(sequence, places)
                base[r] = [first for _, first in spoken]
                labels[r] = {scanner.phrases[i] for i, _ in spoken}
                spans[r] = [{"label": scanner.labels[template], "first": first, "last": last, "share": share} for template, share, first, last in covered]
            base_labels = [",".join(sorted(x)) for x in labels]
            score = [1.0 if x else max((s["share"] for s in y), default=0.0) for x, y in zip(labels, spans, strict=True)]
            labels = [x | {s["label"] for s in y} for x, y in zip(labels, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min(x) if x else None for x in base], pa.int64()),
                    pa.array([max(x) if x else None for x in base], pa.int64()),
                    pa.array(base_labels, pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, share: double>>")
