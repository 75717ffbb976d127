"""License scans by a generalised suffix automaton.

The automaton of the licence texts' words is built once (it grows with these texts alone) and goes to every task. A
file streams through it a block at a time: after each word stands the longest run of words up to there that some
licence text has (its matching statistics). Where a run is long enough and does not go on in a place of a licence text,
it is a match of that place; matches of one licence text in the same order, not far apart, chain into spans, and a span
that covers enough of the text is a find.

Phrases are texts of the automaton as well: where the run that stands after a word ends in one, the phrase is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Words of a match, and of the part of a file that may lie between two matches of a chain.
MIN_MATCH, MAX_GAP = 4, 40
#: Share of a licence text that a span has to cover.
MIN_SHARE = 0.5
#: Bytes of a file that are looked at together.
BLOCK = 1 << 20

#: Phrases and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices by which works say their licence (fixed values, the licences' own words).
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Bytes of words (fixed values of the contract): 0-9, a-z, and all beyond ASCII; A-Z is lowered before.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words(text: str) -> list[bytes]:
    data = text.encode().translate(_LOWER)
    return bytes(b if w else 32 for b, w in zip(data, _IS_WORD[np.frombuffer(data, np.uint8)], strict=True)).split()


class Match(NamedTuple):
    """``length`` words from word ``start`` of a file that are words ``at`` ... of licence text ``text``."""

    start: int
    at: int
    length: int
    text: int


class Span(NamedTuple):
    """Words ``first`` ... ``last`` of a file, of which ``covered`` words of licence text ``text`` are matched in order."""

    text: int
    first: int
    last: int
    covered: int


class Automaton:
    """Generalised suffix automaton of texts of words: states, the longest run of each, suffix links."""

    def __init__(self, texts: list[list[bytes]]):
        self.texts = texts
        self.word = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        #: (text, words up to there) of prefixes that end in a state
        self.prefixes: list[list[tuple[int, int]]] = [[]]
        for number, text in enumerate(texts):
            last = 0
            for k, w in enumerate(text):
                last = self._add(last, self.word[w])
                self.prefixes[last].append((number, k + 1))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.prefixes.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the runs of q that follow p by w: q itself, or a state made for the shorter ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # another text began like this one
            return self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    @cached_property
    def _below(self) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """Prefixes in the order of a walk over the links, and of each state the first and the end of those below it."""
        children: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link):
            if up >= 0:
                children[up].append(state)
        first, end, order = [0] * len(self.link), [0] * len(self.link), []
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                end[state] = len(order)
                continue
            first[state] = len(order)
            order += self.prefixes[state]
            stack.append((state, True))
            stack += [(c, False) for c in children[state]]
        return first, end, order

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(text, words up to there) of all places where a run of the state ends."""
        first, end, order = self._below
        return order[first[state] : end[state]]

    @cached_property
    def width(self) -> list[int]:
        """The number of places where a run of each state ends."""
        first, end, _ = self._below
        return [b - a for a, b in zip(first, end, strict=True)]

    def whole(self, texts: set[int]) -> list[list[tuple[int, int]]]:
        """Of each state: (text, length) of those of ``texts`` that, whole, end its longest run."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            own = [(t, n) for t, n in self.prefixes[state] if t in texts and n == len(self.texts[t])]
            out[state] = own + (out[self.link[state]] if self.link[state] >= 0 else [])
        return out


class Scanner:
    """What tasks hold: the automaton of licence texts and phrases, and where its words are looked up."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_share: float = MIN_SHARE):
        self.labels = [label for label, _ in templates] + [label for _, label in phrases]
        texts = [words(t) for _, t in templates] + [words(p) for p, _ in phrases]
        if any(not t for t in texts):
            raise ValueError("a licence text without words")
        self.min_match, self.max_gap, self.min_share, self.n_templates = min_match, max_gap, min_share, len(templates)
        self.automaton = Automaton(texts)
        self.sizes = [len(t) for t in texts]
        self.phrases = self.automaton.whole(set(range(len(templates), len(texts))))
        self.longest_word = max(map(len, self.automaton.word))

    def stream(self, text: bytes, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(words before, places of known words, their numbers) of each block of a file; a word is never cut."""
        start, n = 0, 0
        known = self.automaton.word
        while start < len(text):
            stop = min(start + block, len(text))
            while stop < len(text) and _IS_WORD[text[stop] + 32 if 65 <= text[stop] <= 90 else text[stop]]:
                stop += 1
            data = text[start:stop].translate(_LOWER)
            inside = np.concatenate([[False], _IS_WORD[np.frombuffer(data, np.uint8)], [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, ends = edges[::2], edges[1::2]
            short = np.flatnonzero(ends - starts <= self.longest_word)
            found = [(k, known.get(data[a:b])) for k, a, b in zip(short.tolist(), starts[short].tolist(), ends[short].tolist(), strict=True)]
            found = [(k, w) for k, w in found if w is not None]
            yield n, len(starts), found
            n += len(starts)
            start = stop

    def scan(self, text: bytes, block: int = BLOCK) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """(number of words, (first word, phrase) in order, spans) of a file."""
        a, chains = self.automaton, Chains(self)
        following, length_of, link, width, phrases = a.next, a.length, a.link, a.width, self.phrases
        state = length = n = 0
        before = -1  # the place of the last known word
        places: list[tuple[int, int]] = []
        for first, size, found in self.stream(text, block):
            for k, w in found:
                place = first + k
                if place != before + 1 and length:  # an unknown word stands between
                    if length >= self.min_match:
                        chains.add(before - length + 1, length, state)
                    state = length = 0
                after = following[state].get(w)
                if length >= self.min_match and (after is None or width[after] < width[state]):  # not all places go on
                    chains.add(before - length + 1, length, state, w)
                while after is None and state:
                    state = link[state]
                    length, after = length_of[state], following[state].get(w)
                if after is not None:
                    state, length = after, length + 1
                # the run may be shorter than the state's longest, then its longest whole phrase may not be in it
                for t, m in phrases[state]:
                    if m <= length:
                        places.append((place - m + 1, t))
                before = place
            n = first + size
        if length >= self.min_match:
            chains.add(before - length + 1, length, state)
        return n, sorted(places), chains.spans()


class Chains:
    """Chains matches of one file, in the order in which they end; remembers those that a later match may follow."""

    def __init__(self, scanner: Scanner):
        self.scanner = scanner
        #: of each licence text: (match, words covered by its best chain, that chain's first word)
        self.open: dict[int, list[tuple[Match, int, int]]] = {}
        self.found: dict[int, list[Span]] = {}

    def add(self, start: int, length: int, state: int, word: int | None = None) -> None:
        """A run and all its places, but those after which ``word`` comes."""
        a = self.scanner.automaton
        for text, end in a.ends(state):
            goes_on = word is not None and end < len(a.texts[text]) and a.word[a.texts[text][end]] == word
            if text < self.scanner.n_templates and not goes_on:
                self._chain(Match(start, end - length, length, text))

    def _chain(self, m: Match) -> None:
        """The match behind the chain by which it covers most; a match reaches over the end of the one before it."""
        before = self.open.setdefault(m.text, [])
        before[:] = [x for x in before if m.start - (x[0].start + x[0].length) <= self.scanner.max_gap]
        covered, first = m.length, m.start
        for p, n, begin in before:
            over = max(0, p.start + p.length - m.start, p.at + p.length - m.at)
            if over < m.length and p.start < m.start and p.at < m.at and (n + m.length - over, -begin) > (covered, -first):
                covered, first = n + m.length - over, begin
        before.append((m, covered, first))
        if covered >= self.scanner.min_share * self.scanner.sizes[m.text]:
            self._file(Span(m.text, first, m.start + m.length - 1, covered))

    def _file(self, span: Span) -> None:
        """Of spans that share words, the one that covers most stays."""
        of = self.found.setdefault(span.text, [])
        if of and span.first <= of[-1].last:
            if span.covered > of[-1].covered:
                of[-1] = span
        else:
            of.append(span)

    def spans(self) -> list[Span]:
        return sorted((s for of in self.found.values() for s in of), key=lambda s: (s.first, s.text, s.last))


_FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,share:double>>"


def _scanned(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                rows = [_row(scanner, i, t.as_buffer().to_pybytes()) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return run


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]


def _row(scanner: Scanner, doc_id: int | None, text: bytes) -> tuple:
    n, places, spans = scanner.scan(text)
    base = {scanner.labels[t] for _, t in places}
    shares = [s.covered / scanner.sizes[s.text] for s in spans]
    of = {scanner.labels[s.text] for s in spans}
    found = [{"label": scanner.labels[s.text], "first_word": s.first, "last_word": s.last, "share": share} for s, share in zip(spans, shares, strict=True)]
    first, last = (places[0][0], places[-1][0]) if places else (None, None)
    return doc_id, n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | of)), max([1.0 if places else 0.0, *shares]), found


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    A row for each row of docs, also those that repeat an id or have none. Null texts count as empty: no words, no
    labels, no first and last word, score 0. ``n_base`` counts all places of the phrases, overlapping ones too;
    ``spans`` are the covered parts of licence texts, of those of one text that share words the one that covers most
    (ties: the first). ``score`` is 1 where a phrase stands, else the largest share of a licence text that a span
    covers. Files of any length stream through in blocks. Other columns are ignored; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return narrow.mapInArrow(lambda batches: _scanned(held.value)(batches), _FOUND)
