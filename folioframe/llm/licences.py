"""Licence scans: matching statistics against a generalised suffix automaton of licence texts.

One automaton holds the words of all templates and phrases. A document runs
through it word by word; at each word the automaton gives the longest stretch
that ends there and stands in some template. Phrases are read off these
statistics; long stretches become anchors, and anchors of one template that
follow one another in both texts are chained into a span of the document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import batches, worker_keep

# Licence notices as their publishers word them, and labels for them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
            "either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
             "either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# What a word holds: digits, a-z (A-Z taken as such) and every byte of a letter beyond ASCII; other bytes part words.
_FOLD = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """All stretches of some sequences; a state stands for those that end at the same places."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._ends: list[list[tuple[int, int]]] = [[]]
        self.whole: list[int] = []  # the state of each whole sequence
        for number, sequence in enumerate(sequences):
            state = 0
            for place, token in enumerate(sequence, 1):
                state = self._extend(state, token)
                self._ends[state].append((number, place))
            self.whole.append(state)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self._ends[self.link[state]] += self._ends[state] if self.link[state] else []

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self._ends.append([])
        return len(self.link) - 1

    def _split(self, before: int, token: int) -> int:
        """The state after `token` whose longest stretch is one longer than that of `before`."""
        after = self.next[before][token]
        if self.length[after] == self.length[before] + 1:
            return after
        twin = self._add(self.length[before] + 1, self.link[after], dict(self.next[after]))
        self.link[after] = twin
        while before >= 0 and self.next[before].get(token) == after:
            self.next[before][token] = twin
            before = self.link[before]
        return twin

    def _extend(self, state: int, token: int) -> int:
        if token in self.next[state]:
            return self._split(state, token)
        new = self._add(self.length[state] + 1, 0, {})
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every place where the stretches of a state stand."""
        return self._ends[state]

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """The longest stretch that ends with `token`, after one in `state` of that length."""
        while token not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][token], length + 1


class Span(NamedTuple):
    label: str
    start: int  # words from 0
    stop: int
    cover: float  # share of the template's words


class Scanner:
    """Finds phrases and template spans in a document."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], least: int, gap: int, cover: float):
        self._least, self._gap, self._cover = least, gap, cover
        cut_up = [words(t.encode()) for _, t in templates] + [words(p.encode()) for p in phrases]
        if not all(cut_up):
            raise ValueError("a template or phrase without words")
        self._ids: dict[bytes, int] = {}
        sequences = [[self._ids.setdefault(w, len(self._ids)) for w in seq] for seq in cut_up]
        self._automaton = SuffixAutomaton(sequences)
        self._labels = [label for label, _ in templates]
        self._sizes = [len(s) for s in sequences[: len(templates)]]
        own: dict[int, list[tuple[str, int]]] = {}
        for (phrase, label), state, seq in zip(phrases.items(), self._automaton.whole[len(templates) :], sequences[len(templates) :], strict=True):
            own.setdefault(state, []).append((label, len(seq)))
        # Phrases that a match in a state can end with: those of the state and of the shorter ones it links to.
        self._phrases: list[list[tuple[str, int]]] = []
        for state in range(len(self._automaton.link)):
            found, s = [], state
            while s > 0:
                found += own.get(s, [])
                s = self._automaton.link[s]
            self._phrases.append(found)

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[Span], float]:
        """(words, phrase places (label, start), template spans, greatest share of a template that a chain covers)."""
        tokens = list(map(self._ids.get, parts := words(text)))
        places: list[tuple[str, int]] = []
        anchors: list[tuple[int, int, int]] = []  # start, length, state
        automaton, phrases, least = self._automaton, self._phrases, self._least
        state = length = 0
        last = -2
        for i in [i for i, t in enumerate(tokens) if t is not None]:
            if i != last + 1:
                if length >= least:
                    anchors.append((last - length + 1, length, state))
                state = length = 0
            before, held = state, length
            state, length = automaton.step(state, length, tokens[i])
            if length <= held >= least:  # the stretch before could not go on
                anchors.append((i - held, held, before))
            for label, size in phrases[state]:
                if size <= length:
                    places.append((label, i - size + 1))
            last = i
        if length >= least:
            anchors.append((last - length + 1, length, state))
        spans, best = self._chains(anchors)
        return len(parts), places, spans, best

    def _chains(self, anchors: list[tuple[int, int, int]]) -> tuple[list[Span], float]:
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, state in anchors:
            for sequence, end in self._automaton.ends(state):
                if sequence < len(self._sizes):
                    by_template.setdefault(sequence, []).append((start, end - length, length))
        found: list[tuple[int, int, int, int]] = []  # covered words, start, stop, template
        best = 0.0
        for template, pieces in by_template.items():
            size = self._sizes[template]
            chains = self._linked(pieces)
            best = max(best, max(c for c, _, _ in chains) / size)
            taken: list[tuple[int, int]] = []
            for covered, start, stop in sorted((c for c in chains if c[0] >= self._cover * size), key=lambda c: (-c[0], c[1], c[2])):
                at = bisect_left(taken, (start, stop))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= stop):
                    taken.insert(at, (start, stop))
                    found.append((covered, start, stop, template))
        return self._apart(found), best

    def _linked(self, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The best chain that ends with each anchor: covered words, start, stop. Anchors rise in both texts, with at most `gap` words between."""
        pieces.sort()
        out: list[tuple[int, int, int]] = []
        first = 0
        longest = max(length for _, _, length in pieces)
        for n, (start, place, length) in enumerate(pieces):
            while pieces[first][0] + longest + self._gap < start:
                first += 1
            best = (length, start, start + length)
            for m in range(first, n):
                there, spot, size = pieces[m]
                behind = start - (there + size)
                ahead = place - (spot + size)
                overlap = max(0, -behind, -ahead)
                if behind <= self._gap and ahead <= self._gap and there < start and spot < place and overlap < length:
                    covered = out[m][0] + length - overlap
                    if (covered, out[m][1]) > (best[0], best[1]):
                        best = (covered, out[m][1], start + length)
            out.append(best)
        return out

    def _apart(self, found: list[tuple[int, int, int, int]]) -> list[Span]:
        """Spans by start; one that lies by half or more inside a span with more covered words goes."""
        kept: list[tuple[int, int, int, int]] = []
        stops: list[tuple[int, int]] = []  # disjoint runs of kept spans, sorted
        for covered, start, stop, template in sorted(found, key=lambda f: (-f[0], f[1], self._labels[f[3]], f[3])):
            inside, at = 0, bisect_left(stops, (start, start))
            for a, b in stops[max(0, at - 1) : at + stop - start + 1]:
                if a >= stop:
                    break
                inside += max(0, min(b, stop) - max(a, start))
            if 2 * inside < stop - start:
                kept.append((covered, start, stop, template))
                low, high, here = start, stop, max(0, at - 1)
                if at and stops[here][1] < start:
                    here = at
                until = here
                while until < len(stops) and stops[until][0] <= stop:
                    low, high = min(low, stops[until][0]), max(high, stops[until][1])
                    until += 1
                stops[here:until] = [(low, high)]
        return sorted(Span(self._labels[t], a, b, c / self._sizes[t]) for c, a, b, t in kept)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
         least: int = 3, gap: int = 8, cover: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence phrases and template spans of every whole text: key, n_words, places, spans, best.

    `places` (label, start) are all places where a phrase's words stand next to
    each other. `spans` (label, start, stop, cover) are stretches that chain
    matches of `least` words or more, at most `gap` words apart in either text,
    into at least `cover` of a template's words; where spans overlap by half, the
    one that covers more words stays. `best` is the greatest share of a template
    that a chain covers, whether it is enough or not. Starts are words from 0.

    A null or empty text has no words, places or spans and a best of 0. Rows stay
    as they are, null or repeated keys included; an empty table gives an empty
    one; other columns are not kept. No shuffle, and a text is read once: besides
    its words a task holds only what has matched.
    """
    settings = (tuple(templates), tuple(phrases.items()), least, gap, cover)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_keep(("licences", settings), lambda: Scanner(templates, phrases, least, gap, cover))
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))
        for batch in rows:
            found = [scanner.scan(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"label": a, "start": b} for a, b in f[1]] for f in found], place),
                    pa.array([[s._asdict() for s in f[2]] for f in found], span), pa.array([f[3] for f in found], pa.float64()),
                ],
                ["id", "n_words", "places", "spans", "best"],
            )

    inner = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,stop:long,cover:double>>, best double"
    return batches(inner, work, schema).withColumnRenamed("id", key)
