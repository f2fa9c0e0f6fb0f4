"""Licence templates in documents, by matching statistics of a generalised suffix automaton.

The automaton holds all passages of words of all templates. A file's words run through it: at each word the state is that of the longest passage of a template that ends there, and its length is the word's matching statistic. Where the passage can't be carried on, it is a maximal match, and the state's places (its own and those of the states below it in the tree of suffix links) are where it stands in templates. Long matches are chained per template, in order in both document and template with bounded gaps; a chain that covers enough of its template is a span with the template's label.

Only stretches of template words as long as the shortest match wanted are run through the automaton: other words bring it back to its start. Finding them, and the base phrases, is a few array operations for a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, worker_cache
from .decontaminate import _FOLD, words_of

#: Fixed values of the contract: phrase and label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which files name their licences, and openings and conditions of the licences' public texts. A label may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


class Match(NamedTuple):
    """Words ``begin`` to ``end`` (exclusive) of the document stand at ``place`` of the template."""

    begin: int
    end: int
    place: int


class SuffixAutomaton:
    """Generalised: all passages of several sequences of words. Templates are added one after the other, each from the start state."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.own: list[list[tuple[int, int]]] = [[]]  # (sequence, word) at which a prefix that ends in the state ends
        for nth, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.own[last].append((nth, at))
        self.below: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link):
            if link >= 0:
                self.below[link].append(state)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.own.append([])
        return len(self.step) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A copy of ``to`` for the passages that are no longer than those of ``state`` and one word."""
        copy = self._new(self.length[state] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.step[state].get(word) == to:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # an earlier template has this passage
            to = self.step[last][word]
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = state
            last = self.link[last]
        if last >= 0:
            to = self.step[last][word]
            self.link[state] = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        return state

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, last word) of all occurrences of the state's passages."""
        todo = [state]
        while todo:
            state = todo.pop()
            yield from self.own[state]
            todo += self.below[state]

    def maximal_matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(first word, end, state) of each match of at least ``least`` words that neither the next nor the previous word extends."""
        state = length = 0
        for at, word in enumerate(words):
            carried = length
            before = state
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if length < carried and carried >= least:
                yield at - carried, at, before
            to = self.step[state].get(word)
            state, length = (to, length + 1) if to is not None else (0, 0)
        if length >= least:
            yield len(words) - length, len(words), state


def _chain(matches: list[Match], size: int, gap: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, words of the template that are covered) of chains of one template's matches: at each match the best chain that it ends, linked to one match before it within ``gap`` words in document and template; chains that others carry on are left out."""
    matches = sorted(set(matches), key=lambda m: (m.begin, m.end, m.place))
    best: list[tuple[int, int]] = []  # covered words, begin
    carried = set()
    oldest = 0
    longest = max((m.end - m.begin for m in matches), default=0)
    for k, m in enumerate(matches):
        while matches[oldest].begin < m.begin - gap - longest:
            oldest += 1
        top, begin, source = m.end - m.begin, m.begin, -1
        for e in range(oldest, k):
            x = matches[e]
            shared = max(0, x.end - m.begin, x.place + x.end - x.begin - m.place)  # an overlap counts once
            if x.begin < m.begin and x.place < m.place and m.begin - x.end <= gap and m.place - (x.place + x.end - x.begin) <= gap and shared < m.end - m.begin:
                covered = best[e][0] + m.end - m.begin - shared
                if covered > top:
                    top, begin, source = covered, best[e][1], e
        best.append((min(top, size), begin))
        if source >= 0:
            carried.add(source)
    for k, m in enumerate(matches):
        if k not in carried:
            yield best[k][1], m.end, best[k][0]


class LicenceScanner:
    def __init__(self, templates: list[tuple[str, list[bytes]]], base: Mapping[str, str], least: int, gap: int, share: float) -> None:
        self.least, self.gap, self.share = least, gap, share
        self.templates = [(label, words) for label, words in templates if words]
        phrases = [(words_of(p), label) for p, label in base.items()]
        vocabulary = sorted({w for _, words in self.templates for w in words} | {w for p, _ in phrases for w in p})
        code = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.binary())
        self.phrases = [(np.array([code[w] for w in p]), label) for p, label in phrases if p]
        self.automaton = SuffixAutomaton([[code[w] for w in words] for _, words in self.templates])

    def spans(self, codes: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(begin, end, label, covered share of the template) in a document of these words (-1: in no template), but for spans inside another of their own label."""
        known = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]))).reshape(-1, 2)
        own: dict[int, list[Match]] = {}
        for a, b in known.tolist():
            if b - a >= self.least:
                for begin, end, state in self.automaton.maximal_matches(codes[a:b].tolist(), self.least):
                    for nth, last in self.automaton.places(state):
                        own.setdefault(nth, []).append(Match(a + begin, a + end, last + 1 - (end - begin)))
        found = []
        for nth, matches in own.items():
            label, words = self.templates[nth]
            for begin, end, covered in _chain(matches, len(words), self.gap):
                if covered >= self.share * len(words):
                    found.append((begin, end, label, covered / len(words)))
        kept: list[tuple[int, int, str, float]] = []
        end: dict[str, int] = {}
        for s in sorted(found, key=lambda s: (s[0], -s[1], -s[3])):
            if s[1] > end.get(s[2], -1):
                end[s[2]] = s[1]
                kept.append(s)
        return sorted(kept)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int | None, int | None, list[str], list[tuple[int, int, str, float]]]]:
        """(words, base places, first, last, base labels, spans) of each text."""
        folded = pa.array([t.encode("utf-8", "replace").translate(_FOLD).strip() if t else b"" for t in texts], pa.binary())
        split = pc.ascii_split_whitespace(folded.cast(pa.string()))
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        real = np.asarray(pc.not_equal(flat, ""))
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = pc.fill_null(pc.index_in(flat.filter(pa.array(real)).cast(pa.binary()), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        places, labels = [], []
        for phrase, label in self.phrases:
            n = len(codes) - len(phrase) + 1
            hit = np.flatnonzero(np.logical_and.reduce([codes[k : max(k, k + n)] == c for k, c in enumerate(phrase)])) if n > 0 else np.zeros(0, np.int64)
            doc = np.searchsorted(offsets, hit, "right") - 1
            hit = hit[hit + len(phrase) <= offsets[doc + 1]]
            places.append(hit)
            labels += [label] * len(hit)
        at, labels = np.concatenate([*places, np.zeros(0, np.int64)]), np.array(labels, object)
        order = np.argsort(at, kind="stable")
        at, labels = at[order], labels[order]
        bounds = np.searchsorted(at, offsets)
        # texts without a stretch of template words that is long enough have no spans
        changes = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]))).reshape(-1, 2)
        long = changes[changes[:, 1] - changes[:, 0] >= self.least]
        has = np.zeros(len(texts) + 1, np.int64)
        np.add.at(has, np.searchsorted(offsets, long[:, 0], "right") - 1, 1)
        np.add.at(has, np.searchsorted(offsets, long[:, 1], "left"), -1)
        has = np.cumsum(has)
        for k in range(len(texts)):
            o, e = int(offsets[k]), int(offsets[k + 1])
            own = at[bounds[k] : bounds[k + 1]]
            yield e - o, len(own), int(own[0]) - o if len(own) else None, int(own[-1]) - o if len(own) else None, sorted(set(labels[bounds[k] : bounds[k + 1]])), self.spans(codes[o:e]) if has[k] else []


_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])))])


def scan_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, *, base: Mapping[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text", least: int = 4, gap: int = 24, share: float = 0.75, most_words: int = 1 << 20) -> DataFrame:
    """Per document: n_words, n_base (places of base phrases), first_word and last_word (the first and last such place, from 0; else null), base_labels, labels (base ones and those of the spans; both distinct, sorted, joined by commas), score (the greatest covered share of a template, of at least ``share``; 0 without spans), spans (begin, end exclusive, label, share).

    Words are letters, digits and all beyond ASCII, with A-Z in lower case. ``least``: words of the shortest match; ``gap``: words that may be skipped between two matches of a chain, in the document as in the template. A null or empty text has no words, spans or labels. Repeated rows are judged each; other columns are not carried. Templates without words are never found; templates of one label may be several, equal ones count as one. Templates come from the program, ``most_words`` words of them at most (about 1 kB of automaton a word in each worker); more raise ValueError. No shuffle: each text is read once.
    """
    bound_batches(docs.sparkSession)
    own = list(dict.fromkeys((label, tuple(words_of(text))) for label, text in templates))
    if sum(len(words) for _, words in own) > most_words:
        raise ValueError(f"the templates have more than {most_words} words")
    name = uuid.uuid4().hex
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = dict(base)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = worker_cache(("licences", name), lambda: LicenceScanner([(label, list(words)) for label, words in own], base, least, gap, share))
        for batch in slices(batches, "text"):
            rows = list(scanner.scan(batch.column("text").to_pylist()))
            columns = [batch.column("id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([",".join(r[4]) for r in rows]), pa.array([",".join(sorted({*r[4], *(s[2] for s in r[5])})) for r in rows]), pa.array([max((s[3] for s in r[5]), default=0.0) for r in rows], pa.float64()), pa.array([[dict(zip(("begin", "end", "label", "share"), s, strict=True)) for s in r[5]] for r in rows], _OUT.field("spans").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<begin:bigint,end:bigint,label:string,share:double>>"
    return source.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
