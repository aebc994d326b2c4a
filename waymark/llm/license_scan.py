"""License scans: matching statistics of whole files against a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. A file streams through it word by word; the state and length
after each word are its matching statistics: the longest run of words ending there that some template has. A run that
can't grow in one of its templates is a match, with all places where the template has it; matches of one template that
come in the template's order, with small gaps, chain into a span, each place by the predecessor that makes it cover
most. The words of the template that a span covers decide whether its label holds. Base phrases are templates too: a
phrase stands wherever the automaton's state, or a state on its suffix links, is the phrase's.

Words are runs of digits, a-z (after lower-casing A-Z) and bytes from 0x80 on.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows stay; a text of any length
streams in one pass; other columns are not touched.
"""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_texts

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The usual ways to name a licence, public licence texts and the notices that licences ask for.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software."""),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with
        this program."""),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means."""),
]

#: Shortest match, in words, that joins a chain; most words between two matches of a chain; least share of a template
#: that gives its label, and the length up to which a template is a name that has to stand whole.
LEAST_MATCH, MOST_GAP, LEAST_SHARE, NAME = 3, 8, 0.6, 16

_WORD_OR_SPACE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_OR_SPACE).split()


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, list[int]] = field(default_factory=dict)  # by template: where the state's runs end in it
    phrase: int = -1  # the base phrase that is one of the state's runs
    phrases: tuple[int, ...] = ()  # base phrases on the state's suffix links, its own last


class Automaton:
    """Generalised suffix automaton of word numbers."""

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.states = [State()]
        self.templates = [[self.ids.setdefault(w, len(self.ids) + 1) for w in t] for t in templates]
        self.phrases = [[self.ids.setdefault(w, len(self.ids) + 1) for w in p] for p in phrases]
        for run in self.templates + self.phrases:
            last = 0
            for word in run:
                last = self._extend(last, word)
        for k, run in enumerate(self.templates):
            at = 0
            for i, word in enumerate(run):
                at = self.states[at].next[word]
                up = at
                while up > 0:
                    self.states[up].ends.setdefault(k, []).append(i)
                    up = self.states[up].link
        for k, run in enumerate(self.phrases):
            at = 0
            for word in run:
                at = self.states[at].next[word]
            self.states[at].phrase = k
        for s in sorted(range(1, len(self.states)), key=lambda s: self.states[s].length):
            state = self.states[s]
            state.phrases = self.states[state.link].phrases + ((state.phrase,) if state.phrase >= 0 else ())

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].next:
            old = states[last].next[word]
            return old if states[old].length == states[last].length + 1 else self._split(last, word, old)
        states.append(State(states[last].length + 1))
        new = len(states) - 1
        while last >= 0 and word not in states[last].next:
            states[last].next[word] = new
            last = states[last].link
        if last < 0:
            states[new].link = 0
        else:
            old = states[last].next[word]
            states[new].link = old if states[old].length == states[last].length + 1 else self._split(last, word, old)
        return new

    def _split(self, last: int, word: int, old: int) -> int:
        states = self.states
        states.append(State(states[last].length + 1, states[old].link, dict(states[old].next)))
        clone = len(states) - 1
        states[old].link = clone
        while last >= 0 and states[last].next.get(word) == old:
            states[last].next[word] = clone
            last = states[last].link
        return clone

    def stream(self, text: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places (start, phrase) of base phrases, and matches (end, length, state) that can't grow in some template."""
        places, matches, states = [], [], self.states
        numbers = list(map(self.ids.get, text))
        state, length = 0, 0
        for i, word in enumerate(numbers):
            if word is None:
                if length >= LEAST_MATCH:
                    matches.append((i - 1, length, state))
                state = length = 0
                continue
            before, then = length, state
            while state and word not in states[state].next:
                state = states[state].link
                length = states[state].length
            if word in states[state].next:
                state = states[state].next[word]
                length += 1
            else:
                length = 0
            # a template that does not go on as the text does has had its longest match here, though another goes on
            if before >= LEAST_MATCH and (length <= before or len(states[state].ends) < len(states[then].ends)):
                matches.append((i - 1, before, then))
            for k in states[state].phrases:
                if len(self.phrases[k]) <= length:
                    places.append((i + 1 - len(self.phrases[k]), k))
        if length >= LEAST_MATCH:
            matches.append((len(numbers) - 1, length, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains of matches: (template, first word, last word, covered words of the template).

        Of the chains of one template that share words of the text, the one that covers most is given.
        """
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: first word, last word, end in the template, covered
        closed: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, length, state in matches:
            start = end - length + 1
            for k, places in self.states[state].ends.items():
                waiting = [c for c in open_.get(k, ()) if start - c[1] <= MOST_GAP]
                closed.setdefault(k, []).extend(c for c in open_.get(k, ()) if start - c[1] > MOST_GAP)
                grown = []
                for there in places:
                    first = there - length + 1
                    best = (start, end, there, length)
                    for c in waiting:
                        if there > c[2] and first - c[2] <= MOST_GAP:
                            covered = c[3] + max(0, length - max(0, c[2] - first + 1, c[1] - start + 1))
                            if covered > best[3]:
                                best = (c[0], end, there, covered)
                    grown.append(best)
                open_[k] = waiting + grown
        out = []
        for k, chains in open_.items():
            kept: list[tuple[int, int, int, int]] = []  # in the order of the text, apart from each other
            for c in sorted(closed.get(k, []) + chains, key=lambda c: (-c[3], c[0], c[1])):
                at = bisect.bisect_right(kept, c[1], key=lambda o: o[0])
                if not at or kept[at - 1][1] < c[0]:
                    kept.insert(at, c)
            out += [(k, c[0], c[1], c[3]) for c in kept]
        return out


@functools.lru_cache(1)
def automaton() -> Automaton:
    return Automaton([words(t.encode()) for _, t in TEMPLATES], [p.encode().split() for p in BASE])


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    machine, base_labels = automaton(), list(BASE.values())
    found = words(text)
    places, matches = machine.stream(found)
    starts = [p for p, _ in places]
    base = {base_labels[k] for _, k in places}
    labels, spans, score = set(base), [], 1.0 if base else 0.0
    for k, first, last, covered in sorted(machine.spans(matches), key=lambda s: (s[1], s[2], s[0])):
        share = covered / len(machine.templates[k])
        if share >= (LEAST_SHARE if len(machine.templates[k]) > NAME else 1):
            labels.add(TEMPLATES[k][0])
            spans.append({"label": TEMPLATES[k][0], "first_word": first, "last_word": last, "covered": covered})
        score = max(score, min(1.0, share))
    return (
        len(found), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, spans,
    )


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: base places and labels, labels of covered templates, score, and the covered spans."""
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,covered:long>>"
    return map_texts(df, lambda texts: [scan(t) for t in texts], fields, key, text)
