"""Splitting text into the units that byte-level BPE encodes one by one, with a memo by space-separated part.

A single space or line feed between characters other than white space always begins a unit: ` ?` takes such a space
into the next unit, and such a line feed is a unit of its own. So a tidy text falls into parts (a word with the space
before it) that can be split and encoded alone and remembered; any other text is split as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

_UNTIDY = re.compile(r"[ \n](?=\s|\Z)|\A\s")
#: White space that the two regular expression libraries may class differently: such texts are split as a whole.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85᠎]")


class Memo(dict):
    """Remembers function(key) for keys of at most `longest` items, the newest `most` keys and what is left of as many before.

    Both bounds together bound its memory: some 80 MB for 150,000 words.
    """

    def __init__(self, function: Callable, most: int = 50_000, longest: int = 48):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest
        self.older: dict = {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.function(key)
        if isinstance(key, int) or len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Splitter:
    """parts(text) gives for each part of the text what `combine` makes of its units."""

    def __init__(self, pattern: str, combine: Callable[[list[str]], object], words: int = 150_000):
        self.pattern = regex.compile(pattern)
        self.combine = combine
        self.first = Memo(self._part)
        self.spaced = Memo(lambda word: self._part(" " + word), words)

    def forget(self) -> None:
        self.first.forget()
        self.spaced.forget()

    def _part(self, part: str) -> object:
        word = part[1:] if part[:1] == " " else part
        if word.isascii():  # letters, or letters and one mark behind them, need no pattern
            if word.isalpha():
                return self.combine([part])
            if word[-1:] in ".,;:" and word[:-1].isalpha():
                return self.combine([part[:-1], part[-1]])
        return self.combine(self.pattern.findall(part))

    def parts(self, text: str) -> list:
        if not text:
            return []
        if _UNTIDY.search(text) or _ODD_SPACE.search(text):
            return [self.combine([unit]) for unit in self.pattern.findall(text)]
        first, spaced, out = self.first.__getitem__, self.spaced.__getitem__, []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(first("\n"))
            words = line.split(" ")
            out.append(first(words[0]))
            out += map(spaced, words[1:])
        return out
