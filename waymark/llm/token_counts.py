"""Exact token counts by dynamic programming over prefixes.

For a unit of bytes, prefix i's encoding ends in the one token that ends at i and holds beside the last token of the
prefix before it (two tokens hold if they are the encoding of their joined bytes). The count of prefix i is then one
more than that prefix's. So one pass stores the exact count at every prefix of a unit. A text is split into units by
the tokenizer's pattern first; the count at a byte of the text is the sum over the units before it and the prefix of
the unit that it falls in. This table (`prefix_counts` gives it, a number for every byte) answers a truncation or a
budget at any byte without encoding anything again.

Defined cases: a null or empty text has no tokens; the special string inside a text counts as one token, as the
library does by default, at each of its bytes; a prefix that ends inside a unit or a character counts that unit's first
bytes as they are; repeated rows and very long texts need
nothing special; other columns are not touched.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .byte_bpe import MergeRanks
from .common import map_texts
from .pretokens import Memo, Splitter


#: Words whose table is remembered, and as many older ones: some 300 bytes for each.
WORDS = 300_000


#: Bytes of a unit's beginning whose table units share, and such beginnings that are remembered, twice: some 400 bytes for each.
HEAD, HEADS = 5, 50_000


class PrefixCounts(MergeRanks):
    """last[i] and count[i]: the last token and the number of tokens of a unit's first i bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.heads = Memo(lambda piece: self._grown(piece, [-1], [0]), HEADS)

    def forget(self) -> None:
        super().forget()
        self.heads.forget()

    def prefixes(self, piece: bytes) -> tuple[list[int], list[int]]:
        if len(piece) <= HEAD:
            return self._grown(piece, [-1], [0])
        last, count = self.heads[piece[:HEAD]]
        return self._grown(piece, last.copy(), count.copy())

    def _grown(self, piece: bytes, last: list[int], count: list[int]) -> tuple[list[int], list[int]]:
        """The table of a piece, from that of its first bytes."""
        get, pairs, longest = self.ranks.get, self.pairs, self.longest
        for end in range(len(last), len(piece) + 1):
            # just one token fits: a prefix that is a token is that one, else the shortest are tried first
            token = get(piece[:end]) if end <= longest else None
            if token is not None:
                last.append(token)
                count.append(1)
                continue
            for start in range(end - 1, end - 1 - longest if end > longest else 0, -1):
                token = get(piece[start:end])
                if token is not None and pairs[last[start] << 20 | token]:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return last, count


#: (tokens, count at each of its bytes): what the table holds for a part of a text.
Part = tuple[int, array]


class TextCounts:
    """The table over prefixes of a whole text, part by part."""

    def __init__(self, path: str, pattern: str):
        model = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in model["added_tokens"]]
        self.dp = PrefixCounts(byte_ranks(model["model"]))
        self.splitter = Splitter(pattern, self._part, WORDS)

    def _part(self, units: list[str]) -> Part:
        at, tokens = array("i"), 0
        for unit in map(str.encode, units):
            if len(unit) == 1:  # a mark behind a word
                at.append(tokens + 1)
            else:
                counts = self.dp.prefixes(unit)[1]
                at.extend([tokens + c for c in counts[1:]] if tokens else counts[1:])
            tokens = at[-1]
        return tokens, at

    def parts(self, text: str) -> list[Part]:
        """Consecutive parts; each special string is a part of one token."""
        out: list[Part] = []
        pieces: list = [text]
        for token in self.special:
            pieces = [y for x in pieces for y in (_between(x, token) if isinstance(x, str) else [x])]
        for piece in pieces:
            out += self.splitter.parts(piece) if isinstance(piece, str) else [piece]
        return out

    def forget(self) -> None:
        """Empties the memos: a worker goes on to other partitions and stages."""
        self.splitter.forget()
        self.dp.forget()

    def count(self, text: str) -> int:
        return sum([p[0] for p in self.parts(text)])

    def table(self, text: str) -> np.ndarray:
        """Tokens of the first 1, 2, ... bytes."""
        parts = self.parts(text)
        if not parts:
            return np.zeros(0, np.int32)
        before = np.cumsum([0, *[p[0] for p in parts[:-1]]])
        return np.concatenate([np.frombuffer(p[1], np.int32) + b for p, b in zip(parts, before.tolist(), strict=True)])

    def budget(self, parts: list[Part], limit: int) -> int:
        """Bytes of the longest prefix that has at most `limit` tokens, by look-up in the table.

        Every part has a token, so the prefix ends in the first part whose end is beyond the limit, or before it.
        """
        size = 0
        for tokens, at in parts:
            if tokens > limit:
                return size + max([i + 1 for i, c in enumerate(at) if c <= limit], default=0)
            size, limit = size + len(at), limit - tokens
        return size


def _between(text: str, token: str) -> list:
    out: list = []
    whole = (1, array("i", [1] * len(token.encode())))
    for i, piece in enumerate(text.split(token)):
        out += [whole] * (i > 0) + [piece] * (piece != "")
    return out


def printable_bytes() -> dict[str, int]:
    """The byte behind each character of the library's printable form of bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_ranks(model: dict) -> dict[bytes, int]:
    """Merge ranks by bytes; bytes come first, then merges in order."""
    byte_of = printable_bytes()
    raw = lambda s: bytes([byte_of[c] for c in s])
    ranks = {bytes([b]): i for i, b in enumerate(range(256))}
    for i, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(raw(left) + raw(right), 256 + i)
    return ranks


@functools.lru_cache(2)
def counter(path: str, pattern: str) -> TextCounts:
    return TextCounts(path, pattern)


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit, and bytes_in_limit: the longest prefix that has at most `limit` tokens."""

    def rows(texts: list[bytes]) -> list[tuple]:
        of, out = counter(path, pattern), []
        for t in texts:
            parts = of.parts(t.decode())
            n = sum([p[0] for p in parts])
            out.append((len(t), n, n > limit, len(t) if n <= limit else of.budget(parts, limit)))
        return out

    return map_texts(df, rows, "n_bytes long, n_tokens long, over_limit boolean, bytes_in_limit long", key, text)


def prefix_counts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and counts: the tokens of every prefix of the text, one number for each byte."""
    return map_texts(df, lambda texts: [(counter(path, pattern).table(t.decode()),) for t in texts], "counts array<int>", key, text)
