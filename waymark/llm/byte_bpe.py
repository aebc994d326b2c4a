"""Byte-level BPE encoding and decoding as a reduction over a tree of halves.

Encodings of pieces of bytes form a monoid. A piece is encoded by encoding its halves and joining the two lists of
tokens. A join encodes a window around the boundary anew and widens it until the tokens outside provably stay: a list
of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of their joined bytes, so once
both pairs at the window's edges pass that test, nothing outside can change. A side that fails is widened by twice as
many tokens each time, and a window is merged from a heap, so a join costs n log n at worst. The left half is the
greatest power of two of characters (of bytes in short units): runs of equal characters, whose tokens are cut
from the left, then fall on the halves' boundary and need no widening. Decoding concatenates up the tree.

A text is first split by the tokenizer's pattern; units never merge across its matches, so joining the lists of units
is concatenation. Memos are bounded in keys and in their length. The vocabulary file is a parameter and is read once in
each worker.

Defined cases: a null or empty text has no tokens (the SHA-256 values of nothing); special tokens are ordinary text;
repeated rows need nothing special; a text or a unit of any length is encoded as a whole, a unit of a million equal
characters in seconds; other columns are not touched.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .pretokens import Memo, Splitter


_NONE = 1 << 40
#: Bytes up to which plain scanning merges faster than a heap.
_FEW = 48
#: Pairs of tokens that are remembered, twice: some 50 MB.
PAIRS = 200_000
#: Bytes of a piece whose encoding is remembered.
SHORT = 4


class MergeRanks:
    """Ranks of a tiktoken file; merge(piece) is lowest-rank merging of a window."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.windows = Memo(self.merge, 50_000)
        self.pairs = Memo(self._holds, PAIRS)
        self.halves: dict[int, tuple[int, int]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > _FEW:
            return self._merge_many(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best == _NONE:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_many(self, piece: bytes) -> tuple[int, ...]:
        """The same from a heap of (rank, start), over parts that know where the next one starts."""
        n, get = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if middle == -1 or middle >= n or after[middle] != end:
                continue  # one of the two parts has merged otherwise
            after[middle] = -1
            after[i] = end
            if end < n:
                before[end] = i
                rank = get(piece[i : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            left = before[i]
            if left >= 0:
                rank = get(piece[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def forget(self) -> None:
        self.windows.forget()
        self.pairs.forget()

    def _holds(self, pair: int) -> bool:
        """Whether two tokens are the encoding of their joined bytes: merges are undone from the latest on.

        Nothing merges across the boundary if, of what lies beside it at any time, no merge is earlier than the one that
        takes it away.
        """
        get, bytes_of, halves = self.ranks.get, self.bytes_of, self._halves
        left, right, latest = pair >> 20, pair & 0xFFFFF, _NONE
        while True:
            if get(bytes_of[left] + bytes_of[right], _NONE) < latest:
                return False
            if left > right:
                order = ((0, left), (1, right))
            else:
                order = ((1, right), (0, left))
            for side, token in order:
                part = halves(token)[1 - side]
                if part != token:
                    break
            else:
                return True
            if side:
                right, latest = part, token + 1
            else:
                left, latest = part, token

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives a token; a byte is its own halves."""
        got = self.halves.get(token)
        if got is None:
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                found = [self.ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
                at = found.index(min(found))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.halves[token] = self.ranks[parts[0]], self.ranks[parts[-1]]
        return got


class Encoder(MergeRanks):
    """Encodes units by halves and joins."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.short: dict[bytes, tuple[int, ...]] = {}

    def forget(self) -> None:
        super().forget()
        self.short.clear()

    def encode(self, unit: str) -> tuple[int, ...]:
        if len(unit) <= 32 or unit.isascii():
            return self._encode(unit.encode())
        if len(unit) <= self.longest and (rank := self.ranks.get(unit.encode())) is not None:
            return (rank,)
        half = 1 << ((len(unit) - 1).bit_length() - 1)
        return self.join(self.encode(unit[:half]), self.encode(unit[half:]))

    def _encode(self, piece: bytes) -> tuple[int, ...]:
        got = self.short.get(piece)
        if got is not None:
            return got
        rank = self.ranks.get(piece)
        if rank is not None:
            got = (rank,)
        elif not piece:
            return ()
        else:
            half = 1 << ((len(piece) - 1).bit_length() - 1)
            got = self.join(self._encode(piece[:half]), self._encode(piece[half:]))
        if len(piece) <= SHORT:
            if len(self.short) >= 100_000:
                self.short.clear()
            self.short[piece] = got
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both pieces' bytes together."""
        if not left or not right:
            return left or right
        pairs = self.pairs
        if pairs[left[-1] << 20 | right[0]]:
            return left + right
        bytes_of, i, j = self.bytes_of, len(left) - 1, 1  # the window is left[i:] and right[:j]
        more_left = more_right = 1
        while True:
            window = self.windows[b"".join([bytes_of[x] for x in left[i:] + right[:j]])]
            left_holds = i == 0 or pairs[left[i - 1] << 20 | window[0]]
            right_holds = j == len(right) or pairs[window[-1] << 20 | right[j]]
            if left_holds and right_holds:
                return left[:i] + window + right[j:]
            if not left_holds:
                i, more_left = max(0, i - more_left), 2 * more_left
            if not right_holds:
                j, more_right = min(len(right), j + more_right), 2 * more_right

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """Concatenates up the tree."""
        if len(ids) <= 256:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TextCodec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, pattern: str):
        self.encoder = Encoder(read_ranks(path))
        self.splitter = Splitter(pattern, self._subtree)
        self.shown = [str(i) for i in range(1 + max(self.encoder.bytes_of))]

    def _subtree(self, units: list[str]) -> tuple[int, ...]:
        """A part's ids."""
        if len(units) == 1:
            return self.encoder.encode(units[0])
        return tuple(chain.from_iterable(map(self.encoder.encode, units)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.splitter.parts(text)))

    def decode(self, ids: list[int]) -> bytes:
        return self.encoder.decode(tuple(ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Tokens, SHA-256 of the ids as decimal numbers joined by spaces, SHA-256 of the decoded bytes."""
        ids = self.encode(text)
        return len(ids), hashlib.sha256(" ".join(map(self.shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()

    def forget(self) -> None:
        """Empties the memos: a worker goes on to other partitions and stages."""
        self.splitter.forget()
        self.encoder.forget()


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> TextCodec:
    return TextCodec(path, pattern)


def encode_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def rows(texts: list[bytes]) -> list[tuple]:
        digest = codec(path, pattern).digest
        return [digest(t.decode()) for t in texts]

    return map_texts(df, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)


def encode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the `keep` columns and the token ids of every whole text."""

    def rows(texts: list[bytes]) -> list[tuple]:
        encode = codec(path, pattern).encode
        return [(ids, len(ids)) for ids in (encode(t.decode()) for t in texts)]

    return map_texts(df, rows, "ids array<int>, n_tokens long", key, text, keep, lambda: codec(path, pattern).forget())


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the bytes that the ids stand for (null ids: no bytes)."""

    @F.pandas_udf("binary")
    def decoded(values: pd.Series) -> pd.Series:
        bytes_of = Encoder(read_ranks(path)).decode
        return values.map(lambda v: b"" if v is None else bytes_of(tuple(v.tolist())))

    return df.select(key, decoded(F.col(ids)).alias("decoded"))
