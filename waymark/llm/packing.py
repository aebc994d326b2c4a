"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (and an end id) are cut into whole windows of `capacity` ids and a remainder. Whole windows are
sequences of their own. Remainders are dealt to groups of about GROUP rows by a hash of their row, and each group is
partitioned into windows by differencing: the two partial partitions with the largest spread are merged, the fullest
window of one with the emptiest of the other, until one partition is left. Its windows are nearly equal. The number of
windows starts at the least that could hold the group and rises whenever the fullest exceeds the capacity.

Windows come out even only if there are small pieces to even them out, so a share of a group's remainders (one in four;
if the windows rise by more than a hundredth, one in two, then all) is cut into halves, quarters and so on. The CRCs of
these pieces are made along with the ids: only lengths and CRCs are shuffled, no ids and no texts.

A sequence counts as padded up to the capacity, unless its length is a power of two. Sequences are numbered by group.

Defined cases: a null or empty text has the end id alone; the special string inside a text is one id, as in the library;
repeated rows (and repeated keys) are packed each for itself; very long texts give many windows of their own; a null key
stays null; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .token_counts import printable_bytes

#: Remainders of a group. More even out better, and the work of a group grows with its square.
GROUP = 512
#: Pieces of a cut remainder are halved down to this length.
SAND = 8
#: Shares of a group's remainders that are cut, one in so many, and the rise of windows that is put up with.
CUTS, RISE = (4, 2, 1), 0.01


class TokenIds:
    """Ids of whole texts as bytes (unsigned 32 bits, little-endian), as the tokenizers library gives them for the file.

    Merging goes by the ids of joined bytes, which equals the file's list of merges if ids rise along the list: this
    is looked at.
    """

    def __init__(self, path: str, pattern: str):
        model = json.load(open(path, encoding="utf-8"))
        raw = printable_bytes()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(map(raw.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}
        made = [ranks[bytes(map(raw.__getitem__, "".join(m.split(" ") if isinstance(m, str) else m)))] for m in model["model"]["merges"]]
        if made != sorted(set(made)):
            raise ValueError(f"{path}: ids do not rise along the merges")
        self.library = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _plain(self, text: str) -> bytes:
        if _LONG_SPACE.search(text):  # the library's own search for units does not stand such runs
            return _bytes([i for unit in self.pattern.findall(text) for i in self.library._encode_single_piece(unit)])
        return _bytes(self.library.encode_ordinary(text))

    def of(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        pieces = self.cut.split(text)
        return b"".join(_bytes([self.special[p]]) if i % 2 else self._plain(p) for i, p in enumerate(pieces))


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_LONG_SPACE = re.compile(r"\s{2000}")


@functools.lru_cache(2)
def token_ids(path: str, pattern: str) -> TokenIds:
    return TokenIds(path, pattern)


def halves(length: int) -> list[int]:
    """Lengths that add up to `length`: a half, a quarter, ... down to SAND."""
    out = []
    while length > SAND:
        out.append(length - length // 2)
        length //= 2
    return [*out, length] if length else out


def _cut(ids: bytes, capacity: int) -> tuple[int, list[int], int, list[int], list[int]]:
    """Ids of a document, CRCs of its whole windows, CRC of the remainder, lengths and CRCs of the remainder's pieces."""
    n, view = len(ids) // 4, memoryview(ids)
    whole = n // capacity
    full = [zlib.crc32(view[4 * capacity * i : 4 * capacity * (i + 1)]) for i in range(whole)]
    sizes = halves(n - whole * capacity)
    ends = np.cumsum([whole * capacity, *sizes]).tolist()
    return n, full, zlib.crc32(view[4 * whole * capacity :]), sizes, [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size: multiway differencing into so many windows of nearly equal sums.

    A partial partition is its windows' sums, descending and less the least of them, and for each window the node of a
    tree of merges. Windows that have nothing yet are left out, so the first merges are short.
    """
    n = len(sizes)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes = n
    while len(heap) > 1:
        _, tick, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            sums, at = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            # the last `over` windows of a meet the last of b, the fullest with the emptiest
            rest, rest_nodes = b[::-1], b_nodes[::-1]
            sums = np.concatenate([a, rest[over:]])
            sums[len(a) - over : len(a)] += rest[:over]
            made = np.arange(nodes, nodes + over)
            merges.append((made, a_nodes[len(a) - over :], rest_nodes[:over]))
            at = np.concatenate([a_nodes[: len(a) - over], made, rest_nodes[over:]])
            nodes += over
        order = np.argsort(-sums, kind="stable")
        sums, at = sums[order], at[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), n + tick, sums, at))
    window = np.zeros(nodes, np.int64)
    if n:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for made, left, right in reversed(merges):
        window[left] = window[right] = window[made]
    return window[:n]


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each size (none over capacity) and the number of windows."""
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, windows)
        fullest = int(np.bincount(window, sizes, windows).max()) if len(sizes) else 0
        if fullest <= capacity:
            return window, windows
        windows += max(1, windows * (fullest - capacity) // (4 * capacity))


def _pack_group(rows: pd.DataFrame, key: str, capacity: int) -> pd.DataFrame:
    """All pieces of the group's documents with their windows."""
    rows = rows.sort_values("_row", ignore_index=True)
    group = int(rows["_group"].iloc[0])
    total, full = rows["doc_tokens"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in rows["full"]]
    start = np.array([len(x) * capacity for x in full], np.int64)
    rest = total - start
    least = max(1, -(-int(rest.sum()) // capacity))
    for one_in in CUTS:
        doc, size, crc = [], [], []
        for i in np.flatnonzero(rest):
            sizes, crcs = (rows["sizes"][i], rows["crcs"][i]) if i % one_in == 0 else ([rest[i]], [rows["crc"][i]])
            doc += [i] * len(sizes)
            size += list(sizes)
            crc += list(crcs)
        doc, size, crc = np.array(doc, np.int64), np.array(size, np.int64), np.array(crc, np.int64)
        window, windows = fill(size, capacity)
        if windows <= least * (1 + RISE) + 1:
            break
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    before = np.cumsum(size) - size
    at = start[doc] + before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(doc)]))
    order = np.argsort(window, kind="stable")
    filled = np.cumsum(size[order]) - size[order]
    begins = np.searchsorted(window[order], window[order])
    offset = np.empty(len(doc), np.int64)
    offset[order] = filled - filled[begins] if len(doc) else 0
    whole = np.repeat(np.arange(len(full)), [len(x) for x in full])
    nth = np.concatenate([np.arange(len(x)) for x in full]) if len(full) else np.zeros(0, np.int64)
    docs = np.concatenate([doc, whole])
    return pd.DataFrame({
        key: rows[key].take(docs).array, "start": np.concatenate([at, nth * capacity]), "length": np.concatenate([size, np.full(len(whole), capacity)]),
        "ids_crc32": np.concatenate([crc, *full]), "doc_tokens": total[docs],
        "sequence_id": (group << 32) + np.concatenate([window, windows + np.arange(len(whole))]), "offset": np.concatenate([offset, np.zeros(len(whole), np.int64)]),
    })


def pack(df: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    end = _bytes([end_id])

    def measured(texts: list[bytes]) -> list[tuple]:
        of = token_ids(path, pattern).of
        return [_cut(of(t.decode()) + end, capacity) for t in texts]

    rows = df.select(F.col(key), F.col(text), F.monotonically_increasing_id().alias("_row"))
    fields = "doc_tokens long, full array<long>, crc long, sizes array<int>, crcs array<long>"
    rows = written(map_texts(rows, measured, fields, key, text, ("_row",)), "lengths")
    groups = max(1, -(-rows.count() // GROUP))
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    head = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    out = f"{head}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return grouped.groupBy("_group").applyInPandas(lambda g: _pack_group(g, key, capacity), out)
