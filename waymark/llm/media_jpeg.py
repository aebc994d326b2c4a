"""Media columns: payloads kept in baseline JPEGs, read back by marker parsing and Huffman decoding in numpy.

Each payload byte is one 8-bit luminance sample drawn as a flat 8x8 block: with a DC quantiser of 8 its DC coefficient
is the sample less 128, so the DC-only thumbnail of the picture is the payload itself, without loss. A thumbnail is 64
samples wide; every block row is a restart interval, which lets one numpy step decode a block of thousands of rows.
A payload of more than MOST_ROWS rows becomes several pictures, one after the other.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal media; repeated rows stay; other columns
of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

WIDTH = 64
#: A JPEG has at most 65535 lines of pixels, 8 to a block.
MOST_ROWS = 8191

# DC categories 0 to 8 have codes of 4 bits; the only AC symbol is the end of block, of 1 bit.
_DC_COUNTS, _DC_SYMBOLS = bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))
_AC_COUNTS, _AC_SYMBOLS = bytes([1] + [0] * 15), b"\x00"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
    _segment(0xDB, b"\x00" + bytes([8] * 64)),
    _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS) + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS),
    _segment(0xDD, struct.pack(">H", WIDTH)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
)


def _header(rows: int, note: bytes) -> bytes:
    app, quant, huffman, scan = _TABLES
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + app + _segment(0xFE, note) + quant + frame + huffman + scan


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of the code of a whole flat block, by DC difference + 255; then runs of 0 to 7 padding ones."""
    bits, length = np.zeros((511 + 8, 13), np.uint8), np.zeros(511 + 8, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        value = diff if diff > 0 else diff + (1 << size) - 1
        word = f"{size:04b}" + (f"{value:0{size}b}" if size else "") + "0"
        bits[diff + 255, : len(word)] = [int(b) for b in word]
        length[diff + 255] = len(word)
    for n in range(8):
        bits[511 + n, :n] = 1
        length[511 + n] = n
    return bits, length


_BITS, _LENGTH = _code_tables()
_MASK = np.arange(13) < _LENGTH[:, None]


def padded(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def encode(texts: list[bytes]) -> list[bytes]:
    """One media value for each text."""
    payloads = [padded(t) for t in texts]
    frames = []  # owner, rows
    for k, p in enumerate(payloads):
        rows = len(p) // WIDTH
        frames += [(k, min(MOST_ROWS, rows - at)) for at in range(0, rows, MOST_ROWS)]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH).astype(np.int16)
    index = np.empty((len(samples), WIDTH + 1), np.int16)
    index[:, 0] = samples[:, 0] - 128 + 255
    index[:, 1:WIDTH] = np.diff(samples, axis=1) + 255
    used = _LENGTH[index[:, :WIDTH]].sum(axis=1)
    index[:, WIDTH] = 511 + (-used) % 8
    row_bytes = (used + 7) // 8
    flat = index.ravel()
    packed = np.packbits(_BITS[flat][_MASK[flat]])
    # zero bytes go in behind 0xFF, and restart markers between the rows of a frame
    counts = np.array([n for _, n in frames])
    first_row = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(len(samples)) - np.repeat(first_row[:-1], counts)
    last = np.cumsum(row_bytes) - 1
    between = np.ones(len(samples), bool)
    between[first_row[1:] - 1] = False
    full = packed == 255
    extra = full.astype(np.int64)
    extra[last[between]] += 2
    place = np.arange(len(packed)) + np.cumsum(extra) - extra
    out = np.zeros(len(packed) + int(extra.sum()), np.uint8)
    out[place] = packed
    marks = place[last[between]] + 1 + full[last[between]]
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + number[between] % 8
    ends = place[last[first_row[1:] - 1]] + 1 + full[last[first_row[1:] - 1]]
    scans, media, at = out.tobytes(), [b""] * len(texts), 0
    for (k, rows), end in zip(frames, ends.tolist(), strict=True):
        media[k] += _header(rows, b"bytes=%d" % len(texts[k])) + scans[at:end] + b"\xff\xd9"
        at = end
    return media


@functools.lru_cache(16)
def _codes(spec: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code) of a Huffman table as a DHT segment gives it."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for symbol in spec[at : at + spec[length - 1]]:
            out[length, code] = symbol
            code += 1
        at += spec[length - 1]
        code <<= 1
    return out


@functools.lru_cache(16)
def _flat_blocks(dc: bytes, ac: bytes) -> np.ndarray:
    """By the next 16 bits: (difference + 2048) * 32 + length of a block of one DC code and the end of block, else 0."""
    lookup = np.zeros(1 << 16, np.int32)
    ends = [(n, c) for (n, c), symbol in _codes(ac).items() if symbol == 0]
    for (n, code), size in _codes(dc).items():
        for m, end in ends:
            total = n + size + m
            if total > 16 or size > 11:
                continue
            for value in range(1 << size):
                diff = value if size and value >> (size - 1) else value - (1 << size) + 1
                word = ((code << size | value) << m | end) << (16 - total)
                lookup[word : word + (1 << (16 - total))] = (diff + 2048) * 32 + total
    return lookup


def _slow_block(data: bytes, bit: int, dc: bytes, ac: bytes) -> tuple[int, int]:
    """DC difference of a block with any AC coefficients, and the bit behind the block."""

    def take(n: int) -> int:
        nonlocal bit
        chunk = int.from_bytes(data[bit >> 3 : (bit >> 3) + 5].ljust(5, b"\xff"), "big")
        bit += n
        return (chunk >> (40 - ((bit - n) & 7) - n)) & ((1 << n) - 1)

    def symbol(spec: bytes) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in _codes(spec):
                return _codes(spec)[n, code]
        raise ValueError("no such Huffman code")

    size = symbol(dc)
    value = take(size) if size else 0
    diff = value if size and value >> (size - 1) else value - (1 << size) + 1
    k = 1
    while k < 64:
        s = symbol(ac)
        if s == 0:
            break
        take(s & 15)
        k += 16 if s == 0xF0 else (s >> 4) + 1
    return diff, bit


def parse(media: bytes) -> list[dict]:
    """The pictures of a media value: size, tables, comment and place of the scan of each."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("a picture begins with SOI")
        at += 2
        got: dict = {"restart": 0, "note": b"", "tables": {}, "quant": {}}
        while True:
            marker, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xC0:
                got["height"], got["width"] = struct.unpack(">HH", body[1:5])
                got["q"] = body[8]
                if body[0] != 8 or body[5] != 1:
                    raise ValueError("one component of 8 bits is read")
            elif marker == 0xDB:
                for i in range(0, len(body), 65):
                    got["quant"][body[i] & 15] = body[i + 1 : i + 65]
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = 17 + sum(body[i + 1 : i + 17])
                    got["tables"][body[i]] = body[i + 1 : i + n]
                    i += n
            elif marker == 0xDD:
                got["restart"] = int.from_bytes(body, "big")
            elif marker == 0xFE:
                got["note"] = body
            elif marker == 0xDA:
                got["dc"], got["ac"] = got["tables"][body[2] >> 4], got["tables"][16 + (body[2] & 15)]
                break
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("baseline only")
        end = media.find(b"\xff\xd9", at)
        got["scan"] = (at, end)
        out.append(got)
        at = end + 2
    return out


def thumbnails(media: list[bytes]) -> list[tuple[list[np.ndarray], bytes]]:
    """DC-only luminance thumbnails of each media value's pictures, and its comment."""
    parsed = [parse(m) for m in media]
    work: dict[tuple, list] = {}
    for k, pictures in enumerate(parsed):
        for i, p in enumerate(pictures):
            work.setdefault((p["dc"], p["ac"]), []).append((k, i))
    found: dict[tuple[int, int], np.ndarray] = {}
    for (dc, ac), owners in work.items():
        scans = [media[k][slice(*parsed[k][i]["scan"])] for k, i in owners]
        for (k, i), dcs in zip(owners, _decode(scans, [parsed[k][i] for k, i in owners], dc, ac), strict=True):
            p = parsed[k][i]
            pixels = np.clip((dcs * p["quant"][p["q"]][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
            found[k, i] = pixels.reshape(-1, -(-p["width"] // 8))
    return [([found[k, i] for i in range(len(p))], p[0]["note"]) for k, p in enumerate(parsed)]


def _decode(scans: list[bytes], about: list[dict], dc: bytes, ac: bytes) -> list[np.ndarray]:
    """DC coefficients of the blocks of each scan; all restart intervals of all scans advance together."""
    raw = np.frombuffer(b"".join(scans) + b"\x00", np.uint8)
    full = raw[:-1] == 255
    behind = raw[1:]
    zero = np.flatnonzero(full & (behind == 0)) + 1
    mark = np.flatnonzero(full & (behind >= 0xD0) & (behind <= 0xD7))
    scan_at = np.cumsum([0, *map(len, scans)])
    zero = zero[~np.isin(zero, scan_at)]
    keep = np.ones(len(raw) - 1, bool)
    keep[zero] = False
    keep[mark] = False
    keep[mark + 1] = False
    starts = np.sort(np.concatenate([scan_at[:-1], mark + 2]))
    compact = np.concatenate([[0], np.cumsum(keep)])
    data = np.concatenate([raw[:-1][keep], np.full(4, 255, np.uint8)])
    window = (data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]
    whole = None
    counts = []
    for p in about:
        blocks = -(-p["width"] // 8) * -(-p["height"] // 8)
        step = p["restart"] or blocks
        counts += [min(step, blocks - at) for at in range(0, blocks, step)]
    counts = np.array(counts)
    if len(counts) != len(starts):
        raise ValueError("restart markers and picture sizes differ")
    place = compact[starts] * 8
    order = np.argsort(-counts, kind="stable")
    place, left = place[order], counts[order]
    steps = int(left[0]) if len(left) else 0
    values = np.zeros((len(left), steps), np.int32)
    last = np.zeros(len(left), np.int32)
    lookup = _flat_blocks(dc, ac)
    for j in range(steps):
        n = int(np.searchsorted(-left, -j, side="left"))  # intervals with more than j blocks come first
        at = place[:n]
        got = lookup[(window[at >> 3] >> (8 - (at & 7))) & 0xFFFF]
        slow = np.flatnonzero(got == 0)
        diff, length = (got >> 5) - 2048, got & 31
        for x in slow.tolist():
            whole = data.tobytes() if whole is None else whole
            diff[x], end = _slow_block(whole, int(at[x]), dc, ac)
            length[x] = end - at[x]
        last[:n] += diff
        values[:n, j] = last[:n]
        place[:n] += length
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out, at = [], 0
    for p in about:
        blocks = -(-p["width"] // 8) * -(-p["height"] // 8)
        n = -(-blocks // (p["restart"] or blocks))
        rows = back[at : at + n]
        out.append(values[rows].ravel()[:blocks] if blocks % n == 0 and counts[at] == counts[at + n - 1] and counts[at] == steps else np.concatenate([values[r, : counts[at + i]] for i, r in enumerate(rows)]))
        at += n
    return out


def thumbnail_hash(picture: np.ndarray) -> str:
    """Average hash: 8x8 means against their mean, as 16 hex digits."""
    height, width = picture.shape
    rows = np.add.reduceat(picture.astype(np.int64), np.minimum(np.arange(8) * height // 8, height - 1), axis=0)
    cells = np.add.reduceat(rows, np.minimum(np.arange(8) * width // 8, width - 1), axis=1)
    tall = np.maximum(np.diff(np.append(np.arange(8) * height // 8, height)), 1)
    wide = np.maximum(np.diff(np.append(np.arange(8) * width // 8, width)), 1)
    means = cells / tall[:, None] / wide
    return np.packbits(means.ravel() > means.mean()).tobytes().hex()


def _encode_rows(texts: list[bytes]) -> list[tuple]:
    return [(len(t), m) for t, m in zip(texts, encode(texts), strict=True)]


def _read_rows(media: list[bytes]) -> list[tuple]:
    out = []
    for m, (pictures, _) in zip(media, thumbnails(media), strict=True):
        payload = b"".join(p.tobytes() for p in pictures)
        out.append((
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(),
            ",".join(f"{p.shape[1]}x{p.shape[0]}:{thumbnail_hash(p)}" for p in pictures),
            pictures[0].shape[1] * 8, sum(p.shape[0] for p in pictures) * 8,
        ))
    return out


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes of the text, and `media`: its payload as JPEG."""
    return map_texts(df, _encode_rows, "n_bytes long, media binary", key, text)


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Decode the media column and describe the payload, the stored form and the thumbnails."""
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
    return map_texts(df, _read_rows, fields, key, media, keep)
