"""Raster tiles as GeoTIFF: one band in strips, stored plainly or deflated, with TIFF's predictors 1, 2 and 3.

Decoding works on whole strips with numpy; a tile is read once as a matrix, and never as rows of a table.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: field types (size, struct code) and the tags that are read here.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, SIZES, PREDICTOR, TILE_WIDTH, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PLAIN, DEFLATE = (1,), (8, 32946)
#: Values at or beyond this are no heights.
LIMIT = 1e30


@dataclass
class Tile:
    """z: rows from north to south, NaN where nothing is known; x0, y_top: the outer corner in the north-west."""

    z: np.ndarray
    x0: float
    y_top: float
    dx: float
    dy: float
    epsg: int | None = None

    def sample(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bilinear between cell centres; the outermost centres hold up to the tile's edge. NaN outside, or beside a gap."""
        rows, columns = self.z.shape
        across, down = (x - self.x0) / self.dx, (self.y_top - y) / self.dy
        ok = (across >= 0) & (across <= columns) & (down >= 0) & (down <= rows)
        u, v = (np.clip(np.where(ok, p, 0.5) - 0.5, 0, n - 1) for p, n in ((across, columns), (down, rows)))
        c, r = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        c2, r2 = np.minimum(c + 1, columns - 1), np.minimum(r + 1, rows - 1)
        north = self.z[r, c] + (u - c) * (self.z[r, c2] - self.z[r, c])
        south = self.z[r2, c] + (u - c) * (self.z[r2, c2] - self.z[r2, c])
        return np.where(ok, north + (v - r) * (south - north), np.nan)


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", raw, entry)
        if kind not in KINDS:
            continue
        size, code = KINDS[kind]
        place = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", raw, entry + 8)[0]
        tags[tag] = struct.unpack_from(f"{order}{count}{code}" if code != "II" else f"{order}{2 * count}I", raw, place)
    return order, tags


def _strip(data: bytes, width: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """The rows of a strip. Differences along a row are summed in the samples' own width, and so wrap as they should."""
    size = kind.itemsize
    if len(data) % (width * size):
        raise ValueError("a strip does not hold whole rows")
    if predictor == 1:
        return np.frombuffer(data, kind).reshape(-1, width)
    if predictor == 2:
        whole = np.dtype(f"{kind.byteorder}u{size}")
        rows = np.frombuffer(data, whole).reshape(-1, width)
        return np.cumsum(rows, axis=1, dtype=np.dtype(f"u{size}")).astype(whole).view(kind)
    # bytes of all samples by significance, the highest first, as differences along the row
    planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, width * size), axis=1, dtype=np.uint8).reshape(-1, size, width)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}")[..., 0]


def decode(raw: bytes, epsg: int | None = None) -> Tile:
    """The tile of a GeoTIFF. With epsg, a tile that names another projection raises an error."""
    order, tags = _tags(raw)
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, bits = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1)
    form, predictor, packing = one(SAMPLE_FORMAT, 1), one(PREDICTOR, 1), one(COMPRESSION, 1)
    if TILE_WIDTH in tags or one(SAMPLES, 1) != 1 or bits not in (8, 16, 32, 64) or packing not in PLAIN + DEFLATE or predictor not in (1, 2, 3) or (predictor == 3 and form != 3):
        raise ValueError("a layout of TIFF that is not read here")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    strips = [raw[at : at + n] for at, n in zip(tags[STRIPS], tags[SIZES], strict=True)]
    rows = [_strip(zlib.decompress(s) if packing in DEFLATE else s, width, kind, predictor) for s in strips]
    z = np.concatenate(rows)[:height].astype(np.float32)
    if z.shape != (height, width):
        raise ValueError(f"{z.shape} cells in place of {(height, width)}")
    z[~(np.abs(z) < LIMIT)] = np.nan
    try:
        z[z == np.float32(b"".join(tags[NODATA]).split(b"\0")[0].decode().strip(' "'))] = np.nan
    except (KeyError, ValueError):
        pass
    keys = np.array(tags.get(GEO_KEYS, ()), np.int64)[4:].reshape(-1, 4)
    named = next((int(k[3]) for k in keys if k[0] in (3072, 2048)), None)
    if epsg is not None and named != epsg:
        raise ValueError(f"a tile in projection {named} in place of {epsg}")
    if SCALE in tags and TIE in tags:
        (dx, dy, *_), (column, row, _, x, y, *_) = tags[SCALE], tags[TIE]
        return Tile(z, x - column * dx, y + row * dy, dx, dy, named)
    m = tags.get(MATRIX, ())
    if len(m) < 8 or m[1] or m[4] or not m[5]:
        raise ValueError("the tile does not say where it lies")
    return Tile(z, m[3], m[7], m[0], -m[5], named)


def encode(tile: Tile, predictor: int = 3, deflate: bool = True, nodata: float | None = -9999.0, rows: int = 16, order: str = "<") -> bytes:
    """A GeoTIFF of 32-bit floats for the tile: what decode reads."""
    z = np.where(np.isnan(tile.z), np.nan if nodata is None else nodata, tile.z).astype(f"{order}f4")
    height, width = z.shape
    strips = []
    for lo in range(0, height, rows):
        part = np.ascontiguousarray(z[lo : lo + rows])
        if predictor == 2:
            whole = part.view(f"{order}u4")
            part = np.diff(whole.astype(np.uint32), axis=1, prepend=np.uint32(0)).astype(f"{order}u4")
        elif predictor == 3:
            planes = part.astype(">f4").view(np.uint8).reshape(len(part), width, 4).transpose(0, 2, 1).reshape(len(part), -1)
            part = np.diff(planes, axis=1, prepend=np.uint8(0))
        strips.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    fields: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,)), (COMPRESSION, 3, (8 if deflate else 1,)), (STRIPS, 4, (0,) * len(strips)), (SAMPLES, 3, (1,)), (ROWS, 4, (rows,)),
        (SIZES, 4, tuple(map(len, strips))), (PREDICTOR, 3, (predictor,)), (SAMPLE_FORMAT, 3, (3,)), (SCALE, 12, (tile.dx, tile.dy, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, tile.x0, tile.y_top, 0.0)),
    ]
    if tile.epsg is not None:
        fields.append((GEO_KEYS, 3, (1, 1, 0, 1, 3072, 0, 1, tile.epsg)))
    if nodata is not None:
        fields.append((NODATA, 2, str(nodata).encode() + b"\0"))
    at = 8 + 2 + 12 * len(fields) + 4
    packed = {t: v if isinstance(v, bytes) else struct.pack(f"{order}{len(v)}{KINDS[k][1]}", *v) for t, k, v in fields}
    begin = at + sum(len(p) for p in packed.values() if len(p) > 4)
    packed[STRIPS] = struct.pack(f"{order}{len(strips)}I", *(begin + sum(map(len, strips[:i])) for i in range(len(strips))))
    out, after = [], b""
    for tag, kind, value in fields:
        data = packed[tag]
        out.append(struct.pack(f"{order}HHI", tag, kind, len(value)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", at + len(after))))
        after += data if len(data) > 4 else b""
    magic = b"II" if order == "<" else b"MM"
    return magic + struct.pack(f"{order}HIH", 42, 8, len(fields)) + b"".join(out) + struct.pack(f"{order}I", 0) + after + b"".join(strips)
