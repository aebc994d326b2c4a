"""Geometry blobs of a GeoPackage, or plain WKB, decoded by offsets over a whole Arrow batch: boxes, cell centres and lines.

Defined cases: null, short and foreign blobs and kinds of geometry that are not read give null; both byte orders may be
mixed in a column; further dimensions of an envelope are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: bytes of an envelope by its kind, and WKB's kinds that are read.
ENVELOPE = np.array([0, 32, 48, 48, 64, -1, -1, -1])
POINT, LINE, POLYGON = 1, 2, 3


class Blobs:
    """A binary column as one array of bytes with the begin and the end of each blob."""

    def __init__(self, column: pa.Array):
        column = pa.concat_arrays([column.cast(pa.large_binary())])  # without an offset
        self.n = len(column)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[: self.n + 1] if self.n else np.zeros(1, np.int64)
        self.data = np.concatenate([np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(64, np.uint8)])
        self.begin, self.end = bounds[:-1], bounds[1:]
        self.known = ~np.asarray(column.is_null())

    def bytes_at(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.data[np.minimum(at[:, None] + np.arange(size), len(self.data) - 1)]

    def numbers(self, at: np.ndarray, little: np.ndarray, kind: str, count: int = 1) -> np.ndarray:
        """`count` numbers from each place, in the byte order of its blob."""
        raw = self.bytes_at(at, count * np.dtype(kind).itemsize)
        return np.where(little[:, None], raw.view(f"<{kind}"), raw.view(f">{kind}"))

    def headers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a blob has a GeoPackage header, the kind of its envelope, and where its WKB begins."""
        head = self.bytes_at(self.begin, 4)
        named = self.known & (self.end - self.begin >= 8) & (head[:, 0] == ord("G")) & (head[:, 1] == ord("P"))
        kind = np.where(named, head[:, 3] >> 1 & 7, 0)
        return named, kind, self.begin + np.where(named, 8 + np.maximum(ENVELOPE[kind], 0), 0)

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, count) of the vertices of points, lines and polygons' outer rings, in bytes and numbers; count 0: not read."""
        _, kind, at = self.headers()
        room = self.known & (self.end - at >= 9) & (ENVELOPE[kind] >= 0)
        self.little = self.data[np.minimum(at, len(self.data) - 1)] == 1
        what = self.numbers(at + 1, self.little, "u4")[:, 0]
        skip = np.select([what == POINT, what == LINE, what == POLYGON], [5, 9, 13], 0)
        count = np.where(what == POINT, 1, self.numbers(at + np.maximum(skip - 4, 0), self.little, "u4")[:, 0].astype(np.int64))
        fits = room & (skip > 0) & (at + skip + 16 * count <= self.end) & (count > 0)
        self.what = np.where(fits, what, 0)
        return at + skip, np.where(fits, count, 0)

    def vertices(self) -> tuple[np.ndarray, np.ndarray]:
        """All vertices (x, y) in a row, and how many each blob has."""
        first, count = self.points()
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.numbers(np.repeat(first, count) + 16 * nth, np.repeat(self.little, count), "f8", 2), count


def boxes_of(column: pa.Array) -> pa.Array:
    """Structs of west, south, east, north: from the envelope in the header, else from the geometry's vertices."""
    blobs = Blobs(column)
    named, kind, _ = blobs.headers()
    stated = named & (ENVELOPE[kind] > 0) & (blobs.end - blobs.begin >= 8 + ENVELOPE[kind])
    box = np.full((blobs.n, 4), np.nan)
    little = (blobs.bytes_at(blobs.begin, 4)[:, 3] & 1).astype(bool)
    box[stated] = blobs.numbers(blobs.begin[stated] + 8, little[stated], "f8", 4)[:, [0, 2, 1, 3]]
    xy, count = blobs.vertices()
    drawn = ~stated & (count > 0)
    if drawn.any():
        begins = (np.cumsum(count) - count)[count > 0]
        low, high = np.minimum.reduceat(xy, begins), np.maximum.reduceat(xy, begins)
        box[drawn] = np.concatenate([low, high], axis=1)[drawn[count > 0]]
    return pa.StructArray.from_arrays([pa.array(c) for c in box.T], ["west", "south", "east", "north"], mask=pa.array(~(stated | drawn)))


def lines_of(column: pa.Array) -> pa.Array:
    """Lists of vertices (x, y) of lines; null for other kinds."""
    blobs = Blobs(column)
    xy, count = blobs.vertices()
    line = blobs.what == LINE
    xy, ends = xy[np.repeat(line, count)], np.cumsum(np.where(line, count, 0))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~line, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in xy.T.copy()], ["x", "y"]))


def box(blob: Column) -> Column:
    """west, south, east, north of a geometry blob."""

    @F.arrow_udf("struct<west:double,south:double,east:double,north:double>")
    def boxes(column: pa.Array) -> pa.Array:
        return boxes_of(column)

    return boxes(blob)


def cell_centre(blob: Column) -> Column:
    """x, y of the middle of a grid cell's box."""
    b = box(blob)
    return F.struct(((b["west"] + b["east"]) / 2).alias("x"), ((b["south"] + b["north"]) / 2).alias("y"))


def line(blob: Column) -> Column:
    """Vertices of a line."""

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def lines(column: pa.Array) -> pa.Array:
        return lines_of(column)

    return lines(blob)
