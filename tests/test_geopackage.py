"""Geometry blobs: envelopes and geometries of both byte orders, beside blobs that are none."""

import struct

import pytest

from waymark.sources import geopackage


def wkb(kind, points, order="<"):
    head = struct.pack(f"{order}BI", order == "<", kind)
    xy = b"".join(struct.pack(f"{order}dd", *p) for p in points)
    return head + {1: b"", 2: struct.pack(f"{order}I", len(points)), 3: struct.pack(f"{order}II", 1, len(points))}[kind] + xy


def blob(body, envelope=None, order="<", kind=1):
    flags = (order == "<") | (kind << 1 if envelope else 0)
    return b"GP\x00" + bytes([flags]) + struct.pack(f"{order}i", 28992) + (struct.pack(f"{order}{len(envelope)}d", *envelope) if envelope else b"") + body


RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (-1.0, 2.0), (0.0, 0.0)]
LINE = [(1.0, 2.0), (5.0, -2.0), (3.0, 9.0)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("other", ["<", ">"])
def test_boxes(spark, order, other):
    rows = [
        (1, blob(wkb(3, RING, other), (-1.0, 4.0, 0.0, 3.0), order)), (2, blob(wkb(3, RING, other), None, order)), (3, blob(wkb(1, [(7.0, 8.0)], other), None, order)), (4, wkb(2, LINE, other)),
        (5, None), (6, b""), (7, b"GP\x00"), (8, b"something else altogether, and long enough"), (9, blob(wkb(2, LINE, other), (1.0, 5.0, -2.0, 9.0, 0.0, 1.0), order, 2)), (10, wkb(2, LINE, other)[:-5]),
        (11, blob(b"", (100.0, 200.0, 300.0, 400.0), order)), (12, blob(wkb(2, LINE, other), (1.0, 5.0), order, 7)),
    ]
    df = spark.createDataFrame(rows, "id long, geom binary")
    got = {r["id"]: tuple(r["b"]) if r["b"] else None for r in df.select("id", geopackage.box(df["geom"]).alias("b")).collect()}
    assert got == {1: (-1.0, 0.0, 4.0, 3.0), 2: (-1.0, 0.0, 4.0, 3.0), 3: (7.0, 8.0, 7.0, 8.0), 4: (1.0, -2.0, 5.0, 9.0), 5: None, 6: None, 7: None, 8: None, 9: (1.0, -2.0, 5.0, 9.0), 10: None, 11: (100.0, 300.0, 200.0, 400.0), 12: None}
    centres = {r["id"]: (r["c"]["x"], r["c"]["y"]) for r in df.where("id in (1, 11)").select("id", geopackage.cell_centre(df["geom"]).alias("c")).collect()}
    assert centres == {1: (1.5, 1.5), 11: (150.0, 350.0)}
    lines = {r["id"]: r["l"] and [tuple(p) for p in r["l"]] for r in df.select("id", geopackage.line(df["geom"]).alias("l")).collect()}
    assert {k for k, v in lines.items() if v is not None} == {4, 9} and lines[4] == lines[9] == LINE
    assert df.where("false").select(geopackage.box(df["geom"])).collect() == []
