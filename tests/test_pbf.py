"""A small PBF file, written here byte by byte, read by the data source, and its ways split at junctions."""

import random
import struct
import zlib

import numpy as np
import pytest

from waymark.sources import pbf, readers


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def packed(values):
    return b"".join(varint(v) for v in values)


def deltas(values):
    return packed(zigzag(b - a) for a, b in zip([0, *values], values))


class Strings(list):
    def of(self, text):
        if text not in self:
            self.append(text)
        return self.index(text)


def block(nodes=(), ways=(), relations=(), deflate=True, granularity=100):
    strings, groups = Strings([""]), b""
    if nodes:
        tags = packed(x for n in nodes for x in [*(strings.of(s) for kv in n[3].items() for s in kv), 0])
        dense = field(1, deltas([n[0] for n in nodes])) + field(8, deltas([n[2] for n in nodes])) + field(9, deltas([n[1] for n in nodes])) + field(10, tags)
        groups += field(2, field(2, dense))
    for id_, tags, refs in ways:
        keys, values = packed(strings.of(k) for k in tags), packed(strings.of(v) for v in tags.values())
        groups += field(2, field(3, field(1, id_) + field(2, keys) + field(3, values) + field(8, deltas(refs))))
    for id_, tags, members in relations:
        keys, values = packed(strings.of(k) for k in tags), packed(strings.of(v) for v in tags.values())
        body = field(8, packed(strings.of(m[2]) for m in members)) + field(9, deltas([m[1] for m in members])) + field(10, packed(pbf.MEMBER.index(m[0]) for m in members))
        groups += field(2, field(4, field(1, id_) + field(2, keys) + field(3, values) + body))
    data = field(1, b"".join(field(1, s.encode()) for s in strings)) + groups + field(17, granularity)
    return blob(b"OSMData", data, deflate)


def blob(kind, data, deflate=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if deflate else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


NODES = [(5, 48_000_000, 523_000_000, {}), (7, 48_010_000, 523_000_000, {"highway": "crossing"}), (2**40, -1_000, -523_000_000, {"a": "ä", "b": ""}), (9, 48_020_000, 523_010_000, {}), (10, 48_010_000, 523_020_000, {})]
WAYS = [(100, {"highway": "tertiary", "name": "Dijk"}, [5, 7, 9]), (101, {"highway": "residential"}, [10, 7]), (102, {"building": "yes"}, [5, 7, 10, 5]), (103, {}, [])]
RELATIONS = [(7, {"type": "route", "route": "bicycle"}, [("way", 100, ""), ("node", 5, "stop"), ("way", 101, "forward")]), (8, {"type": "route", "route": "bus"}, [("way", 102, "")])]


@pytest.fixture
def reading(spark, tmp_path):
    spark.dataSource.register(pbf.PbfSource)
    path = tmp_path / "small.osm.pbf"
    path.write_bytes(blob(b"OSMHeader", field(4, b"OsmSchema-V0.6")) + block(NODES[:3]) + block(NODES[3:], WAYS[:1], deflate=False) + block((), WAYS[1:], RELATIONS))
    return lambda kind, at=path: spark.read.format("osm_pbf").option("kind", kind).load(str(at))


def test_elements(reading):
    nodes = {r["id"]: (round(r["lon"] * 1e7), round(r["lat"] * 1e7), r["tags"]) for r in reading("nodes").collect()}
    assert nodes == {n[0]: (n[1], n[2], n[3]) for n in NODES}
    assert {r["id"]: (r["tags"], r["refs"]) for r in reading("ways").collect()} == {w[0]: (w[1], w[2]) for w in WAYS}
    assert {r["id"]: [tuple(m) for m in r["members"]] for r in reading("relations").collect()} == {r[0]: r[2] for r in RELATIONS}


def test_partitions_and_faults(reading, spark, tmp_path, monkeypatch):
    reader = pbf.PbfReader(str(tmp_path / "small.osm.pbf"), "ways", None)
    assert [len(p.places) for p in reader.partitions()] == [3]
    monkeypatch.setattr(pbf, "PARTITION_BYTES", 1)
    assert [len(p.places) for p in reader.partitions()] == [1, 1, 1]
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert reading("ways", tmp_path / "empty.pbf").collect() == []
    (tmp_path / "cut.pbf").write_bytes((tmp_path / "small.osm.pbf").read_bytes()[:-9])
    with pytest.raises(Exception, match="ends inside a block"):
        reading("ways", tmp_path / "cut.pbf").collect()
    with pytest.raises(Exception, match="kind has to be"):
        reading("areas").collect()
    with pytest.raises(ValueError, match="zlib"):
        pbf.inflated(field(2, 3) + field(4, b"lzma"))


def test_ways_are_located_and_split(reading):
    ways = pbf.located(pbf.drivable(reading("ways"), ("tertiary", "residential")), reading("nodes"))
    pieces = {tuple(r["refs"]): [(round(p["x"] * 1e7), round(p["y"] * 1e7)) for p in r["xy"]] for r in readers.split_ways(ways.select("way", "refs", "xy")).collect()}
    at = {n[0]: (n[1], n[2]) for n in NODES}
    assert pieces == {k: [at[n] for n in k] for k in ((5, 7), (7, 9), (10, 7))}
    assert {r["way"] for r in pbf.cycle_ways(reading("relations")).collect()} == {100, 101}


def test_numbers():
    rng = random.Random(1)
    values = [rng.randrange(2 ** rng.randrange(1, 64)) for _ in range(500)]
    assert pbf.varints(packed(values)).tolist() == values
    whole = [rng.randrange(-(2**50), 2**50) for _ in range(300)]
    assert np.cumsum(pbf.signed(pbf.varints(deltas(whole)))).tolist() == whole
