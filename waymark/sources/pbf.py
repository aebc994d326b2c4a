"""OpenStreetMap PBF files as a Spark data source: one partition for some of the file's blocks, read where they lie.

    spark.dataSource.register(pbf.PbfSource)
    spark.read.format("osm_pbf").option("kind", "ways").load(path)

Kinds: nodes (id, lon, lat, tags), ways (id, tags, refs), relations (id, tags, members). The driver reads the blocks'
headers only and seeks over the rest. A task inflates its blocks one by one; groups of another kind are passed over, and
packed numbers are decoded with numpy: continuation bits give the bounds, shifted sums the values, running sums the deltas.

Defined cases: an empty file gives no rows; elements without tags have an empty map; blocks packed otherwise than by zlib
raise an error, and so does a file that ends inside a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of blocks that one partition holds, about.
PARTITION_BYTES = 32 << 20
#: Fixed values of the format: numbers of fields in blocks, groups and elements; kinds of members.
GROUP_OF = {"nodes": (1, 2), "ways": (3,), "relations": (4,)}
MEMBER = ("node", "way", "relation")
KINDS = {
    "nodes": "id long, lon double, lat double, tags map<string,string>",
    "ways": "id long, tags map<string,string>, refs array<long>",
    "relations": "id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>",
}


def varints(data: bytes) -> np.ndarray:
    """All numbers of a packed field, unsigned."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers: 0, -1, 1, -2, ..."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: numbers for plain ones, bytes for those with a length."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < n:
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
        elif wire == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[wire]
            yield key >> 3, data[at : at + size]
            at += size


def inflated(blob: bytes) -> bytes:
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number in (4, 6, 7):
            break
    raise ValueError("a block that is not packed by zlib")


class Block:
    """A block of elements: its strings, and the groups of a kind."""

    def __init__(self, data: bytes, kind: str):
        self.granularity, self.lat0, self.lon0, self.strings, self.groups = 100, 0, 0, [], []
        for number, value in fields(data):
            if number == 1:
                self.strings = [v.decode() for n, v in fields(value) if n == 1]
            elif number == 2:
                self.groups += [(n, v) for n, v in fields(value) if n in GROUP_OF[kind]]
            elif number in (17, 19, 20):
                setattr(self, {17: "granularity", 19: "lat0", 20: "lon0"}[number], value if value < 1 << 63 else value - (1 << 64))

    def tags(self, keys: np.ndarray, values: np.ndarray) -> list[tuple[str, str]]:
        return [(self.strings[k], self.strings[v]) for k, v in zip(keys.tolist(), values.tolist(), strict=True)]

    def degrees(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.lat0 + self.granularity * lat) / 1e9, (self.lon0 + self.granularity * lon) / 1e9

    def nodes(self) -> Iterator[dict]:
        for number, data in self.groups:
            of = dict(fields(data))
            if number == 1:
                one = signed(np.array([of[1], of[8], of[9]], np.uint64))
                lat, lon = self.degrees(one[1:2], one[2:3])
                yield {"id": one[:1], "lon": lon, "lat": lat, "tags": [self.tags(varints(of.get(2, b"")), varints(of.get(3, b"")))]}
                continue
            id_, lat, lon = (np.cumsum(signed(varints(of.get(k, b"")))) for k in (1, 8, 9))
            lat, lon = self.degrees(lat, lon)
            packed = varints(of.get(10, b"")).astype(np.int64)
            # each node's numbers of key and value, then a zero
            tags: list[list] = [[] for _ in id_]
            if len(packed):
                node = at = 0
                flat = packed.tolist()
                while at < len(flat):
                    if flat[at] == 0:
                        node, at = node + 1, at + 1
                    else:
                        tags[node].append((self.strings[flat[at]], self.strings[flat[at + 1]]))
                        at += 2
            yield {"id": id_, "lon": lon, "lat": lat, "tags": tags}

    def ways(self) -> Iterator[dict]:
        found = [dict(fields(data)) for _, data in self.groups]
        tags = [self.tags(varints(w.get(2, b"")), varints(w.get(3, b""))) for w in found]
        yield {"id": [w[1] for w in found], "tags": tags, "refs": [np.cumsum(signed(varints(w.get(8, b"")))) for w in found]}

    def relations(self) -> Iterator[dict]:
        found = [dict(fields(data)) for _, data in self.groups]
        tags = [self.tags(varints(r.get(2, b"")), varints(r.get(3, b""))) for r in found]
        members = [
            [{"type": MEMBER[t], "ref": ref, "role": self.strings[role]} for role, ref, t in zip(varints(r.get(8, b"")).tolist(), np.cumsum(signed(varints(r.get(9, b"")))).tolist(), varints(r.get(10, b"")).tolist(), strict=True)]
            for r in found
        ]
        yield {"id": [r[1] for r in found], "tags": tags, "members": members}


class Blocks(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str, schema):
        self.path, self.kind, self.schema = path, kind, schema

    def partitions(self) -> list[Blocks]:
        """Places (begin, size) of the blobs with elements, by the headers."""
        out: list[Blocks] = []
        held = PARTITION_BYTES
        with _opened(self.path) as file:
            at, end = 0, file.size()
            while at < end:
                file.seek(at)
                head = file.read(4)
                size = struct.unpack(">I", head)[0] if len(head) == 4 else -1
                header = dict(fields(file.read(max(size, 0))))
                begin = at + 4 + size
                if size < 0 or 3 not in header or begin + header[3] > end:
                    raise ValueError(f"{self.path} ends inside a block")
                at = begin + header[3]
                if header[1] == b"OSMData":
                    if held >= PARTITION_BYTES:
                        out.append(Blocks(self.path, []))
                        held = 0
                    out[-1].places.append((begin, header[3]))
                    held += header[3]
        return out or [Blocks(self.path, [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if not partition.places:
            return
        with _opened(partition.path) as file:
            for begin, size in partition.places:
                file.seek(begin)
                block = Block(inflated(file.read(size)), self.kind)
                for rows in getattr(block, self.kind)():
                    if len(rows["id"]):
                        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


class PbfSource(DataSource):
    """kind: nodes, ways (the default) or relations."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        kind = self.options.get("kind", "ways")
        if kind not in KINDS:
            raise ValueError(f"kind has to be one of {', '.join(KINDS)}")
        return KINDS[kind]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("kind", "ways"), schema)


def drivable(ways: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Ways of the given highway classes with two nodes or more, areas left out."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    return ways.where(tag("highway").isin(*classes) & (tag("area") != "yes") & (F.size("refs") >= 2))


def cycle_ways(relations: DataFrame) -> DataFrame:
    """(way): the ways that are members of cycle routes."""
    routes = relations.where((F.col("tags")["type"] == "route") & (F.col("tags")["route"] == "bicycle"))
    return routes.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("way")).distinct()


def located(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, tags, refs, xy) with the place of every node: x is the longitude, y the latitude. Nodes that are missing leave the way."""
    steps = ways.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "ref")).join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    packed = steps.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")))).alias("_n"))
    return packed.join(ways.select(F.col("id").alias("way"), "tags"), "way").select("way", "tags", F.col("_n.ref").alias("refs"), F.col("_n.p").alias("xy"))
