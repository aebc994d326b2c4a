"""Readers, writers, access conditions and routes on small inputs."""

import gzip
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import access
from waymark.operators import routes
from waymark.sources import readers, writers


@pytest.mark.parametrize(
    ("text", "closed"),
    [
        (None, set()), ("no @ (Su 08:00-18:00)", {2, 6}), ("no @ (Sa,Su)", {2, 3, 6, 7}), ("no @ (PH)", set()), ("no @ (sunset-sunrise)", {1, 3, 5, 7}), ("private", set(range(8))),
        ("no @ (Nov 1-Mar 16 17:00-09:00; Mar 16-Oct 31 21:00-09:00)", set(range(8))), ("no @ (Mo-Fr 07:00-10:00,16:00-19:00)", {0, 4}), ("maybe @ (Su)", set(range(8))), ("no @ (permit_holder)", set(range(8))),
    ],
)
def test_access(spark, text, closed):
    df = spark.createDataFrame([({"vehicle:conditional": text},)], "tags map<string,string>")
    got = df.select(access.allowed_windows(F.col("tags")).alias("m")).first()["m"]
    assert {i for i in range(8) if not got >> i & 1} == closed


def test_signs(spark, tmp_path):
    head = "rvvCode,blackCode,zoneCode,status,textSigns,rdX,rdY,bearing,drivingDirection,removedOn"
    rows = ["A1-30,,,PLACED,,100.5,200,90,H,", "A1-30,,,REMOVED,,1,2,,,", "X9,,,PLACED,Flitscamera,7,8,,,", "X9,,,PLACED,,7,8,,,", "A1-30,,,PLACED,,x,8,,,", "A1-30,,,PLACED,,1,2,,,2020-01-01"]
    with gzip.open(tmp_path / "signs.csv.gz", "wt") as f:
        f.write("\n".join([head, *rows]))
    got = readers.signs(spark, str(tmp_path / "signs.csv.gz"), ["a1-30"]).orderBy("x").collect()
    assert [(r["code"], r["x"]) for r in got] == [("X9", 7.0), ("A1-30", 100.5)]


def test_geometry_blobs(spark):
    wkb = b"\x01" + struct.pack("<II", 2, 2) + struct.pack("<4d", 1, 2, 3, 4)
    gpkg = b"GP\x00\x03" + struct.pack("<i", 28992) + struct.pack("<4d", 1, 3, 2, 4) + wkb
    df = spark.createDataFrame([(wkb,), (gpkg,), (None,)], "g binary")
    got = [r["l"] for r in df.select(readers.wkb_line("g").alias("l")).collect()]
    assert got[2] is None and [(p["x"], p["y"]) for p in got[0]] == [(1, 2), (3, 4)] == [(p["x"], p["y"]) for p in got[1]]


def test_raster_tiles(spark, tmp_path):
    raw = io.BytesIO()
    np.save(raw, np.array([[1, np.nan], [3, 4]], np.float32))
    (tmp_path / "3_4.npy").write_bytes(raw.getvalue())
    got = readers.npy_tiles(spark, str(tmp_path), F.regexp_extract("path", r"([0-9]+_[0-9]+)\.npy", 1)).collect()
    assert {(r["tile"], r["row"], r["col"], r["z"]) for r in got} == {("3_4", 0, 0, 1.0), ("3_4", 0, 1, None), ("3_4", 1, 0, 3.0), ("3_4", 1, 1, 4.0)}


def test_ways_are_split_at_junctions(spark):
    p = lambda n: [{"x": float(i), "y": 0.0} for i in range(n)]
    df = spark.createDataFrame([(1, [10, 11, 12, 13], p(4)), (2, [20, 12, 21], p(3))], "way long, refs array<long>, xy array<struct<x:double,y:double>>")
    got = {(r["way"], tuple(r["refs"])) for r in readers.split_ways(df).collect()}
    assert got == {(1, (10, 11, 12)), (1, (12, 13)), (2, (20, 12)), (2, (12, 21))}


def test_pages_and_manifest(spark, tmp_path):
    page = '{"features":[{"properties":{"oid":%d}},{"properties":{"oid":%d}}]}'
    (tmp_path / "a.json").write_text(page % (1, 2))
    (tmp_path / "b.json").write_text(page % (2, 3))
    assert readers.register_pages(spark, str(tmp_path), 3).count() == 3
    with pytest.raises(ValueError):
        readers.register_pages(spark, str(tmp_path), 4)
    found = readers.manifest(spark, [str(tmp_path)])
    assert found.count() == 2 and readers.drifted(found, found.withColumn("sha256", F.lit("x"))).count() == 2


def test_gpx_and_links(spark):
    df = spark.createDataFrame([("A & B", [{"lon": 5.0 + i / 100, "lat": 52.0} for i in range(30)])], "name string, line array<struct<lon:double,lat:double>>")
    got = df.select(writers.gpx(F.col("name"), F.col("line")).alias("g"), writers.maps_link(F.col("line")).alias("m"), F.size(writers.spread(F.col("line"), 8)).alias("n")).first()
    assert got["g"].count("<trkpt") == 30 and "A &amp; B" in got["g"]
    assert got["n"] == 8 and got["m"].startswith("https://www.google.com/maps/dir/")


def test_retraced_route(spark):
    there = [(0, i, i * 50.0, 0.0) for i in range(21)]
    back = [(0, 21 + i, 1000.0 - i * 50.0, 10.0) for i in range(21)]
    loop = [(1, i, x, y) for i, (x, y) in enumerate([(0.0, 5000.0), (1000.0, 5000.0), (1000.0, 6000.0), (0.0, 6000.0)])]
    points = spark.createDataFrame(there + back + loop, "route long, seq long, x double, y double")
    got = {r["route"]: r["share"] for r in routes.retrace_share(routes.trace(points)).collect()}
    assert got[0] > 0.8 and got[1] == 0.0
