"""Spans within reach, records beside roads, and points beside areas: sampled densely, by hand, and by the rules' cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import evidence, linear


def lines_df(spark, lines, key):
    rows = [(i, k, float(x), float(y)) for i, line in lines.items() for k, (x, y) in enumerate(line)]
    return linear.lines_of(spark.createDataFrame(rows, f"{key} long, seq int, x double, y double"), key)


def apart(x, y, ax, ay, bx, by):
    long2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long2)) if long2 else 0
    return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))


def test_covered_length_is_what_sampling_finds(spark):
    rng = random.Random(5)
    walk = lambda n: [(rng.uniform(0, 150), rng.uniform(0, 150)) for _ in range(n)]
    lines = {i: walk(3) for i in range(12)} | {12: [(0, 0), (50, 0), (50, 0), (100, 0)]}
    others = {i: walk(4) for i in range(12)} | {12: [(-20, 5), (40, 5), (40, 8), (130, 8)], 13: [(10, 0), (90, 0)]}
    got = {(r["line"], r["other"]): r["covered"] for r in evidence.covered_length(lines_df(spark, lines, "line"), "line", lines_df(spark, others, "other"), "other", 12.0).collect()}
    for i, line in lines.items():
        for j, other in others.items():
            total = 0.0
            for (ax, ay), (bx, by) in zip(line, line[1:]):
                hits = [any(apart(ax + t * (bx - ax), ay + t * (by - ay), *c, *d) <= 12 for c, d in zip(other, other[1:])) for t in [(k + 0.5) / 400 for k in range(400)]]
                total += math.hypot(bx - ax, by - ay) * sum(hits) / 400
            assert got.get((i, j), 0.0) == pytest.approx(total, abs=1.5)
    assert got[12, 12] == pytest.approx(100.0) and got[12, 13] == pytest.approx(100.0)


def matched(spark, line, refs, records):
    lines = lines_df(spark, {0: line}, "line_id").withColumn("refs", F.array(*map(F.lit, refs)) if refs else F.expr("cast(array() as array<string>)"))
    shapes = lines_df(spark, {oid: shape for oid, _, _, shape in records}, "oid")
    register = spark.createDataFrame([(oid, road, value) for oid, road, value, _ in records], "oid long, road string, value array<int>").join(shapes, "oid")
    return [(r["value"], r["oid"]) for r in evidence.register_evidence(lines, register).collect()]


def test_register_evidence_needs_coverage_number_and_agreement(spark):
    record = (1, "89", [50, 90], [(0, 0), (1000, 0)])
    forward = [(100, 2), (900, 2)]
    assert matched(spark, forward, ["89"], [record]) == [([50, 90], 1)]
    assert matched(spark, forward[::-1], ["89"], [record]) == [([90, 50], 1)]
    assert matched(spark, forward, ["87"], [record]) == []
    assert matched(spark, [(500, -50), (500, 50)], [], [record]) == []  # across
    assert matched(spark, [(900, 2), (1200, 2)], [], [record]) == []  # mostly beyond its end
    assert matched(spark, forward, [], [record, (2, "87", [50, 90], record[3])]) == []  # two roads, and no number
    assert matched(spark, forward, ["89"], [record, (2, "89", [50, 70], record[3])]) == []  # they do not agree
    assert matched(spark, forward, ["89"], [record, (2, "89", None, record[3])]) == [([50, 90], 1)]
    near = (5, "89", [50, 90], [(0, 1), (1000, 1)])
    assert matched(spark, forward, ["89"], [record, near]) == [([50, 90], 5)]  # the nearest one stands for them
    # there and back along the record is no run along it
    assert matched(spark, [(100, 2), (500, 2), (100, 3)], ["89"], [record]) == []


def test_points_beside_areas(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    shapes = {(1, 0): square(0, 0, 400), (1, 1): square(100, 100, 200), (1, 2): square(600, 0, 100), (2, 0): square(1000, 0, 50)}
    rows = [(a, r, k, float(x), float(y)) for (a, r), line in shapes.items() for k, (x, y) in enumerate(line)]
    points = spark.createDataFrame(rows, "area long, ring int, seq int, x double, y double").withColumn("key", F.struct("area", "ring"))
    rings = linear.lines_of(points.select("key", "seq", "x", "y"), "key").select("key.area", "key.ring", "pieces")
    asked = [(0, 50.0, 50.0), (1, 200.0, 200.0), (2, 130.0, 200.0), (3, 650.0, 50.0), (4, 430.0, 200.0), (5, 441.0, 200.0), (6, 1020.0, 20.0), (7, -30.0, -30.0)]
    got = {(r["p"], r["area"]): r["distance"] for r in evidence.near_areas(spark.createDataFrame(asked, "p long, x double, y double"), "p", rings, 40.0).collect()}
    # in the area, in the middle of its hole (too far from any edge), at the hole's edge, in its other part, beside it
    assert got == {(0, 1): 0.0, (2, 1): 30.0, (3, 1): 0.0, (4, 1): 30.0, (6, 2): 0.0}
    vertices = lambda *p: [(float(x), float(y)) for x, y in p]
    edges = spark.createDataFrame([(0, vertices((0, 0), (50, 50), (500, 500), (800, 800), (900, 900))), (1, vertices((1020, 20), (1021, 21))), (2, vertices((650, 50), (650, 60), (650, 70)))], "edge_id long, vertices array<struct<x:double,y:double>>")
    shares = {r["edge_id"]: r["share"] for r in evidence.scenery_share(edges, rings).collect()}
    assert shares == {0: pytest.approx(1 / 3), 1: 0.0, 2: 1.0}  # the area of 50 by 50 m is too small


def test_register_surface_codes(spark):
    from waymark.functions import roads

    codes = [("10", "paved"), ("16", "paved"), ("27", "paved"), ("31", "unpaved"), ("61", "unpaved"), ("99", "unknown"), ("23", "unknown"), ("29", "unknown"), ("", "unknown"), (None, "unknown"), ("20", "unknown")]
    df = spark.createDataFrame(codes, "code string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", roads.register_surface(F.col("code")).alias("got")).collect())


def test_scenic_rings_and_centres(spark):
    from waymark.functions import places

    ring = [(0.0, 0.0), (80.0, 0.0), (80.0, 10.0), (0.0, 0.0)]
    small = [(x / 2, y) for x, y in ring]
    rows = [(1, {"natural": "wood"}, [1, 2, 3, 1], ring), (2, {"natural": "wood"}, [1, 2, 3, 4], ring), (3, {"leisure": "park"}, [1, 2, 3, 1], small), (4, {"amenity": "cafe"}, [1, 2, 3, 1], ring), (5, {"waterway": "canal"}, [1, 2, 1], ring[:3]), (6, {"landuse": "meadow"}, [1, 2, 3, 1], [(x + 500, y) for x, y in ring])]
    ways = spark.createDataFrame(rows, "way long, tags map<string,string>, refs array<long>, xy array<struct<x:double,y:double>>")
    assert {r["way"]: r["kind"] for r in places.scenic_rings(ways).collect()} == {1: 1, 6: 5}
    assert {r["way"] for r in places.scenic_rings(ways, (400.0, -5.0, 700.0, 5.0)).collect()} == {6}
    got = {r["way"]: (r["p"]["kind"], r["c"] and (r["c"]["x"], r["c"]["y"])) for r in ways.select("way", places.area_point(F.col("tags")).alias("p"), places.centre(F.col("xy")).alias("c")).collect()}
    assert got[4] == (places.COFFEE, (40.0, 2.5)) and got[1][0] is None
