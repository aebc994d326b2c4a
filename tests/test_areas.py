"""Projections, spans, clusters, tints and spurs on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import crs
from waymark.operators import areas, sequence


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(4.9, 52.37), (5.38720621, 52.1551744), (6.5, 53.2), (24.75, 59.44), (26.7, 58.38)], "lon double, lat double")
    rd = df.where("lat < 55").withColumn("p", crs.rd_from_lonlat(F.col("lon"), F.col("lat"))).withColumn("q", crs.lonlat_from_rd(F.col("p.x"), F.col("p.y")))
    for r in rd.collect():
        assert (r["q"]["lon"], r["q"]["lat"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-5)
        if r["lon"] == 5.38720621:
            assert (r["p"]["x"], r["p"]["y"]) == pytest.approx((155000, 463000))
    ee = df.where("lat > 55").withColumn("p", crs.lest_from_lonlat(F.col("lon"), F.col("lat"))).withColumn("q", crs.lonlat_from_lest(F.col("p.x"), F.col("p.y")))
    for r in ee.collect():
        assert (r["q"]["lon"], r["q"]["lat"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
        assert 300000 < r["p"]["x"] < 800000 and 6300000 < r["p"]["y"] < 6700000


def test_spans(spark):
    rows = [(0, 0, 10.0, "a", None), (0, 1, 10.0, "a", None), (0, 2, 10.0, "a", "gravel"), (0, 3, 10.0, "a", None), (0, 4, 10.0, "b", None), (0, 5, 0.5, "b", None)]
    df = spark.createDataFrame(rows, "line long, seq long, length_m double, tag string, bad string")
    why = F.array_compact(F.array(F.when(F.col("length_m") < 1, "short"), F.col("bad")))
    kept, dropped = sequence.supported_spans(df, why, ["tag"])
    assert {(r["first_seq"], r["last_seq"], r["tag"]) for r in kept.collect()} == {(0, 1, "a"), (3, 3, "a"), (4, 4, "b")}
    assert {(r["reason"], r["pairs"], r["km"]) for r in dropped.collect()} == {("gravel", 1, 0.01), ("short", 1, 0.0005)}


def test_clusters(spark):
    rows = [(1, 0.0, 0.0, 5.0), (2, 4000.0, 0.0, 5.0), (3, 7900.0, 0.0, 2.0), (4, 90000.0, 0.0, 4.0), (5, 95000.0, 90000.0, 1.0)]
    got = {r["stretch"]: r["seed"] for r in areas.cluster_areas(spark.createDataFrame(rows, "stretch long, x double, y double, fun_km double")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_clusters_match_one_by_one(spark):
    draw = np.random.default_rng(8)
    rows = [(i, *map(float, draw.uniform(0, 60_000, 2)), float(draw.integers(1, 9))) for i in range(90)]
    found = []
    for i, x, y, w in sorted(rows, key=lambda r: (-r[3], r[0])):
        home = next((c for c in found if np.hypot(c[0] - x, c[1] - y) <= 6000), None)
        if home is None:
            found.append([x, y, w, [i]])
        else:
            total = home[2] + w
            home[:3] = [(home[0] * home[2] + x * w) / total, (home[1] * home[2] + y * w) / total, total]
            home[3].append(i)
    want = {m: c[3][0] for c in found if c[2] >= 3 for m in c[3]}
    got = {r["stretch"]: r["seed"] for r in areas.cluster_areas(spark.createDataFrame(rows, "stretch long, x double, y double, fun_km double")).collect()}
    assert got == want and any(len(c[3]) > 2 for c in found)


def test_tints_match_one_by_one(spark):
    draw = np.random.default_rng(9)
    rows = [(i, float(draw.integers(50)), float(x), float(y), float(x) + 0.03, float(y) + 0.02) for i, (x, y) in enumerate(draw.uniform(5, 5.2, (60, 2)))]
    want = {}
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        near = [o for o in rows if o[0] in want and r[2] - 0.004 <= o[4] and r[4] + 0.004 >= o[2] and r[3] - 0.004 <= o[5] and r[5] + 0.004 >= o[3]]
        want[r[0]] = min(range(6), key=lambda k: (sum(want[o[0]] == k for o in near), k))
    got = areas.tints(spark.createDataFrame(rows, "item long, rank double, west double, south double, east double, north double"))
    assert {r["item"]: r["tint"] for r in got.collect()} == want


def test_tints(spark):
    rows = [(i, 10.0 - i, 5.0, 52.0, 5.01, 52.01) for i in range(4)] + [(9, 1.0, 6.0, 52.0, 6.01, 52.01)]
    got = {r["item"]: r["tint"] for r in areas.tints(spark.createDataFrame(rows, "item long, rank double, west double, south double, east double, north double")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}
