"""Profiles: parts of equal distance against plain Python, medians by counts, gaps of heights, and markers."""

import bisect
import random
import statistics

import pytest
from pyspark.sql import functions as F

from waymark.operators import profiles


def test_equal_parts(spark):
    rng = random.Random(1)
    routes = {r: [rng.uniform(1, 900) for _ in range(rng.randint(1, 60))] for r in range(12)} | {12: [0.0, 0.0, 0.0], 13: [5000.0, 1.0]}
    rows = [(r, k, m) for r, lengths in routes.items() for k, m in enumerate(lengths)]
    got = {}
    for r in profiles.equal_parts(spark.createDataFrame(rows, "route long, pos long, length_m double"), F.lit(7)).collect():
        got.setdefault(r["route"], {})[r["part"]] = (r["i0"], r["i1"])
    for r, lengths in routes.items():
        ends = [0.0]
        for m in lengths:
            ends.append(ends[-1] + m)
        last = len(lengths) - 1
        if not ends[-1]:
            assert got[r] == {0: (0, last)}
            continue
        at = [bisect.bisect_left([round(e, 6) for e in ends], round(k * ends[-1] / 7, 6)) for k in range(8)]
        assert got[r] == {k: (min(at[k], last), max(min(at[k], last), min(at[k + 1] - 1, last))) for k in range(7)}


def test_medians_by_counts(spark):
    rng = random.Random(2)
    groups = {g: [rng.choice([30, 50, 60, 80]) for _ in range(rng.randint(1, 9))] for g in range(20)}
    rows = [(g, v) for g, values in groups.items() for v in values] + [(0, None), (99, None)]
    got = {r["g"]: r["median"] for r in profiles.median_by_counts(spark.createDataFrame(rows, "g long, v int"), ["g"], "v").collect()}
    assert got == {g: statistics.median(values) for g, values in groups.items()}


def test_each_edge_its_own_limit(spark):
    rows = [(1, 0, 3, 0.505, 50), (1, 1, 2, 0.8, 90), (1, 2, 5, 0.1, 70)]
    got = profiles.exact_profile(spark.createDataFrame(rows, "route long, pos long, n_vertices int, fun double, legal_speed int")).orderBy("part").collect()
    assert [(r["i0"], r["i1"], r["fun"], r["lim"]) for r in got] == [(0, 2, 50, 50), (2, 3, 80, 90), (3, 7, 10, 70)]


def test_gaps_of_heights(spark):
    points = [(1, k, 1000.0 * k, None if k == 3 else float(k)) for k in range(15)] + [(2, 0, 0.0, None), (2, 1, 10.0, None)] + [(3, k, 1000.0 * k, 2.0) for k in range(3)]
    df = spark.createDataFrame(points, "route long, seq long, s double, z double")
    rows = {(r["route"], r["nth"]): (r["km"], r["z"]) for r in profiles.height_profile(df).collect()}
    assert {k[0] for k in rows} == {1, 3} and rows[1, 0] == (0.0, 0.0) and rows[1, 8] == (14.0, 14.0) and len([k for k in rows if k[0] == 3]) == 8
    known = [1.75 * n for n in range(9) if n != 2 and not 2 < 1.75 * n < 4]
    assert rows[1, 2] == (3.5, pytest.approx(round(statistics.median(known), 1)))  # beside the gap
    assert {r["route"] for r in profiles.height_profile(df, gaps=False).collect()} == {3}


def test_markers(spark):
    routes = spark.createDataFrame([(1, 7), (1, 8), (1, 7), (2, 8)], "route long, edge_id long")
    corners = [(k, 7, 2.0 * k, 40.4, 1, 61.6, k != 5) for k in range(30)] + [(50, 8, 10.0, 99.5, -1, 50.5, True)]
    corners = spark.createDataFrame(corners, "corner long, edge_id long, s double, radius double, sign int, speed double, engaged boolean")
    edges = spark.createDataFrame([(7, 0, False, 100.0), (8, 0, True, 100.0)], "edge_id long, slice_id long, rev boolean, length_m double")
    vertices = spark.createDataFrame([(0, k, 10.0 * k, 0.0) for k in range(11)], "slice_id long, seq int, x double, y double")
    rows = {(r["route"], r["nth"]): r for r in profiles.corner_markers(routes, corners, edges, vertices).collect()}
    assert len(rows) == 25 and rows[1, 5]["x"] == pytest.approx(8.0) and rows[1, 6]["x"] == pytest.approx(12.0)  # corner 5 is not engaged
    assert (rows[2, 1]["x"], rows[2, 1]["dir"], rows[2, 1]["r"], rows[2, 1]["v"]) == (90.0, "R", 100, 50) and rows[1, 1]["dir"] == "L"
