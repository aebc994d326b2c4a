"""Places, tangents and matches along lines: closed forms, a walk along each line in plain Python, and the rules of the matches."""

import math
import random

import pytest

from waymark.operators import linear


def line_rows(lines):
    return [(i, k, float(x), float(y)) for i, line in lines.items() for k, (x, y) in enumerate(line)]


def lines_df(spark, lines, key="slice_id"):
    return linear.lines_of(spark.createDataFrame(line_rows(lines), f"{key} long, seq int, x double, y double"), key)


def walk(line, s):
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        d = math.hypot(bx - ax, by - ay)
        if s <= d:
            t = max(0.0, s / d) if d else 0.0
            return ax + t * (bx - ax), ay + t * (by - ay)
        s -= d
    return line[-1]


def test_places_and_tangents(spark):
    rng = random.Random(3)
    lines = {i: [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(rng.randint(2, 7))] for i in range(30)}
    lines[30] = [(0, 0), (10, 0), (10, 0), (10, 10)]  # a doubled vertex
    lines[31] = [(5, 5), (5, 5)]  # no length
    lines[32] = [(0, 0), (2, 0)]  # shorter than the window
    df = lines_df(spark, lines)
    for share in (-0.1, 0.0, 0.3, 1.0, 1.2):
        s = df["length"] * share
        for r in df.select("slice_id", "length", linear.place(df["pieces"], s).alias("p"), linear.tangent(df["pieces"], df["length"], s).alias("t")).collect():
            line = lines[r["slice_id"]]
            assert (r["p"]["x"], r["p"]["y"]) == pytest.approx(walk(line, share * r["length"]), abs=1e-9)
            at, half = share * r["length"], min(5.0, max(r["length"] / 2, 1e-6))
            a, b = (walk(line, min(max(at + d, 0.0), r["length"])) for d in (-half, half))
            n = math.hypot(b[0] - a[0], b[1] - a[1])
            if n > 1e-6:
                assert (r["t"]["x"], r["t"]["y"]) == pytest.approx(((b[0] - a[0]) / n, (b[1] - a[1]) / n), abs=1e-9)
    closed = lines_df(spark, {1: [(0, 0), (4, 0), (0, 0)], 2: [(0, 0), (3, 0), (3, 4), (0, 0)]})
    got = {r[0]: (r[1]["x"], r[1]["y"]) for r in closed.select("slice_id", linear.tangent(closed["pieces"], closed["length"], closed["length"] / 2)).collect()}
    assert got[1] == (0.0, 0.0) and math.hypot(*got[2]) == pytest.approx(1.0)


def test_near_lines(spark):
    rng = random.Random(4)
    lines = {i: [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(rng.randint(2, 5))] for i in range(25)}
    lines[25] = [(7, -400), (7, 400)]
    points = [(i, rng.uniform(-350, 350), rng.uniform(-350, 350)) for i in range(200)]
    got = linear.near_lines(spark.createDataFrame(points, "p long, x double, y double"), ["p"], lines_df(spark, lines), "slice_id", 20.0, 30.0)
    found = {(r["p"], r["slice_id"]): (r["distance"], r["at"]) for r in got.collect()}
    want = {}
    for p, x, y in points:
        for i, line in lines.items():
            best, gone = (math.inf, 0.0), 0.0
            for (ax, ay), (bx, by) in zip(line, line[1:]):
                d = math.hypot(bx - ax, by - ay)
                t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d**2))
                best = min(best, (math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), gone + t * d))
                gone += d
            if best[0] <= 20:
                want[p, i] = best
    assert set(found) == set(want) and all(found[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


ROAD = [(1000, 1000), (1100, 1000)]
RECORD = [(1000, 1008), (1100, 1008)]
RECORD_KIND = "row_id long, wvk long, speed int, direction int, reliability double, name string"


def matched(spark, edges, lines, records, record_lines, **options):
    e = spark.createDataFrame(edges, "edge_id long, slice_id long, reversed boolean, name string")
    o = spark.createDataFrame(records, RECORD_KIND)
    return {r["edge_id"]: r for r in linear.match_speeds(e, lines_df(spark, lines), o, lines_df(spark, record_lines, "row_id"), **options).collect()}


def test_speeds_by_distance_heading_and_name(spark):
    lines = {0: ROAD, 1: [(1000, 1300), (1100, 1300)], 2: [(1050, 990), (1050, 1030)], 3: [(1000, 1016), (1100, 1016)]}
    edges = [(0, 0, False, "testweg"), (1, 1, False, None), (2, 2, False, None), (3, 3, False, "anderspad")]
    got = matched(spark, edges, lines, [(1, 42, 60, 0, 1.0, "testweg"), (2, 1, 0, 0, 1.0, None)], {1: RECORD, 2: ROAD})
    assert set(got) == {0, 3}  # far away, across: no; a record without a speed says nothing
    assert got[0]["speed"] == 60 and got[0]["row_id"] == 1 and got[0]["votes"] == 9.0
    assert got[0]["confidence"] == pytest.approx(0.35 * (1 - 8 / 25) + 0.25 + 0.2 + 0.1 + 0.1)
    assert got[3]["votes"] == 3.0 and got[0]["confidence"] > got[3]["confidence"] + 0.1


def test_speeds_hold_for_their_direction(spark):
    edges = [(0, 0, False, None), (1, 0, True, None)]
    for direction, edge in ((1, {0}), (-1, {1}), (0, {0, 1})):
        assert set(matched(spark, edges, {0: ROAD}, [(1, 42, 60, direction, 1.0, None)], {1: RECORD})) == edge


def test_speeds_ties_and_votes(spark):
    edges = [(0, 0, False, None)]
    tie = matched(spark, edges, {0: ROAD}, [(10, 200, 30, 0, 1.0, None), (11, 100, 50, 0, 1.0, None)], {10: RECORD, 11: RECORD})
    assert (tie[0]["speed"], tie[0]["row_id"], tie[0]["votes_part"]) == (50, 11, 0.5)
    # two farther records of one speed outvote the nearest one
    near = matched(spark, edges, {0: ROAD}, [(1, 1, 30, 0, 1.0, None), (2, 2, 50, 0, 1.0, None), (3, 3, 50, 0, 0.0, None)], {1: ROAD, 2: RECORD, 3: [(1000, 1009), (1100, 1009)]})
    assert (near[0]["speed"], near[0]["row_id"], near[0]["votes"]) == (50, 2, 12.0)


def test_signs(spark):
    edges = spark.createDataFrame([(0, 0, False), (1, 0, True), (2, 1, False), (3, 2, False), (4, 2, True)], "edge_id long, slice_id long, reversed boolean")
    lines = lines_df(spark, {0: [(0, 0), (100, 0)], 1: [(0, 40), (100, 40)], 2: [(0, 12), (100, 12)]})
    signs = [(1, 50.0, -6.0, 90.0), (2, 50.0, -6.0, 270.0), (3, 50.0, -6.0, None), (4, 50.0, -6.0, 0.0), (5, 50.0, 6.0, 100.0), (6, 50.0, 140.0, 90.0), (7, 50.0, 42.0, 270.0), (8, 50.0, -2.0, 359.0 - 60)]
    got = {r["sign_id"]: (r["edge_id"], r["off"]) for r in linear.match_signs(spark.createDataFrame(signs, "sign_id long, x double, y double, bearing double"), edges, lines).collect()}
    # 4 faces across, 6 is far away, 7 stands at a one-way road against its travel, 5 is as near to both: the lower edge's line
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 1, 3: 0, 5: 0, 8: 1}
    assert got[3][1] is None and got[5][1] == pytest.approx(10.0) and got[8][1] == pytest.approx(29.0)


def test_edges_of_slices(spark):
    df = spark.createDataFrame([(7, 1, True), (2, 1, False), (3, 5, False)], "edge_id long, slice_id long, reversed boolean")
    got = {r["slice_id"]: [tuple(e) for e in r["edges"]] for r in linear.edges_of_slices(df).collect()}
    assert got == {1: [(2, False), (7, True)], 5: [(3, False)]}
