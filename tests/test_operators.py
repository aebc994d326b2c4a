"""Operators on closed forms and small graphs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import roads
from waymark.operators import catalogue, graph, sequence, spatial


def circle(radius, sweep_deg, n):
    a = np.radians(np.linspace(0, sweep_deg, n))
    return radius * np.sin(a), radius * (1 - np.cos(a))


def lines(spark, *shapes):
    rows = [(k, i, float(x), float(y)) for k, (xs, ys) in enumerate(shapes) for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "line long, seq long, x double, y double")


@pytest.mark.parametrize("radius", [25, 60, 150, 400])
def test_corner_of_a_circle(spark, radius):
    samples = sequence.resample(lines(spark, circle(radius, 180, 400)), 10.0)
    got = sequence.detect_corners(samples).collect()
    assert len(got) == 1 and got[0]["sign"] == 1
    assert got[0]["radius"] == pytest.approx(radius, rel=0.1)
    assert 150 <= got[0]["heading"] <= 190


def test_resample_keeps_ends_and_step(spark):
    got = sequence.resample(lines(spark, ([0, 10, 10, 10], [0, 0, 0, 25])), 10.0).orderBy("k").collect()
    assert [round(r["s"], 6) for r in got] == [0, round(35 / 3, 6), round(70 / 3, 6), 35]
    assert (got[0]["x"], got[0]["y"], got[-1]["x"], got[-1]["y"]) == (0, 0, 10, 25)


def test_curvature_and_straight_line(spark):
    x, y = circle(100, 180, 100)
    got = sequence.curvature(lines(spark, (x, y), ([0, 1, 2], [0, 0, 0]))).collect()
    inner = [r["curvature"] for r in got if r["line"] == 0 and 0 < r["seq"] < 99]
    assert np.allclose(inner, 0.01, rtol=0.02)
    assert all(r["curvature"] == 0 for r in got if r["line"] == 1)


def test_grade_of_a_ramp(spark):
    rows = [(0, i, i * 10.0, 0.0, i * 0.5 if i != 7 else None) for i in range(40)]
    points = sequence.running_distance(spark.createDataFrame(rows, "line long, seq long, x double, y double, z double"))
    got = sequence.grade_stats(points, "z").first()
    assert got["max_grade"] == pytest.approx(5.0) and got["descent_m"] == 0
    assert got["climb_m"] == pytest.approx(39 * 0.5 - 1.2, abs=0.7)


def test_flagged_runs_are_straightened(spark):
    rows = [(0, i, float(i), 99.0 if 3 <= i <= 5 else float(i), 3 <= i <= 5) for i in range(10)]
    points = spark.createDataFrame(rows, "line long, seq long, s double, z double, bridge boolean")
    got = sequence.repair_flagged(points, "z", "bridge", "fixed").orderBy("seq").collect()
    assert [r["fixed"] for r in got] == [float(i) for i in range(10)]


def test_esses_and_straights(spark):
    corners = spark.createDataFrame([(0, 100.0, 50.0, 1, 40.0, 30.0), (0, 300.0, 50.0, -1, 40.0, 30.0), (0, 900.0, 50.0, -1, 40.0, 30.0)], "line long, s double, radius double, sign int, heading double, length double")
    assert sequence.esses_share(corners).first()["esses"] == pytest.approx(80 / 240)
    road = spark.createDataFrame([(0, 1000.0), (1, 300.0), (2, 50.0)], "line long, length_m double")
    got = {r["line"]: r["straight_share"] for r in sequence.straight_share(road, corners).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and 0 < got[0] < 1


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "kmh"), [("50", 50), ("30 mph", 48), ("walk", 15), ("NL:zone20", 20), ("none", 0), (None, 0), ("200", 0), (" 70 ", 70), ("", 0)])
def test_speed_text(spark, text, kmh):
    assert value(spark, roads.parse_speed(F.lit(text).cast("string"))) == kmh


@pytest.mark.parametrize(("tags", "want"), [({}, (True, True)), ({"oneway": "yes"}, (True, False)), ({"oneway": "-1"}, (False, True)), ({"junction": "roundabout"}, (True, False)), ({"oneway": "yes", "oneway:motor_vehicle": "no"}, (True, True)), ({"motor_vehicle:forward": "no"}, (False, True))])
def test_oneway(spark, tags, want):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    got = df.select(roads.oneway_directions(F.col("tags"), F.lit("residential")).alias("d")).first()["d"]
    assert (got["forward"], got["backward"]) == want


def test_content_id(spark):
    import hashlib

    ids = [1, 513, 2**40]
    want = hashlib.sha256(np.asarray(ids, "<i8").tobytes()).hexdigest()[:16]
    assert value(spark, roads.content_id(F.array(*[F.lit(i).cast("long") for i in ids]))) == want


def test_ride_name_collapses(spark):
    assert value(spark, roads.ride_name(F.array(*map(F.lit, "aabba")), F.lit(True))) == "a → b → a Loop"


def test_within_matches_brute_force(spark):
    draw = np.random.default_rng(1)
    a, b = draw.uniform(-50, 50, (200, 2)), draw.uniform(-50, 50, (150, 2))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "i int, x double, y double")
    right = spark.createDataFrame([(j, *map(float, p)) for j, p in enumerate(b)], "j int, x double, y double")
    got = {(r["i"], r["j"]) for r in spatial.within(left, right, 7.0).collect()}
    assert got == {(i, j) for i in range(200) for j in range(150) if math.dist(a[i], b[j]) <= 7}


EDGES = "edge_id long, u long, v long, slice_id long, length_m double, fun double, excluded boolean"


def test_stretches_cross_a_short_gap(spark):
    rows = [(0, 0, 1, 0, 600.0, 0.9, False), (1, 1, 2, 1, 100.0, 0.2, False), (2, 2, 3, 2, 600.0, 0.8, False), (3, 3, 4, 3, 900.0, 0.2, False), (4, 9, 8, 9, 400.0, 0.9, False)]
    got = graph.mine_stretches(spark.createDataFrame(rows, EDGES)).collect()
    assert [r["edges"] for r in got] == [[0, 1, 2]]
    assert got[0]["length_m"] == 1300 and got[0]["start_node"] == 0 and got[0]["end_node"] == 3


def test_shortest_paths_match_dijkstra(spark):
    import heapq

    draw = np.random.default_rng(997)
    edges = [(i, int(draw.integers(12)), int(draw.integers(12)), float(draw.uniform(1, 9))) for i in range(40)]
    got = {r["node"]: r["cost"] for r in graph.shortest_paths(spark.createDataFrame(edges, "edge_id long, u long, v long, cost double"), spark.createDataFrame([(0,)], "node long"), 1e9).collect()}
    best, heap = {}, [(0.0, 0)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = d
        for _, u, v, c in edges:
            if u == n and v not in best:
                heapq.heappush(heap, (d + c, v))
    assert got == pytest.approx(best)


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[200] == 200


def test_greedy_keep(spark):
    items = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0), (3, 3.0, 0), (4, 4.0, 1)], "item long, rank double, area int")
    conflicts = spark.createDataFrame([(1, 4), (4, 1)], "a long, b long")
    assert {r["item"] for r in graph.greedy_keep(items, conflicts, "area", 2).collect()} == {1, 2}


def test_greedy_keep_matches_one_by_one(spark):
    draw = np.random.default_rng(12)
    rows = [(i, float(draw.integers(40)), int(draw.integers(6))) for i in range(150)]
    pairs = {(int(a), int(b)) for a, b in draw.integers(150, size=(260, 2)) if a != b}
    kept, count = set(), {}
    for item, _, area in sorted(rows, key=lambda r: (r[1], r[0])):
        if count.get(area, 0) < 9 and not any((item, k) in pairs or (k, item) in pairs for k in kept):
            kept.add(item)
            count[area] = count.get(area, 0) + 1
    got = graph.greedy_keep(spark.createDataFrame(rows, "item long, rank double, area int"), spark.createDataFrame(sorted(pairs), "a long, b long"), "area", 9)
    assert {r["item"] for r in got.collect()} == kept


def best_way(edges, at, side, used, gap, chain=()):
    """The best crossing from an edge by trying all of them: (fun, -metres, edges)."""
    found = []
    for e in edges:
        meets = e[1] == at[2] if side == 1 else e[2] == at[1]
        if not meets or e[3] in used or e[3] in {at[3], *(c[3] for c in chain)}:
            continue
        if e[5] >= 0.55:
            found += [(e[5], -sum(c[4] for c in chain), (*chain, e))] if chain else []
        elif sum(c[4] for c in chain) + e[4] <= gap and len(chain) < 8:
            found += best_way(edges, e, side, used, gap, (*chain, e))
    return found


def test_stretches_match_one_by_one(spark):
    draw = np.random.default_rng(31)
    edges = [(i, int(draw.integers(26)), int(draw.integers(26)), i // 2, float(draw.integers(80, 700)), round(float(draw.uniform(0.2, 1)), 3), bool(draw.uniform() < 0.1)) for i in range(90)]
    usable, used, want = [e for e in edges if not e[6]], set(), []
    for seed in sorted((e for e in usable if e[5] >= 0.55), key=lambda e: (-e[5], e[0])):
        if seed[3] in used:
            continue
        used.add(seed[3])
        path = [seed]
        for side in (1, -1):
            at = seed
            while True:
                near = [e for e in usable if e[5] >= 0.55 and e[3] not in used and (e[1] == at[2] if side == 1 else e[2] == at[1])]
                options = [max(near, key=lambda e: (e[5], -e[0]))] if near else (max(best_way(usable, at, side, used, 400.0), key=lambda w: w[:2], default=(0, 0, ()))[2])
                if not options:
                    break
                used.update(e[3] for e in options)
                path = [*path, *options] if side == 1 else [*reversed(options), *path]
                at = options[-1]
        if sum(e[4] for e in path) >= 1000:
            want.append([e[0] for e in path])
    got = graph.mine_stretches(spark.createDataFrame(edges, EDGES)).collect()
    assert sorted(r["edges"] for r in got) == sorted(want) and len(want) > 3


def test_paths_lead_to_their_nodes(spark):
    draw = np.random.default_rng(5)
    edges = [(i, int(draw.integers(15)), int(draw.integers(15)), float(draw.integers(1, 5))) for i in range(60)]
    df = spark.createDataFrame(edges, "edge_id long, u long, v long, cost double")
    every = graph.shortest_paths(df, spark.createDataFrame([(0,), (3,)], "node long"), 20.0).collect()
    some = graph.shortest_paths(df, spark.createDataFrame([(0,), (3,)], "node long"), 20.0, targets=spark.createDataFrame([(5,), (7,)], "node long")).collect()
    for r in every + some:
        at = r["source"]
        for e in r["path"]:
            assert edges[e][1] == at
            at = edges[e][2]
        assert at == r["node"] and sum(edges[e][3] for e in r["path"]) == r["cost"]
    assert sorted((r["source"], r["node"], r["cost"]) for r in some) == sorted((r["source"], r["node"], r["cost"]) for r in every if r["node"] in (5, 7))
    with pytest.raises(RuntimeError):
        graph.shortest_paths(df, spark.createDataFrame([(0,)], "node long"), 20.0, most_rounds=1)


def test_overlap_of_a_line_with_itself(spark):
    rows = [("c", True, i, 5 + i * 0.001, 52.0) for i in range(20)] + [("r", False, i, 5 + i * 0.001, 52.0 if i < 10 else 53.0) for i in range(20)]
    got = catalogue.overlaps(spark.createDataFrame(rows, "key string, is_circuit boolean, seq int, lon double, lat double")).collect()
    assert [(r["route"], r["circuit"], r["share"]) for r in got] == [("r", "c", 0.5)]
