"""Rides of several stretches: the rules one by one on small graphs, and connectors against a one-by-one version."""

import math
import random

import pytest
from test_circuits import dijkstra

from waymark.operators import chains

EDGE = "edge_id long, u long, v long, slice_id long, cost double, length_m double, fun double, excluded boolean, mask int, rev boolean"


def net(spark, nodes, edges, slices=None, cost=None, mask=None, excluded=(), fun=None, **rules):
    """A network of straight roads: edges (u, v, length, fun); an edge that shares a slice is drawn along its first edge."""
    slices = slices or list(range(len(edges)))
    first, rows, lines = {}, [], {}
    for e, ((u, v, length, f), s) in enumerate(zip(edges, slices)):
        first.setdefault(s, u)
        lines.setdefault(s, [tuple(map(float, nodes[u])), tuple(map(float, nodes[v]))])
        rows.append((e, u, v, s, float(cost[e] if cost else length), float(length), float((fun or {}).get(e, f)), e in excluded, (mask or {}).get(e, 255), u != first[s]))
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(nodes)], "node long, x double, y double")
    segments = spark.createDataFrame(list(lines.items()), "slice_id long, line array<struct<x:double,y:double>>")
    network = chains.Network(spark.createDataFrame(rows, EDGE), nodes, segments, chains.Rules(**rules), rate=0.0)
    opposite = [(a[0], b[0]) for a in rows for b in rows if a[3] == b[3] and a[1] == b[2] and a[2] == b[1] and a[0] != b[0]]
    return network, spark.createDataFrame(opposite, "edge_id long, opposite_id long")


SQUARE = [(100000, 490000), (101100, 490000), (101700, 490000), (101700, 491200)]
ROADS = [(0, 1, 1100, 0.7), (1, 2, 600, 0.4), (2, 3, 1200, 0.75), (3, 0, 2200, 0.45)]


def rides(spark, network, stretches):
    df = spark.createDataFrame([(0, k, e) for k, e in enumerate(stretches)], "area long, stretch long, edges array<long>")
    return {(r["type"], tuple(r["edges"])): r for r in chains.linked_rides(network[0], df, network[1]).collect()}


def test_two_stretches_are_linked_and_closed(spark):
    got = rides(spark, net(spark, SQUARE, ROADS), [[0], [2]])
    assert set(got) == {("open", (0, 1, 2)), ("open", (2, 3, 0)), ("circuit", (0, 1, 2, 3)), ("circuit", (2, 3, 0, 1))} and got["open", (0, 1, 2)]["anchors"] == [0, 1]
    assert got["circuit", (0, 1, 2, 3)]["mask"] == 255 and got["circuit", (0, 1, 2, 3)]["length_m"] == 5100
    # a closed return, a return that is mostly dull, parts that are never open together, one stretch alone
    assert set(rides(spark, net(spark, SQUARE, ROADS, mask={3: 0}), [[0], [2]])) == {("open", (0, 1, 2))}
    assert set(rides(spark, net(spark, SQUARE, ROADS, fun={3: 0.3}), [[0], [2]])) == {("open", (0, 1, 2))}
    assert ("open", (0, 1, 2)) not in rides(spark, net(spark, SQUARE, ROADS, mask={0: 2, 1: 1, 2: 2, 3: 2}), [[0], [2]])
    assert rides(spark, net(spark, SQUARE, ROADS), [[0]]) == {}


def test_an_anchor_has_to_be_fun_in_its_direction(spark):
    assert rides(spark, net(spark, SQUARE, ROADS, fun={0: 0.54}), [[0], [2]]) == {}
    nodes = [(100000, 490000), (101100, 490000), (100000, 491200), (101700, 491200)]
    roads = [(0, 1, 1100, 0.54), (1, 0, 1100, 0.72), (0, 2, 600, 0.5), (2, 3, 1200, 0.75), (3, 2, 1200, 0.75)]
    got = rides(spark, net(spark, nodes, roads, [0, 0, 2, 4, 4]), [[0], [3]])
    assert ("open", (1, 2, 3)) in got and all(0 not in e for k, e in got if k == "open")


def test_three_stretches_are_chained_before_closing(spark):
    nodes = [*SQUARE, (102100, 491200), (103300, 491200)]
    roads = [*ROADS, (3, 4, 400, 0.4), (4, 5, 1200, 0.75), (5, 0, 2000, 0.45)]
    network, opposite = net(spark, nodes, roads)
    df = spark.createDataFrame([(0, k, e) for k, e in enumerate([[0], [2], [5]])], "area long, stretch long, edges array<long>")
    triples = {(r["type"], tuple(r["edges"])) for r in chains.linked_rides(network, df, opposite).collect() if len(r["anchors"]) == 3}
    # the roads of others are a pair's already: the pair is the open ride then; the two best triples are closed
    assert triples == {("open", (2, 4, 5, 6, 0)), ("circuit", (2, 4, 5, 6, 0, 1)), ("circuit", (5, 6, 0, 1, 2, 4))}


def loops(spark, network, first):
    df = spark.createDataFrame([(0, first)], "ride long, first array<long>")
    return [r["edges"] for r in chains.closed(network[0], df, network[1]).collect()]


def test_loops_try_again(spark):
    # the cheapest return is too dull
    roads = [*ROADS, (3, 4, 1200, 0.55), (4, 0, 1200, 0.55)]
    assert loops(spark, net(spark, [*SQUARE, (100000, 491200)], roads, cost=[1, 1, 1, 1, 10, 10], fun={3: 0.25}), [0, 1, 2]) == [[0, 1, 2, 4, 5]]
    # turning round at the end of the chain is no way home
    nodes = [(0, 0), (3000, 0), (3000, 200), (0, 3000), (1500, -1000)]
    roads = [(0, 1, 3000, 0.7), (1, 2, 200, 0.7), (2, 1, 200, 0.7), (1, 4, 1800, 0.7), (4, 0, 1800, 0.7), (2, 3, 4300, 0.7), (3, 0, 3000, 0.7)]
    assert loops(spark, net(spark, nodes, roads, [0, 1, 1, 3, 4, 5, 6]), [0, 1]) == [[0, 1, 5, 6]]
    # the rejected return holds the only exit: it is made dearer, not closed
    nodes = [(0, 0), (2000, 0), (2500, 500), (2500, 2500)]
    roads = [(0, 1, 2000, 0.7), (1, 2, 700, 0.7), (2, 0, 2550, 0.1), (2, 3, 2000, 0.7), (3, 0, 3540, 0.7)]
    assert loops(spark, net(spark, nodes, roads), [0]) == [[0, 1, 3, 4]]
    # a chain that ends where it began needs no return
    assert loops(spark, net(spark, SQUARE, ROADS), [0, 1, 2, 3]) == [[0, 1, 2, 3]]


def joined(spark, network, legs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(legs)], "leg long, first array<long>, second array<long>")
    return {r["leg"]: r["edges"] for r in chains.connected(network[0], df).collect()}


def test_connectors_keep_off_the_anchors(spark):
    nodes = [(0, 0), (100, 0), (200, 0), (150, 100), (300, 0)]
    roads = [(0, 1, 1100, 0.7), (2, 4, 1200, 0.75), (1, 0, 1100, 0.7), (0, 2, 100, 0.5), (1, 3, 400, 0.6), (3, 2, 400, 0.6)]
    cost = [1, 1, 1, 1, 3, 3]
    slices = [0, 2, 0, 6, 8, 10]
    assert joined(spark, net(spark, nodes, roads, slices, cost), [([0], [1])]) == {0: [0, 4, 5, 1]}
    assert joined(spark, net(spark, nodes, roads, slices, cost, mask={5: 0}), [([0], [1])]) == {}
    # two carriageways of one road are no two anchors
    nodes, roads = [(0, 0), (2000, 0), (2000, 16), (0, 16)], [(0, 1, 2000, 0.8), (2, 3, 2000, 0.8), (1, 2, 30, 0.5)]
    assert joined(spark, net(spark, nodes, roads, most_retrace=1.0), [([0], [1])]) == {0: [0, 2, 1]}
    assert joined(spark, net(spark, nodes, roads), [([0], [1])]) == {}


def test_connectors_equal_one_by_one(spark):
    rng = random.Random(3)
    at = [(rng.uniform(0, 9000), rng.uniform(0, 9000)) for _ in range(40)]
    roads, slices, fun = [], [], []
    for i in range(40):
        for j in sorted(range(40), key=lambda j: math.dist(at[i], at[j]))[1:4]:
            d = math.dist(at[i], at[j])
            f = rng.choice([0.2, 0.6, 0.8, 0.9])
            roads += [(i, j, d, f), (j, i, d, f)]
            slices += [len(fun)] * 2
            fun += [f]
    network = net(spark, at, roads, slices, most_retrace=1.0)
    legs = [([a], [b]) for a, b in (rng.sample(range(len(roads)), 2) for _ in range(90))]
    rows = [(e, u, v, s, d, d, False) for e, ((u, v, d, _), s) in enumerate(zip(roads, slices))]

    def fine(first, way, second):
        edges = [*first, *way, *second]
        total = sum(roads[e][2] for e in edges)
        used = {slices[e] for e in first + second}
        dull = sum(roads[e][2] for e in edges if roads[e][3] < 0.35)
        return not used & {slices[e] for e in way} and sum(roads[e][2] for e in way) <= 4000 and 2000 <= total <= 80000 and dull <= 0.2 * total and sum(roads[e][2] * roads[e][3] for e in edges) >= 0.45 * total

    want = {}
    for k, (a, b) in enumerate(legs):
        used = {slices[a[0]], slices[b[0]]}
        if len(used) < 2:
            continue
        blocked = set(used)
        for turn in range(2):
            way = dijkstra(rows, roads[a[0]][1], roads[b[0]][0], lambda s: None if turn and s in blocked else 1.0)
            if way and way[0] <= 20000 and fine(a, way[1], b):
                want[k] = a + way[1] + b
                break
            if way and not used & {slices[e] for e in way[1]}:
                blocked |= {slices[e] for e in way[1]}
    assert joined(spark, network, legs) == want and len(want) > 4


def test_short_loops(spark):
    nodes, roads = [(100000, 490000), (101100, 490000), (100550, 490900)], [(0, 1, 1100, 0.7), (1, 0, 1100, 0.7), (1, 2, 1300, 0.4), (2, 0, 1300, 0.4)]
    stretch = spark.createDataFrame([(0, 1, [0])], "stretch long, window int, edges array<long>")
    network, opposite = net(spark, nodes, roads, [0, 0, 2, 4])
    got = chains.short_loops(network, stretch, opposite).collect()
    assert [(r["edges"], r["length_m"], r["mask"], r["nth"]) for r in got] == [([0, 2, 3], 3700.0, 255, 1)] and got[0]["dull_share"] == pytest.approx(0.0)
    assert chains.short_loops(net(spark, nodes, roads, [0, 0, 2, 4], mask={3: 2})[0], stretch, opposite).collect() == []
    assert chains.short_loops(net(spark, nodes, roads, [0, 0, 2, 4], fun={1: 0.5})[0], stretch, opposite).collect() == []
