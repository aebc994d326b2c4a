"""Goal-directed searches, side trips, circuits and variants: against plain Dijkstra and one-by-one versions."""

import heapq
import math
import random

import pytest

from waymark.operators import circuits, graph, search

EDGE = "edge_id long, u long, v long, slice_id long, cost double, length_m double, rev boolean"
NODE = "node long, x double, y double"


def network(seed, n=60, near=3):
    """Nodes in a square, two-way roads to the nearest ones, and some one-way roads; cost is length times 1 to 3."""
    rng = random.Random(seed)
    at = {i: (rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(n)}
    rows, slices = [], set()
    for i in at:
        for j in sorted(at, key=lambda j: math.dist(at[i], at[j]))[1 : near + 1]:
            if (min(i, j), max(i, j)) not in slices:
                slices.add((min(i, j), max(i, j)))
                d, dull = math.dist(at[i], at[j]), rng.uniform(1, 3)
                for k, (u, v) in enumerate(((i, j), (j, i))):
                    if k == 0 or rng.random() < 0.9:
                        rows.append((2 * len(slices) + k, u, v, len(slices), d * dull if rng.random() < 0.97 else None, d, k == 1))
    return at, rows


def dijkstra(rows, start, goal, factor=lambda s: 1.0):
    """(cost, path) with ties by the lesser last edge; None if there is no way."""
    out = {}
    for e, u, v, s, cost, *_ in rows:
        if cost is not None and factor(s) is not None:
            out.setdefault(u, []).append((e, v, cost * factor(s)))
    best, by, heap, done = {start: 0.0}, {}, [(0.0, start)], set()
    while heap:
        g, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        for e, v, c in out.get(node, ()):
            if (g + c, e) < (best.get(v, math.inf), by.get(v, (math.inf,))[0]):
                best[v], by[v] = g + c, (e, node)
                heapq.heappush(heap, (g + c, v))
    if goal not in best:
        return None
    path, node = [], goal
    while node != start:
        path.append(by[node][0])
        node = by[node][1]
    return best[goal], path[::-1]


def frames(spark, at, rows):
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame([(i, *p) for i, p in at.items()], NODE)


def test_search_equals_dijkstra_and_reaches_less(spark):
    at, rows = network(1)
    edges, nodes = frames(spark, at, rows)
    rng = random.Random(2)
    pairs = [(k, *rng.sample(range(60), 2)) for k in range(8)] + [(8, 5, 5)]
    asked = spark.createDataFrame(pairs, "pair long, start long, goal long")
    factors = [(k, s, rng.choice([1.0, 2.5, None])) for k, *_ in pairs for s in rng.sample(range(1, 100), 20)]
    dearer = spark.createDataFrame(factors, "pair long, slice_id long, factor double")
    table = {(k, s): f for k, s, f in factors}
    for given, factor in ((None, lambda k: lambda s: 1.0), (dearer, lambda k: lambda s: table.get((k, s), 1.0))):
        got = {r["pair"]: (r["cost"], r["path"]) for r in search.cheapest_routes(edges, nodes, asked, dearer=given, bucket=150.0).collect()}
        want = {k: w for k, a, b in pairs if (w := dijkstra(rows, a, b, factor(k)))}
        assert set(got) == set(want)
        for k, (cost, path) in want.items():
            assert got[k][0] == pytest.approx(cost) and got[k][1] == path
    reached = search.reached_nodes(edges, nodes, asked, bucket=150.0).count()
    all_ = graph.shortest_paths(edges, asked.select("start").withColumnRenamed("start", "node"), 1e9).count() / len({p[1] for p in pairs}) * len(pairs)
    assert reached < 0.7 * all_
    near = search.cheapest_routes(edges, nodes, asked, bound=400.0)
    assert {r["pair"] for r in near.collect()} == {k for k, a, b in pairs if (w := dijkstra(rows, a, b)) and w[0] <= 400}


def test_search_refuses_too_cheap_edges(spark):
    edges, nodes = frames(spark, {0: (0.0, 0.0), 1: (10.0, 0.0)}, [(0, 0, 1, 0, 5.0, 10.0, False)])
    pair = spark.createDataFrame([(0, 0, 1)], "pair long, start long, goal long")
    with pytest.raises(Exception, match="straight way"):
        search.cheapest_routes(edges, nodes, pair)
    assert search.cheapest_routes(edges, nodes, pair, rate=0.5).first()["path"] == [0]


def cleaned(spark, nodes, path, shapes=None, slices=None, revs=()):
    """Side trips of one circuit; path: (u, v); an edge's slice is its own unless it is named."""
    rows, lines = [], {}
    for i, (u, v) in enumerate(path):
        s = (slices or {}).get(i, i)
        lines.setdefault(s, (shapes or {}).get(i, [nodes[u], nodes[v]]))
        rows.append((i, u, v, s, 1.0, 1.0, i in revs))
    segments = spark.createDataFrame([(s, [(float(x), float(y)) for x, y in line]) for s, line in lines.items()], "slice_id long, line array<struct<x:double,y:double>>")
    routes = spark.createDataFrame([(7, list(range(len(path))))], "route long, edges array<long>")
    got = circuits.without_side_trips(routes, spark.createDataFrame(rows, EDGE), segments).collect()
    return got[0]["edges"] if got else []


def test_side_trips(spark):
    at = [(0, 0), (1000, 0), (1200, 0), (1400, 0), (1000, 1000)]
    path = [(0, 1), (1, 2), (2, 3), (3, 2), (2, 1), (1, 4), (4, 0)]
    assert cleaned(spark, at, path, slices={3: 2, 4: 1}, revs=(3, 4)) == [0, 5, 6]
    # a tail with two carriageways: its edges are no reversals of each other
    at = [(0, 0), (1000, 0), (3000, 0), (4000, 0), (1000, 2000)]
    assert cleaned(spark, at, path, {4: [(3000, 0), (2900, 10), (1100, 10), (1000, 0)]}, {3: 2}, (3,)) == [0, 5, 6]
    # real loops at a junction stay, and so does the way from the start to a loop
    at = [(0, 0), (1000, 0), (2000, 0), (2000, 1000), (1000, 1000)]
    assert cleaned(spark, at, [(0, 1), (1, 2), (2, 3), (3, 1), (1, 4), (4, 0)]) == list(range(6))
    assert cleaned(spark, at, [(0, 1), (1, 2), (2, 3), (3, 1), (1, 0)]) == list(range(5))
    assert cleaned(spark, at, [(0, 1), (1, 0)], slices={1: 0}, revs=(1,)) == []
    with pytest.raises(ValueError, match="continuous and closed"):
        cleaned(spark, at, [(0, 1)])


def by_hand(path, ends, slice_of, at):
    """Side trips out of one circuit, one after the other; roads are straight."""

    def retraced(trip):
        points, gone = [], 0.0
        for e in trip:
            (ax, ay), (bx, by) = (at[n] for n in ends[e])
            d = math.hypot(bx - ax, by - ay)
            points += [(t, ax + (t - gone) / d * (bx - ax), ay + (t - gone) / d * (by - ay), (bx - ax) / d, (by - ay) / d) for t in (10.0 + 20 * k for k in range(9999)) if gone <= t < gone + d]
            gone += d
        hits = [any(abs(t - u) > 150 and math.hypot(x - p, y - q) <= 25 and hx * gx + hy * gy < -0.7 for u, p, q, gx, gy in points) for t, x, y, hx, hy in points]
        return sum(hits) / len(hits) if hits else 0.0

    def trip_to(end):
        for begin in range(end - 1, -1, -1):
            turned = begin == end - 2 and slice_of[path[begin]] == slice_of[path[end - 1]] and ends[path[begin]] == ends[path[end - 1]][::-1]
            if turned or (begin and ends[path[begin]][0] == ends[path[end - 1]][1] and retraced(path[begin:end]) >= 0.8):
                return begin
        return None

    while cuts := [(b, e) for e in range(1, len(path) + 1) if (b := trip_to(e)) is not None]:
        path = path[: cuts[0][0]] + path[cuts[0][1] :]
    return path


def share(a, b, slice_of, length):
    common = {slice_of[e] for e in a} & {slice_of[e] for e in b}
    return sum(max(length[e] for e in length if slice_of[e] == s) for s in common) / max(sum(length[e] for e in a), 1.0)


def test_variants_equal_one_by_one(spark):
    at, rows = network(5, 40)
    edges, nodes = frames(spark, at, rows)
    lines = {}
    for e, u, v, s, *_, rev in rows:
        lines[s] = [at[v], at[u]] if rev else [at[u], at[v]]
    segments = spark.createDataFrame(list(lines.items()), "slice_id long, line array<struct<x:double,y:double>>")
    rng = random.Random(8)
    pairs = [(k, *rng.sample(range(40), 2)) for k in range(6)]
    asked = spark.createDataFrame(pairs, "pair long, start long, goal long")
    found = circuits.circuit_variants(asked, edges, nodes, segments, 2, most_overlap=0.5).collect()
    got = {(r["pair"], r["variant"]): (r["edges"], r["out_and_back"]) for r in found}
    slice_of, length = {r[0]: r[3] for r in rows}, {r[0]: r[5] for r in rows}
    ends = {r[0]: (r[1], r[2]) for r in rows}
    want = {}
    for k, a, b in pairs:
        factor, kept = {}, []
        for variant in range(2):
            out = dijkstra(rows, a, b, lambda s: factor.get(s, 1.0))
            twice = dict(factor)
            for s in {slice_of[e] for e in out[1]} if out else ():
                twice[s] = twice.get(s, 1.0) * 2.5
            back = out and dijkstra(rows, b, a, lambda s: twice.get(s, 1.0))
            if not back:
                break
            whole = out[1] + back[1]
            clean = by_hand(whole, ends, slice_of, at)
            if not clean or any(share(clean, old, slice_of, length) > 0.5 for old in kept):
                break
            kept.append(clean)
            want[k, variant] = clean, len(clean) == len(whole) and share(out[1], back[1], slice_of, length) > 0.6
            for s in {slice_of[e] for e in clean}:
                factor[s] = factor.get(s, 1.0) * 2.5
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 6 and any(v for _, v in want)
    assert all(got[k][1] == v[1] for k, v in want.items() if len(v[0]) == len(set(v[0])))


def test_another_way_back(spark):
    rows = [(0, 0, 1, 0, 10.0, 10.0, False), (1, 1, 0, 0, 10.0, 10.0, True), (2, 1, 2, 1, 8.0, 8.0, False), (3, 2, 0, 2, 8.0, 8.0, False)]
    edges, nodes = frames(spark, {0: (0.0, 0.0), 1: (10.0, 0.0), 2: (5.0, 6.0)}, rows)
    segments = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0)]), (1, [(10.0, 0.0), (5.0, 6.0)]), (2, [(5.0, 6.0), (0.0, 0.0)])], "slice_id long, line array<struct<x:double,y:double>>")
    stretches = spark.createDataFrame([(4, 1, 0, 2), (4, 2, 2, 1), (5, 1, 2, 2)], "area long, rank int, start_node long, end_node long")
    ends = circuits.farthest_ends(stretches, nodes)
    assert [tuple(r) for r in ends.collect()] == [(4, 0, 1)]
    got = circuits.circuits(ends.withColumnRenamed("area", "pair"), edges, nodes, segments).collect()
    assert [(r["pair"], r["edges"], r["out_and_back"]) for r in got] == [(4, [0, 2, 3], False)]


def test_rounds_are_tiles_and_not_edges(spark):
    n = 200  # a straight road: as many edges on the way, in one tile
    rows = [(k, k, k + 1, k, 100.0, 100.0, False) for k in range(n)]
    edges, nodes = frames(spark, {k: (100.0 * k, 0.0) for k in range(n + 1)}, rows)
    pair = spark.createDataFrame([(0, 0, n)], "pair long, start long, goal long")
    assert search.cheapest_routes(edges, nodes, pair, most_rounds=12).first()["path"] == list(range(n))


def test_search_across_tiles_equals_dijkstra(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 6)
    at, rows = network(3)
    rows = [(*r[:4], r[4] and float(math.ceil(r[4])), *r[5:]) for r in rows]  # whole costs: some ways are equally dear
    edges, nodes = frames(spark, at, rows)
    rng = random.Random(4)
    pairs = [(k, *rng.sample(range(60), 2)) for k in range(6)]
    asked = spark.createDataFrame(pairs, "pair long, start long, goal long")
    table = {(k, s): rng.choice([1.0, 2.5, None]) for k, *_ in pairs for s in rng.sample(range(1, 100), 20)}
    dearer = spark.createDataFrame([(*k, f) for k, f in table.items()], "pair long, slice_id long, factor double")
    shut = {(k, e) for k, *_ in pairs for e in rng.sample([r[0] for r in rows], 10)}
    found = search.cheapest_routes(edges, nodes, asked, dearer=dearer, closed=spark.createDataFrame(sorted(shut), "pair long, edge_id long"))
    want = {k: w for k, a, b in pairs if (w := dijkstra([r for r in rows if (k, r[0]) not in shut], a, b, lambda s, k=k: table.get((k, s), 1.0)))}
    assert {r["pair"]: (r["cost"], r["path"]) for r in found.collect()} == want and len(want) > 3


def test_area_circuits_reach_the_far_corner(spark, data):
    from waymark.plans.base import Tables
    from waymark.plans.journeys import ACROSS, lattice
    from waymark.queries import QUERIES

    ways = {r.edge_id: (r.u, r.v) for r in lattice(Tables(spark, data))[0].collect()}
    areas = {}
    for u, v in ways.values():
        if u < v and u // (20 * ACROSS) == v // (20 * ACROSS):
            areas.setdefault(u // (20 * ACROSS), set()).update((u, v))
    found = {r.area: [int(e) for e in r.edges.split(",")] for r in QUERIES["area_circuits"](spark, data).where("variant = 0").collect()}
    assert found
    for area, edges in found.items():
        start = ways[edges[0]][0]
        away = lambda n, start=start: math.dist((n % ACROSS, n // ACROSS), (start % ACROSS, start // ACROSS))
        assert max(away(ways[e][1]) for e in edges) >= max(map(away, areas[area])) - 1e-9
