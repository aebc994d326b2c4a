"""Stops for navigation: against a one-by-one version on random lines, and the rules' cases."""

import math
import random
from urllib.parse import parse_qs, urlparse

import pytest

from waymark.operators import waypoints

KIND = "route long, seq int, lon double, lat double"


def off(p, a, b):
    scale = 111.195 * math.cos(math.radians((a[1] + b[1]) / 2))
    x, y, px, py = (b[0] - a[0]) * scale, (b[1] - a[1]) * 111.195, (p[0] - a[0]) * scale, (p[1] - a[1]) * 111.195
    t = min(1, max(0, (px * x + py * y) / (x * x + y * y))) if x * x + y * y else 0
    return math.hypot(px - t * x, py - t * y)


def haversine(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def by_hand(line, budget):
    """(km, place) of the stops of one line."""
    km = [0.0]
    for a, b in zip(line, line[1:]):
        km.append(km[-1] + haversine(a, b))

    def at(x):
        k = next((k for k in range(1, len(km)) if km[k] >= x), len(km) - 1)
        t = min(1, max(0, (x - km[k - 1]) / (km[k] - km[k - 1])))
        return x, tuple(p + t * (q - p) for p, q in zip(line[k - 1], line[k]))

    def strays(a, b, lo=None, hi=None):
        found = [(off(line[k], a[1], b[1]), -k) for k in range(1, len(line) - 1) if (a[0] if lo is None else lo) < km[k] < (b[0] if hi is None else hi)]
        best = max(found, default=(0.0, 1))
        return best if best[0] > 0 else (0.0, 1)

    stops = [(0.0, line[0]), (km[-1], line[-1])]
    for _ in range(budget):
        options = []
        for a, b in zip(stops, stops[1:]):
            dev, k = strays(a, b)
            score = math.inf if a[1] == b[1] and dev > 0 else max(dev / 0.1, (b[0] - a[0]) / 5)
            new = (km[-k], line[-k]) if dev > 0 and (a[1] == b[1] or dev / 0.1 >= (b[0] - a[0]) / 5) else at((a[0] + b[0]) / 2)
            if score > 1 and new[1] not in (a[1], b[1]):
                options.append((-score, a[0], new))
        if not options:
            break
        stops = sorted([*stops, min(options)[2]])
    if all(strays(a, b)[0] <= 0.1 + 1e-9 and b[0] - a[0] <= 5 + 1e-9 for a, b in zip(stops, stops[1:])):
        return stops
    shape, step = stops[1:-1], km[-1] / (budget + 1)
    stops = [stops[0], *(at(i * step) for i in range(1, budget + 1)), stops[-1]]
    for j in range(budget):
        i = budget - j // 2 if j % 2 else 1 + j // 2
        a, b, lo, hi = stops[i - 1], stops[i + 1], (i - 0.5) * step, (i + 0.5) * step
        dev, k = strays(a, b, lo, hi)
        tried = [stops[i], *(s for s in shape if lo <= s[0] <= hi), *([(km[-k], line[-k])] if dev > 0 else [])]
        scored = [(max(strays(a, c)[0], strays(c, b)[0]), n, c) for n, c in enumerate(tried) if c[1] not in (a[1], b[1])]
        if scored:
            stops[i] = min(scored)[2]
    out = [stops[0]]
    for a, p, b in zip(stops, stops[1:], stops[2:]):
        probe = min(0.1, (p[0] - a[0]) / 4, (b[0] - p[0]) / 4)
        (_, q), (_, r), scale = at(p[0] - probe), at(p[0] + probe), math.cos(math.radians(p[1][1]))
        u, v = ((p[1][0] - q[0]) * scale, p[1][1] - q[1]), ((r[0] - p[1][0]) * scale, r[1] - p[1][1])
        size = math.hypot(*u) * math.hypot(*v)
        way = at(p[0] - min(0.5, (p[0] - a[0]) / 4))
        out.append(way if size and (u[0] * v[0] + u[1] * v[1]) / size < math.sqrt(0.5) and way[1] != a[1] else p)
    return [*out, stops[-1]]


@pytest.mark.parametrize("budget", [3, 9])
def test_random_lines(spark, budget):
    rng = random.Random(budget)
    lines = {}
    for r in range(14):
        line, turn = [(5 + rng.random(), 52 + rng.random())], rng.uniform(0, 6)
        for _ in range(rng.choice([3, 20, 60])):
            turn += rng.gauss(0, 0.5)
            d = rng.uniform(0.0005, 0.02 if r % 2 else 0.004)
            line.append((line[-1][0] + d * math.cos(turn), line[-1][1] + d * math.sin(turn)))
        lines[r] = line
    lines[14] = [(5.0, 52.0), (5.1, 52.0), (5.1, 52.05), (5.0, 52.0)]  # ends where it begins
    lines[15] = [(5.0, 52.0), (5.001, 52.0)]
    rows = [(r, k, *p) for r, line in lines.items() for k, p in enumerate(line)]
    got = {r["route"]: r for r in waypoints.navigation(spark.createDataFrame(rows, KIND), False, budget).collect()}
    for r, line in lines.items():
        want = by_hand(line, budget)
        assert [s["km"] for s in got[r]["stops"]] == pytest.approx([s[0] for s in want], abs=1e-7), r
        assert [x for s in got[r]["stops"] for x in (s["lon"], s["lat"])] == pytest.approx([x for s in want for x in s[1]], abs=1e-7)
    assert got[15]["href"] == "https://www.google.com/maps/dir/?api=1&origin=52.0%2C5.0&destination=52.0%2C5.001&travelmode=driving" and not got[15]["limited"]
    assert any(r["limited"] for r in got.values()) or budget == 9


def test_loops_and_faults(spark):
    rows = [(1, 0, 5.0, 52.0), (1, 1, 5.0, 52.0), (1, 2, 5.02, 52.0), (1, 3, 5.02, 52.02), (2, 0, 5.0, 52.0), (3, 0, 5.0, None)]
    got = waypoints.navigation(spark.createDataFrame(rows, KIND), True).collect()
    assert [r["route"] for r in got] == [1]  # one place alone is no route
    stops = [(s["lon"], s["lat"]) for s in got[0]["stops"]]
    assert stops == [(5.0, 52.0), (5.02, 52.0), (5.02, 52.02), (5.0, 52.0)]
    link = parse_qs(urlparse(got[0]["href"]).query)
    assert link["origin"] == link["destination"] == ["52.0,5.0"] and link["waypoints"] == ["52.0,5.02|52.02,5.02"]
    with pytest.raises(Exception, match="not on the map"):
        waypoints.navigation(spark.createDataFrame([(1, 0, 5.0, 52.0), (1, 1, 5.0, 95.0)], KIND), False)
    with pytest.raises(ValueError, match="1 to 9"):
        waypoints.navigation(spark.createDataFrame([], KIND), False, 10)
