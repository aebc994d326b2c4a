"""Linked rides and reversible stretches on small graphs."""

import pytest

from waymark.operators import reports, rides

EDGES = "edge_id long, u long, v long, slice_id long, cost double, length_m double, fun double, excluded boolean, mask int"


def network(spark):
    rows = [(0, 0, 1, 0, 1500.0, 0.9, 255), (1, 1, 2, 1, 300.0, 0.4, 15), (2, 2, 3, 2, 1500.0, 0.8, 255), (3, 1, 0, 0, 1500.0, 0.7, 255), (4, 3, 2, 2, 1500.0, 0.3, 255), (5, 3, 0, 5, 300.0, 0.1, 0)]
    return spark.createDataFrame([(e, u, v, s, m, m, f, False, k) for e, u, v, s, m, f, k in rows], EDGES)


def test_linked_pair(spark):
    stretches = spark.createDataFrame([(1, 0, [0], 0, 1), (2, 0, [2], 2, 3), (3, 1, [2], 2, 3)], "stretch long, area int, edges array<long>, start_node long, end_node long")
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1500.0, 0.0), (2, 1800.0, 0.0), (3, 3300.0, 0.0)], "node long, x double, y double")
    got = rides.linked_pairs(stretches, network(spark), nodes).collect()
    assert [(r["a"], r["b"], r["edges"], r["mask"]) for r in got] == [(1, 2, [0, 1, 2], 15)]
    assert got[0]["mean_fun"] == pytest.approx((0.9 * 1500 + 0.4 * 300 + 0.8 * 1500) / 3300)


def test_reversible(spark):
    stretches = spark.createDataFrame([(1, [0]), (2, [2]), (3, [5])], "stretch long, edges array<long>")
    opposites = spark.createDataFrame([(0, 3), (3, 0), (2, 4), (4, 2)], "edge_id long, opposite_id long")
    got = rides.reversible(stretches, network(spark), opposites).collect()
    assert [(r["stretch"], r["back"]) for r in got] == [(1, [3])]  # the others are dull or closed on the way back


def test_reports(spark):
    df = spark.createDataFrame([(1, 2, 50, 80, 0.9), (2, 2, 60, 60, 0.5), (3, 1, 30, 80, None)], "edge_id long, speed_source int, official int, tagged int, confidence double")
    assert {r["speed_source"]: r["share"] for r in reports.source_mix(df).collect()} == {1: pytest.approx(1 / 3), 2: pytest.approx(2 / 3)}
    assert [r["edge_id"] for r in reports.disagreements(df).collect()] == [3, 1]
    assert reports.confidence(df).first()["above_08"] == 0.5
    assert [(r["column"], r["known"], r["missing"]) for r in reports.coverage(df, ["confidence"]).collect()] == [("confidence", 2, 1)]
