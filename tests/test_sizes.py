"""What grows with the tables is not broadcast: Spark guesses exploded rows and arrays far under their size."""

from __future__ import annotations

import pytest

from waymark.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["official_speeds", "register_on_roads", "roads_side_by_side"])
def test_lines_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SMOKE))


def test_a_place_between_two_legs_is_traced_once(spark):
    from waymark.operators.routes import trace

    points = spark.createDataFrame([(0, k, x, 224309.80000000002) for k, x in enumerate((29.84, 59.84, 89.84, 119.84, 149.84))], "route long, seq long, x double, y double")
    assert sorted(r.t for r in trace(points).collect()) == [10.0, 30.0, 50.0, 70.0, 90.0, 110.0]


def test_pairs_of_places_do_not_grow_with_copies(spark):
    from pyspark.sql import functions as F
    from waymark.operators import spatial

    left = spark.range(400).select("id", (F.col("id") % 20 * 9.0).alias("x"), (F.col("id") % 3 * 5.0).alias("y"))
    right = spark.range(300).select(F.col("id").alias("r"), (F.col("id") % 10 * 31.0).alias("x"), F.lit(2.5).alias("y"))
    got = {(r.id, r.r, round(r.distance, 9)) for r in spatial.nearest(left, right, 60.0, "id", "r").select("id", "r", "distance").collect()}
    near = lambda x, y: min((round(((x - r % 10 * 31.0) ** 2 + (y - 2.5) ** 2) ** 0.5, 9), r) for r in range(300))
    asked = {i: near(i % 20 * 9.0, i % 3 * 5.0) for i in range(400)}
    assert got == {(i, r, d) for i, (d, r) in asked.items() if d <= 60}
    from waymark.queries import QUERIES

    plan = QUERIES["vote_argmax"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (((_cell") < plan.rindex("Aggregate")  # places are distinct below the join
    pairs = spatial.within(left, right, 60.0)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()  # full cells are not merged into few tasks


def test_corners_take_one_line_at_a_time(spark):
    from waymark.operators import sequence

    samples = spark.createDataFrame([(line, k, 10.0 * k, 10.0 * k if k < 9 else 80.0, 0.0 if k < 9 else 10.0 * (k - 8)) for line in (3, 4) for k in range(18)], "line long, k long, s double, x double, y double")
    corners = sequence.detect_corners(samples)
    assert sorted(r.line for r in corners.collect()) == [3, 4]
    assert "collect_list" not in plan(corners)  # no batch of whole lines


def test_a_walk_looks_at_an_edge_a_few_times():
    import pandas as pd
    from waymark.operators import graph

    looks = 0

    class Counted(bytearray):
        def __getitem__(self, k):
            nonlocal looks
            looks += 1
            return super().__getitem__(k)

    n = 600  # n ways into one node and n ways out of it
    rows = [(k, 1 + k, 0, k) for k in range(n)] + [(n + k, 0, n + 1 + k, n + k) for k in range(n)]
    table = pd.DataFrame(rows, columns=["edge_id", "u", "v", "slice_id"]).assign(length_m=600.0, fun=0.7, excluded=False)
    part = graph._Part(table, 0.55, 400.0, 8)
    part.taken = Counted(len(part.taken))
    found = part.stretches(1000.0)
    assert [s[0] for s in found] == [[k, n + k] for k in range(n)]
    assert looks < 12 * len(rows)


def test_components_of_stretches_are_not_merged_into_few_tasks(spark):
    from waymark.queries import QUERIES

    assert "REPARTITION_BY_NUM" in plan(QUERIES["mined_stretches"](spark, SMOKE))


def test_searches_and_rides_broadcast_no_table(spark, monkeypatch):
    from pyspark.sql import functions as F
    from waymark.operators import chains, graph, search

    plans, write = [], search.written
    monkeypatch.setattr(search, "FEW", 0)
    monkeypatch.setattr(search, "FEW_OPEN", 0)
    for module in (search, graph):
        monkeypatch.setattr(module, "written", lambda df, what, kept=False: plans.append(plan(df)) or write(df, what, kept))
    nodes = spark.range(6).select(F.col("id").alias("node"), (F.col("id") * 100.0).alias("x"), F.lit(0.0).alias("y"))
    ahead = spark.range(5).select(F.col("id").alias("edge_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.col("id").alias("slice_id"), F.lit(100.0).alias("cost"), F.lit(100.0).alias("length_m"))
    pairs = spark.createDataFrame([(0, 0, 5), (1, 2, 4)], "pair long, start long, goal long")
    dearer = spark.createDataFrame([(1, 3, 2.0)], "pair long, slice_id long, factor double")
    got = {(r.pair, r.cost, tuple(r.path)) for r in search.cheapest_routes(ahead, nodes, pairs, dearer=dearer).collect()}
    assert got == {(0, 500.0, (0, 1, 2, 3, 4)), (1, 300.0, (2, 3))}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    edges = ahead.withColumns({"fun": F.lit(0.7), "excluded": F.lit(False), "mask": F.lit(255), "rev": F.lit(False)})
    net = chains.Network(edges, nodes, spark.range(5).select(F.col("id").alias("slice_id"), F.lit(0.0).alias("line")))
    rides = spark.createDataFrame([(7, [0, 1, 2])], "ride long, edges array<long>")
    assert net.measured(rides).first().length_m == 300.0
    assert "BroadcastHashJoin" not in plan(net.measured(rides)) + plan(net.slices(rides, "ride", "edges"))


def test_common_slices_are_summed_without_a_row_for_each_pair(spark, monkeypatch):
    from waymark.operators import graph

    monkeypatch.setattr(graph, "SHARD", 3)  # slices of several pieces
    uses = [(p, s) for p in range(9) for s in range(12) if (p * 7 + s * 5) % 3 or s == 4] + [(2, 4), (20, 30)]
    lengths = {s: 1.0 + s % 5 for s in range(31)}
    found = graph.shared_share(spark.createDataFrame(uses, "path long, slice_id long"), spark.createDataFrame(list(lengths.items()), "slice_id long, length_m double"), 0.3)
    total = {p: max(sum(lengths[s] for q, s in uses if q == p), 1.0) for p, _ in uses}
    common = {(p, q): sum(lengths[s] for s in {s for r, s in uses if r == p} & {s for r, s in uses if r == q}) for p in total for q in total if p != q}
    assert {(r.a, r.b): round(r.share, 9) for r in found.collect()} == {k: round(v / total[k[0]], 9) for k, v in common.items() if v / total[k[0]] >= 0.3 - 1e-9}
    assert "keys=[a#" not in plan(found)  # nothing is grouped by pairs


def test_percentiles_of_a_group_lie_in_many_tasks(spark):
    from pyspark.sql import functions as F
    from waymark.operators import profiles
    from waymark.queries import QUERIES

    rows = [(g, None if k % 11 == 0 else float(k * k % 97)) for g in (1, 2, None) for k in range(1, 40 * (g or 3))] + [(4, None), (5, 3.5)] + [(6, 1.0)] * 50 + [(6, 9.0)]
    table = spark.createDataFrame(rows, "g long, v double")
    shares = {"low": 0.2, "mid": 0.5, "high": 0.99}
    found = profiles.exact_percentiles(table, ["g"], "v", shares)
    asked = table.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()])
    key = lambda r: (r.g is None, r.g)
    assert sorted(found.collect(), key=key) == sorted(asked.collect(), key=key)
    assert "ObjectHashAggregate" not in plan(QUERIES["percentiles"](spark, SMOKE))  # no task holds a group's values


@pytest.mark.parametrize("name", ["route_profiles", "height_profiles"])
def test_profiles_shuffle_what_grows_with_routes(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SMOKE))


def test_components_deal_links_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from waymark.operators import graph, spatial

    links = spark.range(400).selectExpr("id as a", "if(id % 40 = 39, id, id + 1) as b")
    monkeypatch.setattr(spatial, "TASK_ROWS", 25)
    plans, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what, kept=False: plans.append(plan(df)) or write(df, what, kept))
    found = graph.components(links)
    assert {(r.node, r.root) for r in found.collect()} == {(k, k // 40 * 40) for k in range(400)}
    assert "hashpartitioning(u#" in plans[1] and all("REPARTITION_BY_NUM" in p for p in plans[1:])
    import re

    assert not any(int(n) == 4 for p in plans for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", p))  # none is left to the session's four


def test_stretches_leave_the_miner_one_by_one(spark):
    import tracemalloc

    import numpy as np
    from waymark.operators import graph

    n = 40_000  # pairs of edges, each pair a stretch of its own, all in one component's task
    k = np.arange(n)
    rows = {"edge_id": np.concatenate([k, n + k]), "u": np.concatenate([k, n + k]), "v": np.concatenate([n + k, 2 * n + k]), "slice_id": np.arange(2 * n), "length_m": np.full(2 * n, 600.0), "fun": np.full(2 * n, 0.7)}
    tracemalloc.start()
    count = 0
    for edges, *_ in graph._Part(rows, 0.55, 400.0, 8).stretches(1000.0):
        assert edges == [count, n + count]
        count += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and peak < 150 * 2 * n  # bytes for an edge, building included


def test_shipments_deal_lines_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from waymark.operators import spatial
    from waymark.plans.base import Tables
    from waymark.plans.network import shipments

    want = sorted(shipments(Tables(spark, SMOKE)).collect())
    monkeypatch.setattr(spatial, "TASK_ROWS", 500)
    dealt = shipments(Tables(spark, SMOKE))
    assert plan(dealt).count("REPARTITION_BY_NUM") == 2 and sorted(dealt.collect()) == want
