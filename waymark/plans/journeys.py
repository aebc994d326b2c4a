"""Queries of searches on a lattice of customers: 40 nodes in a row, two-way roads to the right and down, dull or fun by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, circuits, search, waypoints
from .base import Tables, query, r6

ACROSS = 40

LATTICE = f"""n AS (SELECT c_custkey AS node, 100.0 * (c_custkey % {ACROSS}) AS x, 100.0 * (c_custkey // {ACROSS}) AS y FROM customer),
h AS (SELECT a.node AS p, b.node AS q, (a.node * 2654435761 + b.node * 40503) % 1000 AS r FROM n a JOIN n b ON (b.node = a.node + 1 AND a.node % {ACROSS} < {ACROSS - 1}) OR b.node = a.node + {ACROSS}),
e AS MATERIALIZED (SELECT p * 4 + k AS edge_id, CASE k % 2 WHEN 0 THEN p ELSE q END AS u, CASE k % 2 WHEN 0 THEN q ELSE p END AS v, least(p, q) * 2 + (q - p = 1)::INT AS slice_id, 100.0 AS length_m, 100.0 + r * 0.5 AS cost, r FROM (SELECT *, CASE WHEN q - p = 1 THEN 0 ELSE 2 END AS k0 FROM h), range(2) g(k1), LATERAL (SELECT k0 + k1 AS k) WHERE r % 37 > 0)"""


def lattice(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): edge_id, u, v, slice_id, length_m, cost; some roads are left out."""
    nodes = t.customer.select(F.col("c_custkey").alias("node"), (100.0 * (F.col("c_custkey") % ACROSS)).alias("x"), (100.0 * F.expr(f"c_custkey div {ACROSS}")).alias("y"))
    ahead = F.explode(F.array(F.struct((F.col("node") + 1).alias("q"), F.lit(0).alias("k")), F.struct((F.col("node") + ACROSS).alias("q"), F.lit(2).alias("k"))))
    halves = nodes.select(F.col("node").alias("p"), ahead.alias("_a")).select("p", "_a.q", "_a.k").where(f"k = 2 or p % {ACROSS} < {ACROSS - 1}")
    halves = halves.join(nodes.select(F.col("node").alias("q")), "q", "left_semi").withColumn("r", (F.col("p") * 2654435761 + F.col("q") * 40503) % 1000).where("r % 37 > 0")
    both = halves.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    forward = F.col("way") == 0
    edges = both.select(
        (F.col("p") * 4 + F.col("k") + F.col("way")).alias("edge_id"), F.when(forward, F.col("p")).otherwise(F.col("q")).alias("u"), F.when(forward, F.col("q")).otherwise(F.col("p")).alias("v"),
        (F.col("p") * 2 + (F.col("k") == 0).cast("int")).alias("slice_id"), F.lit(100.0).alias("length_m"), (100.0 + F.col("r") * 0.5).alias("cost"),
    )
    return edges, nodes


@query(f"""WITH RECURSIVE {LATTICE},
pair AS (SELECT node AS pair, node AS start, node + 207 AS goal FROM n WHERE node % 250 = 3 AND node + 207 IN (SELECT node FROM n)),
d(pair, node, cost) USING KEY (pair, node) AS (SELECT pair, start, 0.0::DOUBLE FROM pair
  UNION SELECT d.pair, e.v, min(d.cost + e.cost) FROM d JOIN e ON e.u = d.node LEFT JOIN recurring.d AS old ON old.pair = d.pair AND old.node = e.v WHERE d.cost + e.cost <= 6000 AND (old.cost IS NULL OR d.cost + e.cost < old.cost) GROUP BY ALL)
SELECT pair.pair, round(cost, 4) AS cost FROM pair JOIN d ON d.pair = pair.pair AND d.node = pair.goal""")
def goal_directed_routes(t: Tables) -> DataFrame:
    """The cheapest way from each stated node to the one five rows down and seven across."""
    edges, nodes = lattice(t)
    pairs = nodes.where("node % 250 = 3").select(F.col("node").alias("pair"), F.col("node").alias("start"), (F.col("node") + 207).alias("goal"))
    return search.cheapest_routes(edges, nodes, pairs, bound=6000.0).select("pair", F.round("cost", 4).alias("cost"))


def area_stretches(ahead: DataFrame) -> DataFrame:
    """(area, rank, start_node, end_node): all roads of the lattice that lie in one block of twenty rows."""
    rows = ACROSS * 20
    inside = ahead.where(f"not rev and u div {rows} = v div {rows}")
    return inside.select(F.expr(f"u div {rows}").alias("area"), (F.col("edge_id") % (4 * rows)).alias("rank"), F.col("u").alias("start_node"), F.col("v").alias("end_node"))


@query(None)
def area_circuits(t: Tables) -> DataFrame:
    """Up to two circuits of each area (a block of twenty rows), out to its far corner and back on other roads (searches: tested one by one).

    Every road inside an area is a stretch of it, in the order of the lattice.
    """
    edges, nodes = lattice(t)
    ahead = edges.withColumn("rev", F.col("u") > F.col("v"))
    pairs = circuits.farthest_ends(area_stretches(ahead), nodes).withColumnRenamed("area", "pair")
    place = lambda name: nodes.select(F.col("node").alias(name), F.struct("x", "y").alias(f"_{name}"))
    drawn = ahead.where("not rev").join(place("u"), "u").join(place("v"), "v").select("slice_id", F.array("_u", "_v").alias("line"))
    found = circuits.circuit_variants(pairs, ahead, nodes, drawn)
    return found.select(F.col("pair").alias("area"), "variant", F.array_join("edges", ",").alias("edges"), "out_and_back")


@query(None)
def linked_loops(t: Tables) -> DataFrame:
    """Open rides and circuits of stretches along the lattice's rows (searches and choices: tested one by one)."""
    edges, nodes = lattice(t)
    fun = F.when((F.col("edge_id") * 7) % 10 < 8, 0.75).otherwise(0.4)
    edges = edges.withColumn("rev", F.col("u") > F.col("v")).withColumns({"fun": fun, "excluded": F.lit(False), "mask": F.lit(255), "length_m": F.col("length_m") * 10, "cost": F.col("cost") * 10})
    nodes = nodes.withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10})
    place = lambda name: nodes.select(F.col("node").alias(name), F.struct("x", "y").alias(f"_{name}"))
    drawn = edges.where("not rev").join(place("u"), "u").join(place("v"), "v").select("slice_id", F.array("_u", "_v").alias("line"))
    right = edges.where(f"v = u + 1 and u % {ACROSS} % 8 in (1, 2) and u div {ACROSS} % 6 < 4")
    stretches = right.groupBy(F.expr(f"u div {ACROSS * 6}").alias("area"), F.expr(f"(u div {ACROSS}) * 8 + u % {ACROSS} div 8").alias("stretch")).agg(F.array_sort(F.collect_list("edge_id")).alias("edges")).where("size(edges) = 2")
    back = edges.select(F.col("edge_id"), F.when(F.col("rev"), F.col("edge_id") - 1).otherwise(F.col("edge_id") + 1).alias("opposite_id"))
    found = chains.linked_rides(chains.Network(edges, nodes, drawn), stretches, back)
    return found.select("area", "type", F.array_join("anchors", ",").alias("anchors"), F.array_join("edges", ",").alias("edges"), r6("length_m").alias("length_m"), r6("fun_m").alias("fun_m"))


@query(None)
def navigation_stops(t: Tables) -> DataFrame:
    """Stops and links of routes of twenty customers each (refinement in rounds: tested one by one)."""
    places = t.customer.select(F.expr("c_custkey div 20").alias("route"), (F.col("c_custkey") % 20).alias("seq"), (5 + F.col("c_custkey") % 20 * 0.01 + F.col("c_acctbal") / 2e6).alias("lon"), (52 + F.col("c_custkey") * 7 % 31 * 0.001).alias("lat"))
    found = waypoints.navigation(places, loop=False)
    return found.select("route", F.size("stops").alias("n_stops"), "href", "limited", r6("max_gap_km").alias("max_gap_km"), r6("max_deviation_km").alias("max_deviation_km"))
