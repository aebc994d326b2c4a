"""Rides made of stretches: anchors joined by clean connectors into pairs and triples, and closed into loops, all areas together.

A ride is an array of edges. Each turn searches the connectors or returns of all rides that still need one at once, and
checks them together. What a ride may not use again is held as (ride, slice), and shared slices are found by equality on
these rows; the geometry of a ride is looked at last, and only if all else is right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import spatial
from .routes import retrace_share, route_points, trace
from .search import cheapest_routes, slice_share, steps_of
from .spatial import large


@dataclass(frozen=True)
class Rules:
    """Fixed values of rides: lengths in m, fun as a mean over the length, shares of the length."""

    stretch_fun: float = 0.55
    most_bridge: float = 0.25
    least_fun: float = 0.45
    dull_fun: float = 0.35
    most_dull: float = 0.20
    most_retrace: float = 0.20
    reach: float = 5000.0
    most_connector: float = 4000.0
    connector_bound: float = 20_000.0
    return_bound: float = 30_000.0
    most_shared: float = 0.30
    reuse: float = 15.0
    anchors: int = 5
    pairs: int = 8
    triples: int = 4
    loop_pairs: int = 6
    loop_triples: int = 2


class Network:
    """edges: edge_id, u, v, slice_id, cost, length_m, fun, excluded, mask, rev; nodes: node, x, y; segments: slice_id, line.

    options go to the searches.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, segments: DataFrame, rules: Rules | None = None, **options):
        # every step joins them: they are worked out once, and shuffled where they are joined
        self.edges, self.nodes, self.segments = written(edges, "edges"), written(nodes, "nodes"), written(segments, "segments")
        self.rules, self.options = rules or Rules(), options
        self.lengths = large(self.edges.select("edge_id", "slice_id", "length_m"))
        self.search_edges = self.edges.withColumn("cost", F.when(F.col("mask") != 0, F.col("cost")))

    def slices(self, rides: DataFrame, key: str, edges: str) -> DataFrame:
        return steps_of(rides, key, edges).join(self.lengths, "edge_id").select(key, "slice_id").distinct()

    def ends(self, rides: DataFrame, key: str, last_of: str, first_of: str) -> DataFrame:
        """(pair, start, goal): from the end of one array of edges to the beginning of another."""
        node = lambda name, end: self.edges.select(F.col("edge_id").alias(f"_{name}"), F.col(end).alias(name))
        asked = rides.select(F.col(key).alias("pair"), F.element_at(last_of, -1).alias("_start"), F.element_at(first_of, 1).alias("_goal"))
        return asked.join(large(node("start", "v")), "_start").join(large(node("goal", "u")), "_goal").select("pair", "start", "goal")

    def measured(self, rides: DataFrame, key: str = "ride") -> DataFrame:
        """rides (key, edges, ...) with length_m, fun_m (fun times length), dull_share and mask."""
        steps = steps_of(rides, key).join(large(self.edges.select("edge_id", "length_m", "fun", "excluded", "mask")), "edge_id")
        dull = (F.col("fun") < self.rules.dull_fun) | F.col("excluded")
        sums = steps.groupBy(key).agg(
            F.sum("length_m").alias("length_m"), F.sum(F.col("fun") * F.col("length_m")).alias("fun_m"),
            (F.sum(F.when(dull, F.col("length_m")).otherwise(0.0)) / F.sum("length_m")).alias("dull_share"), F.bit_and("mask").alias("mask"),
        )
        return rides.join(large(sums), key)

    def good(self, rides: DataFrame, least_m: float, most_m: float = 80_000.0, key: str = "ride") -> DataFrame:
        """The rides (key, edges, ...) of the right length, open in some window, rarely dull and hardly retracing themselves."""
        r = self.rules
        rides = self.measured(rides, key).where(F.col("length_m").between(least_m, most_m) & (F.col("mask") != 0) & (F.col("dull_share") <= r.most_dull) & (F.col("fun_m") / F.col("length_m") >= r.least_fun))
        rides = written(rides, "rides")
        steps = steps_of(rides, key).join(large(self.edges.select("edge_id", "slice_id", "rev")), "edge_id").select(F.col(key).alias("route"), "pos", "slice_id", "rev")
        shares = retrace_share(trace(route_points(steps, self.segments))).select(F.col("route").alias(key), F.col("share").alias("_traced"))
        return rides.join(large(shares), key, "left").where(F.coalesce("_traced", F.lit(0.0)) <= r.most_retrace).drop("_traced")


def anchors(net: Network, stretches: DataFrame, opposites: DataFrame) -> DataFrame:
    """(area, stretch, way, edges): the directions of each area's best stretches that make an anchor.

    stretches: area, stretch, edges. Way 0 is as given, way 1 back over the opposite edges, none of which may be missing
    or excluded. A direction needs the stretch's fun with little bridged road. The best: by fun times length of the
    better direction, then the first edge.
    """
    r = net.rules
    steps = steps_of(stretches.select("stretch", "edges"), "stretch")
    back = steps.join(large(opposites), "edge_id", "left").groupBy("stretch").agg(F.reverse(F.array_sort(F.collect_list(F.struct("pos", F.col("opposite_id").alias("e"))))).alias("_b"))
    back = back.select("stretch", F.col("_b.e").alias("edges")).where(~F.exists("edges", lambda e: e.isNull()))
    both = stretches.select("stretch", F.lit(0).alias("way"), "edges").unionByName(back.select("stretch", F.lit(1).alias("way"), "edges")).withColumn("ride", F.struct("stretch", "way"))
    quality = steps_of(both, "ride").join(large(net.edges), "edge_id").groupBy("ride").agg(
        F.sum("length_m").alias("_m"), F.sum(F.col("fun") * F.col("length_m")).alias("_fun"),
        F.sum(F.when(F.col("fun") < r.stretch_fun, F.col("length_m")).otherwise(0.0)).alias("_bridged"), F.max(F.col("excluded").cast("int")).alias("_ex"),
    )
    fine = (F.col("_m") > 0) & (F.col("_fun") >= r.stretch_fun * F.col("_m")) & (F.col("_bridged") <= r.most_bridge * F.col("_m")) & ((F.col("ride.way") == 0) | (F.col("_ex") == 0))
    named = both.join(large(quality.where(fine)), "ride").join(large(stretches.select("stretch", "area", F.col("edges")[0].alias("_first"))), "stretch")
    best = named.groupBy("area", "stretch", "_first").agg(F.max("_fun").alias("_best"))
    chosen = best.withColumn("_n", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("_best"), "_first"))).where(F.col("_n") <= r.anchors)
    return written(named.join(large(chosen.select("stretch")), "stretch", "left_semi").select("area", "stretch", "way", "edges"), "anchors")


def connected(net: Network, legs: DataFrame) -> DataFrame:
    """legs (leg, first, second, ...) that a clean connector joins, with edges, length_m, fun_m, dull_share, mask.

    The cheapest connector is tried, then one that avoids both parts and, if it kept off them, the rejected one's roads.
    A connector shares no slice with either part; parts that share one are not joined.
    """
    r, key = net.rules, "leg"
    first, second = net.slices(legs, key, "first"), net.slices(legs, key, "second")
    apart = written(legs.join(large(first.join(large(second), [key, "slice_id"]).select(key).distinct()), key, "left_anti"), "legs")
    used = written(net.slices(apart.withColumn("_both", F.concat("first", "second")), key, "_both"), "used")

    def tried(some: DataFrame, ways: DataFrame) -> DataFrame:
        made = some.join(large(ways.select(F.col("pair").alias(key), F.col("path").alias("way"))), key)
        length = steps_of(made, key, "way").join(net.lengths, "edge_id")
        bad = length.join(large(used), [key, "slice_id"], "left_semi").select(key).union(length.groupBy(key).agg(F.sum("length_m").alias("_m")).where(F.col("_m") > r.most_connector).select(key))
        made = made.join(large(bad.distinct()), key, "left_anti").withColumn("edges", F.concat("first", "way", "second"))
        return written(net.good(made, 2000.0, key=key).drop("way"), "connected")

    ways = cheapest_routes(net.search_edges, net.nodes, net.ends(apart, key, "first", "second"), bound=r.connector_bound, **net.options)
    right = tried(apart, ways)
    rest = written(apart.join(large(right.select(key)), key, "left_anti"), "rest")
    rejected = net.slices(ways.withColumnRenamed("pair", key).join(large(rest.select(key)), key, "left_semi"), key, "path")
    touching = rejected.join(large(used), [key, "slice_id"], "left_semi").select(key).distinct()
    blocked = used.unionByName(rejected.join(large(touching), key, "left_anti")).distinct()
    barred = blocked.select(F.col(key).alias("pair"), "slice_id", F.lit(None).cast("double").alias("factor"))
    others = cheapest_routes(net.search_edges, net.nodes, net.ends(rest, key, "first", "second"), bound=r.connector_bound, dearer=barred, **net.options)
    return right.unionByName(tried(rest, others))


def closed(net: Network, rides: DataFrame, opposites: DataFrame, most_return: float | None = None) -> DataFrame:
    """rides (ride, first, ...) with a return to their start: edges, length_m, fun_m, dull_share, mask.

    The first try sees the ride's own slices at `reuse` times their cost and may not turn round on the last edge. If it
    is rejected, its roads and the ride's are closed; if that gives none, its roads are only made dearer.
    """
    r, key = net.rules, "ride"
    used = written(net.slices(rides, key, "first"), "used")
    pairs = written(net.ends(rides, key, "first", "first"), "ends")
    empty = F.expr("cast(array() as array<long>)")
    steps = steps_of(rides, key, "first").drop("pos")

    def tried(some: DataFrame, ways: DataFrame) -> DataFrame:
        made = written(some.join(large(ways.select(F.col("pair").alias(key), F.col("path").alias("way"))), key), "returns")
        back = steps_of(made, key, "way").drop("pos")
        one = slice_share(steps.join(large(made.select(key)), key, "left_semi"), back, net.lengths, [key]).where(F.col("share") > r.most_shared)
        other = slice_share(back, steps, net.lengths, [key]).where(F.col("share") > r.most_shared)
        bad = one.select(key).union(other.select(key))
        if most_return is not None:
            bad = bad.union(back.join(net.lengths, "edge_id").groupBy(key).agg(F.sum("length_m").alias("_m")).where(F.col("_m") > most_return).select(key))
        made = made.join(large(bad.distinct()), key, "left_anti").withColumn("edges", F.concat("first", "way"))
        return written(net.good(made, 3000.0).drop("way"), "closed")

    there = pairs.where("start = goal").select("pair", empty.alias("path"))
    going = pairs.where("start <> goal")
    own = lambda factor: used.select(F.col(key).alias("pair"), "slice_id", F.lit(factor).cast("double").alias("factor"))
    last = rides.select(F.col(key).alias("pair"), F.element_at("first", -1).alias("edge_id")).join(large(opposites), "edge_id").select("pair", F.col("opposite_id").alias("edge_id"))
    ways = cheapest_routes(net.search_edges, net.nodes, going, dearer=own(r.reuse), closed=last, **net.options)
    found = tried(rides, ways.select("pair", "path").unionByName(there))
    rest = written(rides.join(large(found.select(key)), key, "left_anti").join(large(there.select(F.col("pair").alias(key))), key, "left_anti"), "rest")
    rejected = written(net.slices(ways.withColumnRenamed("pair", key), key, "path"), "rejected")
    for factor in (None, r.reuse):
        more = rejected.join(large(used), [key, "slice_id"], "left_anti").select(F.col(key).alias("pair"), "slice_id", F.lit(factor).cast("double").alias("factor"))
        asked = going.join(large(rest.select(F.col(key).alias("pair"))), "pair", "left_semi")
        ways = cheapest_routes(net.search_edges, net.nodes, asked, dearer=own(None).unionByName(more), bound=r.return_bound, **net.options)
        found = found.unionByName(tried(rest, ways))
        rest = written(rest.join(large(found.select(key)), key, "left_anti").join(large(rejected.select(key).distinct()), key, "left_semi"), "rest")
    return found


def linked_rides(net: Network, stretches: DataFrame, opposites: DataFrame) -> DataFrame:
    """(area, type, anchors, edges, length_m, fun_m, dull_share, mask): open rides and circuits of two or three anchors.

    anchors: the stretches in driving order. Each area's best pairs are extended by a third anchor within reach; the best
    pairs and triples are open rides (one for each set of slices) and the best of them are closed. fun_m ranks, then the edges.
    """
    r = net.rules
    ways = anchors(net, stretches, opposites)
    place = lambda name: net.nodes.select(F.col("node").alias(name), "x", "y")
    node = lambda df, at, end, name: df.join(large(net.edges.select(F.col("edge_id").alias("_e"), F.col(end).alias(name))), F.element_at("edges", at) == F.col("_e")).drop("_e").join(large(place(name)), name).drop(name)
    entering = node(ways.select(F.col("area").alias("_area"), F.col("stretch").alias("_next"), F.col("way").alias("_way"), "edges"), 1, "u", "_n").withColumnRenamed("edges", "second")
    best = Window.partitionBy("area").orderBy(F.desc("fun_m"), "edges", "anchors")

    def extended(rides: DataFrame) -> DataFrame:
        leaving = node(rides.select("area", "anchors", "edges"), -1, "v", "_n").withColumnRenamed("edges", "first")
        near = spatial.within(leaving, entering, r.reach, same=("area", "_area")).where(~F.array_contains("anchors", F.col("_next")))
        legs = numbered(near.select("area", F.concat("anchors", F.array("_next")).alias("anchors"), "first", "second"), "leg")
        made = connected(net, legs).drop("leg", "first", "second")
        return written(made.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max(r.pairs, r.triples)), "made")

    pairs = extended(ways.select("area", F.array("stretch").alias("anchors"), "edges"))
    triples = extended(pairs.where(F.col("_n") <= r.pairs))
    open_ = pairs.where(F.col("_n") <= r.pairs).unionByName(triples.where(F.col("_n") <= r.triples)).drop("_n")
    open_ = numbered(open_, "ride")
    sets = net_sets(net, open_)
    first = Window.partitionBy("area", "_set").orderBy(F.desc("fun_m"), "edges", F.size("anchors"), "anchors")
    open_ = open_.join(large(sets), "ride").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    loops = triples.where(F.col("_n") <= r.loop_triples).unionByName(pairs.where(F.col("_n") <= r.loop_pairs))
    loops = numbered(loops.select("area", "anchors", F.col("edges").alias("first")), "ride")
    columns = ["area", "type", "anchors", "edges", "length_m", "fun_m", "dull_share", "mask"]
    return open_.withColumn("type", F.lit("open")).select(columns).unionByName(closed(net, loops, opposites).withColumn("type", F.lit("circuit")).select(columns))


def numbered(rides: DataFrame, name: str) -> DataFrame:
    """rides, written, with a number of their own: searches carry it in place of the rides' edges."""
    return written(rides.withColumn(name, F.monotonically_increasing_id()), name)


def net_sets(net: Network, rides: DataFrame) -> DataFrame:
    """(ride, _set): the slices of each ride, in order, with repeats."""
    return steps_of(rides, "ride").join(net.lengths, "edge_id").groupBy("ride").agg(F.array_sort(F.collect_list("slice_id")).alias("_set"))


def short_loops(net: Network, stretches: DataFrame, opposites: DataFrame, least_m: float = 2000.0, most_m: float = 25_000.0, most_dull: float = 0.45) -> DataFrame:
    """(stretch, way, edges, length_m, fun_m, dull_share, mask, nth): short ways home from a two-way stretch, the best first.

    stretches: stretch, window (one bit), edges. Both directions have to be fun all along, not excluded, and open in the window;
    the way home uses edges open in the window, the stretch's own slices at `reuse` times their cost, and shares at most
    three tenths of either.
    """
    r = net.rules
    steps = steps_of(stretches, "stretch").join(opposites, "edge_id", "left")
    on = net.edges.select("edge_id", F.col("mask").alias("_there"))
    back = net.edges.select(F.col("edge_id").alias("opposite_id"), "fun", "excluded", "mask")
    two = steps.join(on, "edge_id").join(back, "opposite_id", "left").groupBy("stretch").agg(
        F.max((F.col("opposite_id").isNull() | F.col("excluded") | (F.col("fun") < r.stretch_fun)).cast("int")).alias("_bad"),
        F.bit_and(F.col("_there").bitwiseAND(F.coalesce("mask", F.lit(0)))).alias("mask"), F.reverse(F.array_sort(F.collect_list(F.struct("pos", F.col("opposite_id").alias("e"))))).alias("_b"),
    )
    fit = written(stretches.join(two.where("_bad = 0"), "stretch").where(F.col("mask").bitwiseAND(F.col("window")) != 0).select("stretch", "window", "edges", F.col("_b.e").alias("back")), "fit")
    driven = numbered(fit.select("stretch", "window", F.posexplode(F.array("edges", "back")).alias("way", "first")), "ride")
    pairs = net.ends(driven, "ride", "first", "first").join(driven.select(F.col("ride").alias("pair"), "window"), "pair")
    own = net.slices(driven, "ride", "first").select(F.col("ride").alias("pair"), "slice_id", F.lit(r.reuse).alias("factor"))
    ways = cheapest_routes(net.search_edges, net.nodes, pairs, dearer=own, **net.options).where(F.size("path") > 0)
    made = written(driven.join(ways.select(F.col("pair").alias("ride"), F.col("path").alias("home")), "ride"), "made")
    shared = slice_share(steps_of(made, "ride", "first").drop("pos"), steps_of(made, "ride", "home").drop("pos"), net.lengths, ["ride"])
    full = made.join(shared.where(F.col("share") <= r.most_shared), "ride").select("ride", "stretch", "way", F.concat("first", "home").alias("edges"))
    good = net.measured(full).where(F.round(F.col("length_m") / 1000, 1).between(least_m / 1000, most_m / 1000) & (F.col("dull_share") <= most_dull))
    order = Window.partitionBy("stretch").orderBy(F.round("dull_share", 2), F.desc(F.round(F.col("fun_m") / 1000, 1)), F.round(F.col("length_m") / 1000, 1), "way")
    return good.withColumn("nth", F.row_number().over(order)).select("stretch", "way", "edges", "length_m", "fun_m", "dull_share", "mask", "nth")
