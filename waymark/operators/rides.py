"""Rides that link two stretches by a clean connector, found for all pairs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial
from .graph import shortest_paths


def linked_pairs(
    stretches: DataFrame, edges: DataFrame, nodes: DataFrame, reach: float = 5000.0, bound: float = 20000.0, most_connector: float = 4000.0,
    least_m: float = 2000.0, most_m: float = 80000.0, most_dull: float = 0.20, least_fun: float = 0.45, dull: float = 0.35,
) -> DataFrame:
    """(a, b, edges, length_m, mean_fun, dull_share, mask): stretch a, a connector, stretch b.

    stretches: stretch, area, edges, start_node, end_node; edges: edge_id, u, v, slice_id, cost, length_m, fun, excluded,
    mask; nodes: node, x, y. A pair is of one area and shares no slice; its connector is the cheapest within the bound,
    uses no slice of either, and the whole is open in some window, long enough, and rarely dull.
    """
    place = lambda name: nodes.select(F.col("node").alias(name), "x", "y")
    leaving = stretches.select(F.col("stretch").alias("a"), F.col("area").alias("_area"), F.col("end_node").alias("_from")).join(place("_from"), "_from")
    entering = stretches.select(F.col("stretch").alias("b"), F.col("area").alias("_area2"), F.col("start_node").alias("_to")).join(place("_to"), "_to")
    pairs = spatial.within(leaving, entering, reach, same=("_area", "_area2")).where("a <> b").select("a", "b", "_from", "_to")
    ways = shortest_paths(edges.select("edge_id", "u", "v", "cost"), pairs.select(F.col("_from").alias("node")).distinct(), bound, targets=pairs.select(F.col("_to").alias("node")))
    joined = pairs.join(ways.withColumnsRenamed({"source": "_from", "node": "_to", "path": "_way"}).drop("cost"), ["_from", "_to"])
    own = stretches.select(F.col("stretch").alias("a"), F.col("edges").alias("_out")).join(joined, "a").join(stretches.select(F.col("stretch").alias("b"), F.col("edges").alias("_in")), "b")
    steps = own.withColumn("edges", F.concat("_out", "_way", "_in")).select("a", "b", "edges", F.posexplode("edges").alias("_pos", "edge_id"), F.size("_out").alias("_n"), F.size("_way").alias("_m"))
    part = F.when(F.col("_pos") < F.col("_n"), 0).when(F.col("_pos") < F.col("_n") + F.col("_m"), 1).otherwise(2)
    known = steps.withColumn("_part", part).join(edges.select("edge_id", "slice_id", "length_m", "fun", "excluded", "mask"), "edge_id")
    length = F.col("length_m")
    dull_m = F.when((F.col("fun") < dull) | F.col("excluded"), length).otherwise(0.0)
    slices = lambda k: F.collect_set(F.when(F.col("_part") == k, F.col("slice_id")))
    rides = known.groupBy("a", "b", "edges").agg(
        F.sum(length).alias("length_m"), (F.sum(F.col("fun") * length) / F.sum(length)).alias("mean_fun"), (F.sum(dull_m) / F.sum(length)).alias("dull_share"),
        F.sum(F.when(F.col("_part") == 1, length).otherwise(0.0)).alias("_connector"), F.bit_and("mask").alias("mask"), slices(0).alias("_s0"), slices(1).alias("_s1"), slices(2).alias("_s2"),
    )
    apart = ~F.arrays_overlap("_s0", "_s1") & ~F.arrays_overlap("_s1", "_s2") & ~F.arrays_overlap("_s0", "_s2")
    good = apart & (F.col("_connector") <= most_connector) & F.col("length_m").between(least_m, most_m) & (F.col("mask") != 0) & (F.col("dull_share") <= most_dull) & (F.col("mean_fun") >= least_fun)
    return rides.where(good).select("a", "b", "edges", "length_m", "mean_fun", "dull_share", "mask")


def reversible(stretches: DataFrame, edges: DataFrame, opposites: DataFrame, threshold: float = 0.55, most_bridge: float = 0.25) -> DataFrame:
    """(stretch, back, mask, mean_fun) of stretches that may be driven both ways, are fun on the way back wherever they
    were on the way out, share a window, and keep the fun floor with little bridged road.

    stretches: stretch, edges; edges: edge_id, length_m, fun, excluded, mask; opposites: edge_id, opposite_id.
    """
    steps = stretches.select("stretch", F.posexplode("edges").alias("pos", "edge_id")).join(edges, "edge_id").join(opposites, "edge_id", "left")
    other = edges.select(F.col("edge_id").alias("opposite_id"), F.col("fun").alias("_fun2"), F.col("excluded").alias("_ex2"), F.col("mask").alias("_mask2"))
    both = steps.join(other, "opposite_id", "left")
    fails = F.col("opposite_id").isNull() | F.col("_ex2") | ((F.col("fun") >= threshold) & (F.col("_fun2") < threshold))
    low = F.when(F.col("fun") < threshold, F.col("length_m")).otherwise(0.0)
    found = both.groupBy("stretch").agg(
        F.max(F.coalesce(fails, F.lit(True)).cast("int")).alias("_fails"), F.bit_and(F.col("mask").bitwiseAND(F.coalesce("_mask2", F.lit(0)))).alias("mask"),
        (F.sum(F.col("fun") * F.col("length_m")) / F.sum("length_m")).alias("mean_fun"), (F.sum(low) / F.sum("length_m")).alias("_bridged"),
        F.reverse(F.array_sort(F.collect_list(F.struct("pos", "opposite_id")))).alias("_back"),
    )
    good = (F.col("_fails") == 0) & (F.col("mask") != 0) & (F.col("mean_fun") >= threshold) & (F.col("_bridged") <= most_bridge)
    return found.where(good).select("stretch", F.col("_back.opposite_id").alias("back"), "mask", "mean_fun")
