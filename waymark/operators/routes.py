"""Routes over the network: geometry and retracing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spatial


def route_points(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """(route, seq, x, y) along each path, in driving order, without the doubled point at joints.

    paths: route, pos, slice_id, rev; segments: slice_id, line array<struct<x, y>>.
    """
    drawn = paths.join(spatial.large(segments), "slice_id").withColumn("_line", F.when(F.col("rev"), F.reverse("line")).otherwise(F.col("line")))
    points = drawn.select("route", "pos", F.posexplode("_line").alias("_i", "_p")).where("not (pos > 0 and _i = 0)")
    seq = F.row_number().over(Window.partitionBy("route").orderBy("pos", "_i"))
    return points.select("route", seq.cast("long").alias("seq"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def trace(points: DataFrame, step: float = 20.0) -> DataFrame:
    """(route, t, x, y, hx, hy): places every step m from half a step on, and the heading there."""
    w = Window.partitionBy("route").orderBy("seq")
    legs = points.withColumn("_x", F.lead("x").over(w)).withColumn("_y", F.lead("y").over(w))
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    legs = legs.withColumn("_end", F.sum(F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a leg ends where the next one begins, to the last bit: no place falls between two legs or on both
    legs = legs.withColumn("_s", F.coalesce(F.lag("_end").over(w), F.lit(0.0))).withColumn("_d", F.col("_end") - F.col("_s")).where("_d > 0")
    first = F.greatest(F.lit(0), F.ceil((F.col("_s") - step / 2) / step))
    last = F.ceil((F.col("_end") - step / 2) / step) - 1
    placed = legs.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("_k", F.explode(F.sequence("_a", "_b")))
    t = F.col("_k") * step + step / 2
    share = (t - F.col("_s")) / F.col("_d")
    hx, hy = (F.col("_x") - F.col("x")) / F.col("_d"), (F.col("_y") - F.col("y")) / F.col("_d")
    return placed.select("route", t.alias("t"), (F.col("x") + share * (F.col("_x") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("_y") - F.col("y"))).alias("y"), hx.alias("hx"), hy.alias("hy"))


def retrace_share(traced: DataFrame, radius: float = 25.0, gap: float = 150.0) -> DataFrame:
    """(route, share): how much of a route passes within the radius of itself the other way, further along than gap."""
    other = traced.select(F.col("route").alias("_route"), F.col("t").alias("_t"), "x", "y", F.col("hx").alias("_hx"), F.col("hy").alias("_hy"))
    pairs = spatial.within(traced, other, radius, same=("route", "_route")).where((F.abs(F.col("t") - F.col("_t")) > gap) & (F.col("hx") * F.col("_hx") + F.col("hy") * F.col("_hy") < -0.7))
    hit = pairs.select("route", "t").distinct().groupBy("route").agg(F.count(F.lit(1)).alias("_n"))
    every = traced.groupBy("route").agg(F.count(F.lit(1)).alias("_all"))
    return every.join(spatial.large(hit), "route", "left").select("route", (F.coalesce("_n", F.lit(0)) / F.col("_all")).alias("share"))


def near_share(traced: DataFrame, radius: float = 25.0) -> DataFrame:
    """(route, other, share): how much of a route lies within the radius of another, either way."""
    other = traced.select(F.col("route").alias("other"), "x", "y")
    hit = spatial.within(traced, other, radius).where("route <> other").select("route", "other", "t").distinct().groupBy("route", "other").agg(F.count(F.lit(1)).alias("_n"))
    every = traced.groupBy("route").agg(F.count(F.lit(1)).alias("_all"))
    return hit.join(spatial.large(every), "route").select("route", "other", (F.col("_n") / F.col("_all")).alias("share"))
