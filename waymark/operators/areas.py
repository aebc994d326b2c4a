"""Choices in rank order that only affect their surroundings: area clusters, tints.

Clusters and tints are made in rounds of joins: an item decides once no better item that could affect it is open, so
items far from each other decide in the same round, and nothing is brought into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import spatial


def cluster_areas(stretches: DataFrame, radius: float = 6000.0, least_fun_km: float = 3.0) -> DataFrame:
    """(stretch, seed): stretches (stretch, x, y, fun_km), best first, each in the first cluster whose weighted centre
    is within the radius; clusters under least_fun_km go.

    A stretch that is taken in lies within the radius of the centre and moves it by less than that, so a stretch can
    only affect others within three radii: those decide one after the other.
    """
    order = F.struct((-F.col("fun_km")).alias("fun"), F.col("stretch").alias("stretch"))
    items = written(stretches.select("stretch", "x", "y", "fun_km", order.alias("at")), "items")
    pairs = spatial.within(items.select("stretch", "x", "y", "at"), items.select(F.col("stretch").alias("other"), F.col("at").alias("other_at"), "x", "y"), 3 * radius)
    pairs = written(pairs.where("other_at < at").select("stretch", "other"), "pairs")
    open_ = written(items, "open")
    clusters = written(items.limit(0).select(F.col("stretch").alias("seed"), "at", "x", "y", F.col("fun_km").alias("weight")), "clusters")
    members = clusters.select(F.col("seed").alias("stretch"), "seed")
    while not open_.isEmpty():
        waiting = pairs.join(open_.select(F.col("stretch").alias("other")), "other", "left_semi").select("stretch").distinct()
        ready = written(open_.join(waiting, "stretch", "left_anti"), "ready")
        near = spatial.within(ready.select("stretch", "x", "y"), clusters.select("seed", F.col("at").alias("seed_at"), "x", "y"), radius)
        homes = near.groupBy("stretch").agg(F.min_by("seed", "seed_at").alias("seed"))
        placed = written(ready.join(homes, "stretch", "left").withColumn("seed", F.coalesce("seed", "stretch")), "placed")
        new = placed.where("seed = stretch").select("seed", "at", "x", "y", F.col("fun_km").alias("weight"))
        joined = placed.where("seed <> stretch").select("seed", F.lit(None).cast(items.schema["at"].dataType).alias("at"), "x", "y", F.col("fun_km").alias("weight"))
        parts = clusters.unionByName(new).unionByName(joined).groupBy("seed")
        centre = [(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in ("x", "y")]
        clusters = written(parts.agg(F.max("at").alias("at"), *centre, F.sum("weight").alias("weight")), "clusters")
        members = written(members.unionByName(placed.select("stretch", "seed")), "members")
        open_ = written(open_.join(ready.select("stretch"), "stretch", "left_anti"), "open")
    return members.join(clusters.where(F.col("weight") >= least_fun_km).select("seed"), "seed", "left_semi").select("stretch", "seed")


def tints(items: DataFrame, pad: float = 0.004, bucket: float = 0.05, n: int = 6) -> DataFrame:
    """(item, tint): items (item, rank, west, south, east, north), highest rank first, each in the tint that the fewest
    better neighbours have. Neighbours' boxes meet when padded; they share a bucket, or they could not."""
    reach = lambda lo, hi: F.sequence(F.floor((F.col(lo) - pad) / bucket), F.floor((F.col(hi) + pad) / bucket))
    cells = items.withColumn("_cx", F.explode(reach("west", "east"))).withColumn("_cy", F.explode(reach("south", "north")))
    b = cells.select(*[F.col(c).alias(f"b_{c}") for c in cells.columns])
    meet = (F.col("west") - pad <= F.col("b_east")) & (F.col("east") + pad >= F.col("b_west")) & (F.col("south") - pad <= F.col("b_north")) & (F.col("north") + pad >= F.col("b_south"))
    better = F.struct(-F.col("b_rank"), F.col("b_item")) < F.struct(-F.col("rank"), F.col("item"))
    pairs = cells.join(b, (F.col("_cx") == F.col("b__cx")) & (F.col("_cy") == F.col("b__cy")) & meet & better).select("item", F.col("b_item").alias("other")).distinct()
    pairs = written(pairs, "pairs")
    open_ = written(items.select("item"), "open")
    done = written(open_.limit(0).select("item", F.lit(0).alias("tint")), "tints")
    every = F.explode(F.array(*[F.lit(k) for k in range(n)])).alias("tint")
    while not open_.isEmpty():
        waiting = pairs.join(open_.select(F.col("item").alias("other")), "other", "left_semi").select("item").distinct()
        ready = written(open_.join(waiting, "item", "left_anti"), "ready")
        taken = pairs.join(ready, "item", "left_semi").join(done.withColumnRenamed("item", "other"), "other").groupBy("item", "tint").agg(F.count(F.lit(1)).alias("_taken"))
        choice = ready.select("item", every).join(taken, ["item", "tint"], "left").groupBy("item").agg(F.min(F.struct(F.coalesce("_taken", F.lit(0)).alias("taken"), "tint")).alias("c"))
        done = written(done.unionByName(choice.select("item", F.col("c.tint").alias("tint"))), "tints")
        open_ = written(open_.join(ready, "item", "left_anti"), "open")
    return done
