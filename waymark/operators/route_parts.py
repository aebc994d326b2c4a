"""What a route is made of: roads, corners, warnings, members of lists, places along a line; ranks of whole routes.

Steps of a route are rows (route, seq, ...); everything is grouped or windowed by route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roads
from . import spatial


def route_roads(steps: DataFrame, most: int = 3) -> DataFrame:
    """(route, place, name, km, fun): the named roads with most fun-metres; ties by name. steps: route, name, fun, length_m."""
    each = steps.where("name is not null and name <> ''").groupBy("route", "name").agg(F.sum(F.col("fun") * F.col("length_m")).alias("_fun_m"), F.sum("length_m").alias("_m"))
    best = Window.partitionBy("route").orderBy(F.desc("_fun_m"), "name")
    each = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    fun = F.round(100 * F.col("_fun_m") / F.greatest("_m", F.lit(1e-9))).cast("int")
    return each.select("route", "place", "name", F.round(F.col("_m") / 1000, 1).alias("km"), fun.alias("fun"))


def corner_totals(steps: DataFrame) -> DataFrame:
    """(route, tight, sweet, flowing) from the steps' counts of hairpins, sweet and flowing corners."""
    return steps.groupBy("route").agg(*[F.sum(c).cast("long").alias(n) for n, c in (("tight", "n_hairpin"), ("sweet", "n_sweet"), ("flowing", "n_flowing"))])


def route_warnings(steps: DataFrame, most: int = 4) -> DataFrame:
    """(route, kind, nth, edge_id): the first edges with cameras, the first with two bumps or more, and the middle one of
    those that cyclists fill. steps: route, seq, edge_id, cameras, bumps, cyclists."""
    kinds = {"camera": F.col("cameras") > 0, "bump": F.col("bumps") >= 2, "cyclists": F.col("cyclists") > 0.65}
    marked = steps.select("route", "seq", "edge_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("kind"))
    w = Window.partitionBy("route", "kind")
    numbered = marked.withColumn("nth", F.row_number().over(w.orderBy("seq", "edge_id"))).withColumn("_of", F.count(F.lit(1)).over(w))
    middle = F.col("nth") == F.floor(F.col("_of") / 2) + 1
    return numbered.where(F.when(F.col("kind") == "cyclists", middle).otherwise(F.col("nth") <= most)).select("route", "kind", "nth", "edge_id")


def grouped_notes(stops: DataFrame) -> DataFrame:
    """(route, note, n, first): stops (route, pos, note) by note, with the position of the first."""
    return stops.groupBy("route", "note").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def road_index(names: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, label, count): roads of all routes by key, named as first seen, with the number of routes that have them.

    names: route, pos, name; routes and positions give the order of seeing.
    """
    keyed = names.select("route", "pos", "name", (roads.road_key(F.col("name")) if key is None else key).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("name", F.struct("route", "pos")).alias("label"), F.countDistinct("route").alias("count"))


def rank_circuits(circuits: DataFrame, most: int = 12) -> DataFrame:
    """The best circuits with their place: loops first, then fun_km, score, area, main before variant, and the edges.

    circuits: out_and_back, fun_km, score, area, variant (boolean), edges. Only `most` rows are kept while sorting.
    """
    order = ["out_and_back", F.desc("fun_km"), F.desc("score"), "area", "variant", "edges"]
    best = circuits.orderBy(*order).limit(most)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # at most `most` rows


def in_view(routes: DataFrame, view: tuple[float, float, float, float], most: int = 250) -> DataFrame:
    """The best-ranked routes (rank, key, west, south, east, north) whose box meets the view, at most `most`."""
    box = tuple(F.col(c) for c in ("west", "south", "east", "north"))
    return routes.where(roads.boxes_meet(box, tuple(F.lit(v) for v in view))).orderBy("rank", "key").limit(most)


def ordered_members(lists: DataFrame, routes: DataFrame) -> DataFrame:
    """(list, place, key, ...): members of lists (list, keys) that routes (key, ...) have, in the list's order."""
    members = lists.select("list", F.posexplode("keys").alias("_pos", "key")).join(routes, "key")
    place = F.row_number().over(Window.partitionBy("list").orderBy("_pos"))
    return members.withColumn("place", place).drop("_pos")


def point_at_fraction(points: DataFrame, fraction: float) -> DataFrame:
    """(line, lon, lat) at a fraction of each line's haversine length. points: line, seq, lon, lat; single points stay."""
    w = Window.partitionBy("line").orderBy("seq")
    every = Window.partitionBy("line")
    step = F.coalesce(roads.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    rows = points.withColumn("_step", step).withColumn("_from", F.struct(F.lag("lon").over(w).alias("lon"), F.lag("lat").over(w).alias("lat"))).withColumn("_nth", F.row_number().over(w))
    rows = rows.withColumn("_km", F.sum("_step").over(w)).withColumn("_goal", F.max("_nth").over(every))
    rows = rows.withColumn("_target", F.max("_km").over(every) * max(0.0, min(1.0, fraction)))
    # the first piece that reaches the target, else the last
    rows = rows.where("_nth > 1 or _goal = 1").withColumn("_pick", F.when((F.col("_km") >= F.col("_target")) | (F.col("_nth") == F.col("_goal")), F.col("_nth")))
    at = rows.groupBy("line").agg(F.min_by(F.struct("_nth", "_from", "lon", "lat", "_km", "_step", "_target"), "_pick").alias("p"))
    share = (F.col("p._target") - (F.col("p._km") - F.col("p._step"))) / F.when(F.col("p._step") == 0, 1.0).otherwise(F.col("p._step"))
    between = lambda c: F.when(F.col("p._nth") == 1, F.col(f"p.{c}")).otherwise(F.col(f"p._from.{c}") + (F.col(f"p.{c}") - F.col(f"p._from.{c}")) * share).alias(c)
    return at.select("line", between("lon"), between("lat"))


def profile_summary(samples: DataFrame) -> DataFrame:
    """(route, low, high, peak, peak_km): range of elevation, and the first place of the greatest curvature.

    samples: route, km, elevation, curvature; nulls are left out.
    """
    peak = F.max_by("km", F.struct("curvature", -F.col("km"))).alias("peak_km")
    return samples.groupBy("route").agg(F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.max("curvature").alias("peak"), peak)


def kind_density(points: DataFrame, queries: DataFrame, kinds: list, radius: float) -> DataFrame:
    """queries with the number of points of the given kinds in the nine cells around each; the grid starts at the points."""
    return spatial.box_count(points.where(F.col("kind").isin(*kinds)), queries, radius, from_points=True)


def bicycle_proximity(edges: DataFrame, cell: float = 40.0) -> DataFrame:
    """edges with `bicycles`: 1 on a signed cycle route, 0.7 beside one. edges: on_route (0/1), x, y, and ends ax, ay, bx, by."""
    routes = edges.where("on_route > 0").select(((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    near = spatial.box_count(routes, edges, cell, from_points=True)
    return near.withColumn("bicycles", F.greatest(F.col("on_route").cast("double"), F.when(F.col("density") > 0, 0.7).otherwise(0.0))).drop("density")


def mirrored_corners(edges: DataFrame, corners: DataFrame) -> DataFrame:
    """Corners of every directed edge from those of its slice's measured direction.

    edges: edge_id, slice_id, rev, length_m; corners: slice_id, rev, s, sign, radius, heading. Against the measured
    direction places count from the other end and turns change sides.
    """
    measured = corners.withColumnRenamed("rev", "_rev")
    both = edges.join(measured, "slice_id")
    same = F.col("rev") == F.col("_rev")
    s = F.when(same, F.col("s")).otherwise(F.col("length_m") - F.col("s"))
    sign = F.when(same, F.col("sign")).otherwise(-F.col("sign"))
    place = F.row_number().over(Window.partitionBy("edge_id").orderBy(s, F.when(same, F.col("s")).otherwise(-F.col("s"))))
    return both.select("edge_id", place.alias("nth"), s.alias("s"), sign.alias("sign"), "radius", "heading")


def mirrored_climb(climb: Column, descent: Column, same: Column) -> tuple[Column, Column]:
    """Climb and descent against the measured direction change places."""
    return F.when(same, climb).otherwise(descent), F.when(same, descent).otherwise(climb)


def nearest_node(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(place, node): the node (node, x, y) next to each of a few places (place, px, py); ties by the lesser node.

    Places are a handful of stated points, so they are broadcast and each node is looked at once for every place.
    """
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    if places.count() > 1000:
        raise ValueError("more than 1000 places: join by grid instead")
    return nodes.join(F.broadcast(places), F.lit(True)).groupBy("place").agg(F.min_by("node", F.struct(d2, "node")).alias("node"))


def sign_reductions(signs: DataFrame) -> DataFrame:
    """One row for each edge with signs: capped counts, the least posted speeds, zones, severity of bends.

    signs: edge_id, kind (bend, series, advisory, limit, builtup), value, zone_entry, camera. A series of bends counts
    as 0.8 and a single one as 0.5; an advisory plate adds 0.2, and 1 is the most. 0 stands for no plate.
    """
    bend = F.col("kind").isin("bend", "series")
    count = lambda c: F.least(F.coalesce(F.sum(c.cast("int")), F.lit(0)), F.lit(255)).cast("int")
    least = lambda kind: F.coalesce(F.min(F.when((F.col("kind") == kind) & (F.col("value") > 0), F.col("value"))), F.lit(0)).cast("int")
    zone = lambda v: F.coalesce(F.bool_or((F.col("kind") == "limit") & F.col("zone_entry") & (F.col("value") == v)), F.lit(False))
    each = signs.groupBy("edge_id").agg(
        count(bend).alias("bend_signs"), count(F.col("camera")).alias("cameras"), least("advisory").alias("advisory"), least("limit").alias("posted"), zone(30).alias("zone30"), zone(60).alias("zone60"),
        F.coalesce(F.bool_or(F.col("kind") == "builtup"), F.lit(False)).alias("builtup"), F.coalesce(F.max(F.when(F.col("kind") == "series", 0.8).when(F.col("kind") == "bend", 0.5)), F.lit(0.0)).alias("_severity"),
    )
    bonus = F.when((F.col("_severity") > 0) & (F.col("advisory") > 0), 0.2).otherwise(0.0)
    return each.withColumn("severity", F.round(F.least(F.col("_severity") + bonus, F.lit(1.0)), 3)).drop("_severity")
