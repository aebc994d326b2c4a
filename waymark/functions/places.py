"""What a node, a closed way or an area stands for on the map, by its tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .roads import boxes_meet

# Kinds of points and their codes.
BUMP, CONTROL, CROSSING, COFFEE, FUEL, VIEW, PLACE, CAMERA = range(1, 9)
# The tags' values behind the kinds of points.
CALMING = ("speed_bump", "hump", "table", "cushion", "chicane", "choker", "dip", "rumble_strip")
CONTROLS = ("traffic_signals", "stop", "give_way", "mini_roundabout")
COFFEE_STOPS = ("cafe", "restaurant", "fast_food", "ice_cream", "bakery", "pub", "biergarten")
VIEWS = ("attraction", "viewpoint", "picnic_site", "museum")
SETTLEMENTS = ("city", "town", "village", "hamlet", "suburb", "borough")
# Kinds of scenery (1 woods, 2 heath and sand, 3 water, 4 parks and reserves, 5 other green) by tag.
SCENERY = {
    "natural": {"wood": 1, "scrub": 1, "grassland": 1, "heath": 2, "moor": 2, "sand": 2, "dune": 2, "beach": 2, "water": 3, "bay": 3, "wetland": 3},
    "landuse": {"forest": 1, "orchard": 1, "vineyard": 1, "meadow": 5, "village_green": 5, "recreation_ground": 5},
    "leisure": {"nature_reserve": 4, "park": 4},
    "water": {"river": 3, "lake": 3, "reservoir": 3, "canal": 3},
}
#: Rings that are smaller than this both ways cannot change a road's share of scenery.
LEAST_SPAN_M = 60.0


def _in(tags: Column, key: str, values: tuple) -> Column:
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def point_kind(tags: Column) -> Column:
    """kind and name of a node; kind is null where it is none of these. The first kind that fits counts."""
    calm = _in(tags, "highway", CALMING) | (F.coalesce(tags["traffic_calming"], F.lit("no")) != "no")
    camera = _in(tags, "highway", ("speed_camera",)) | _in(tags, "enforcement", ("maxspeed",))
    view = _in(tags, "tourism", VIEWS) | _in(tags, "natural", ("peak",))
    name = F.nullif(tags["name"], F.lit(""))
    named = _in(tags, "place", SETTLEMENTS) & name.isNotNull()
    coffee = _in(tags, "amenity", COFFEE_STOPS)
    kinds = [(calm, BUMP), (_in(tags, "highway", CONTROLS), CONTROL), (camera, CAMERA), (_in(tags, "railway", ("level_crossing",)), CROSSING), (coffee, COFFEE), (_in(tags, "amenity", ("fuel",)), FUEL), (view, VIEW), (named, PLACE)]
    kind = F.coalesce(*[F.when(fits, F.lit(code)) for fits, code in kinds])
    shown = F.when(kind == COFFEE, F.coalesce(name, tags["amenity"])).when(kind == VIEW, F.coalesce(name, tags["tourism"])).otherwise(name)
    return F.struct(kind.alias("kind"), shown.alias("name"))


def scenic_kind(tags: Column) -> Column:
    """Kind of scenery of an area, by the first of its tags that names one; null for none."""
    water = F.coalesce(F.nullif(tags["water"], F.lit("")), tags["waterway"])
    of = {"natural": tags["natural"], "landuse": tags["landuse"], "leisure": tags["leisure"], "water": water}
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(*[F.try_element_at(table(values), of[key]) for key, values in SCENERY.items()])


def area_point(tags: Column) -> Column:
    """kind and name of an area that is a place to stop and no scenery; kind is null for others."""
    coffee, view = _in(tags, "amenity", COFFEE_STOPS), _in(tags, "tourism", VIEWS)
    kind = F.when(scenic_kind(tags).isNull(), F.when(coffee, COFFEE).when(view, VIEW))
    return F.struct(kind.alias("kind"), F.coalesce(F.nullif(tags["name"], F.lit("")), tags["amenity"], tags["tourism"]).alias("name"))


def centre(xy: Column) -> Column:
    """The mean of the vertices (x, y); null for fewer than three."""
    mean = lambda c: F.aggregate(xy, F.lit(0.0), lambda s, p: s + p[c]) / F.size(xy)
    return F.when(F.size(xy) >= 3, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def scenic_rings(ways: DataFrame, view: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(way, kind, xy): closed ways of four nodes or more that are scenery and span LEAST_SPAN_M one way at least.

    ways: way, tags, refs, xy (in metres). With a view (west, south, east, north) rings that do not meet it are left out.
    """
    closed = ways.withColumn("kind", scenic_kind(F.col("tags"))).where(F.col("kind").isNotNull() & (F.size("refs") >= 4) & (F.size("xy") >= 4) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1)))
    end = lambda f, c: f(F.transform("xy", lambda p: p[c]))
    boxed = closed.withColumns({"_w": end(F.array_min, "x"), "_s": end(F.array_min, "y"), "_e": end(F.array_max, "x"), "_n": end(F.array_max, "y")})
    large = boxed.where((F.col("_e") - F.col("_w") >= LEAST_SPAN_M) | (F.col("_n") - F.col("_s") >= LEAST_SPAN_M))
    if view is not None:
        large = large.where(boxes_meet(tuple(F.col(c) for c in ("_w", "_s", "_e", "_n")), tuple(map(F.lit, view))))
    return large.select("way", "kind", "xy")
