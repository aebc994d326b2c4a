"""Stops for navigation along drawn lines, refined for all routes together: each round measures all pieces and adds or moves one stop of every route.

A piece lies between two stops. Its deviation is the farthest that the line between them strays from their chord, its
gap their distance along the line. Stops and the line's vertices meet by route and position; a round is one join and one
aggregate, so rounds are as many as the stops that a link may have, and not as many as routes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roads
from ..storage import passing, written
from .linear import place

#: Most stops of a link and of its text, what a piece may stray and span, and how far before a bend a stop lies.
MOST_STOPS, MOST_TEXT = 9, 2048
DEVIATION_KM, GAP_KM, APPROACH_KM, PROBE_KM = 0.1, 5.0, 0.5, 0.1


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}lon") == F.col(f"{b}lon")) & (F.col(f"{a}lat") == F.col(f"{b}lat"))


def _lines(points: DataFrame, loop: bool) -> tuple[DataFrame, DataFrame]:
    """(vertices, lines): route, i, km, lon, lat, last without doubled vertices, and route, pieces by km, total."""
    along = Window.partitionBy("route").orderBy("seq")
    fresh = F.lag("lon").over(along).isNull() | (F.lag("lon").over(along) != F.col("lon")) | (F.lag("lat").over(along) != F.col("lat"))
    bad = F.isnan("lon") | F.isnan("lat") | (F.abs("lon") > 180) | (F.abs("lat") > 90)
    rows = points.where("lon is not null and lat is not null").withColumn("lon", F.when(~bad, F.col("lon")).otherwise(F.raise_error(F.lit("a place that is not on the map")).cast("double")))
    rows = rows.select("route", "seq", "lon", "lat", fresh.alias("_new")).where("_new").drop("_new")
    if loop:
        ends = rows.groupBy("route").agg(F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"), (F.max("seq") + 1).alias("seq"))
        rows = rows.unionByName(ends.where("a <> b").select("route", "seq", "a.lon", "a.lat"))
    step = F.coalesce(roads.haversine_km(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")), F.lit(0.0))
    placed = rows.withColumn("_d", step).withColumn("km", F.sum("_d").over(along)).withColumn("i", F.row_number().over(along) - 1)
    placed = placed.withColumn("last", F.max("i").over(Window.partitionBy("route"))).where("last >= 1").drop("_d", "seq")
    vertices = written(placed, "vertices")
    by = Window.partitionBy("route").orderBy("i")
    pieces = vertices.select("route", "i", F.col("km").alias("m0"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("km").over(by).alias("m1"), F.lead("lon").over(by).alias("bx"), F.lead("lat").over(by).alias("by")).where("m1 is not null")
    packed = pieces.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("m0", "i", "ax", "ay", "m1", "bx", "by"))).alias("_p"), F.max("m1").alias("total"))
    lines = packed.select("route", F.transform("_p", lambda g: F.struct(*[g[c].alias(c) for c in ("m0", "ax", "ay", "m1", "bx", "by")])).alias("pieces"), "total")
    return vertices, written(lines, "lines")


def _measured(pieces: DataFrame, vertices: DataFrame, keys: list[str], low: str = "a_km", high: str = "b_km") -> DataFrame:
    """pieces (*keys, a_km, a_lon, a_lat, b_...) with dev, and v_km, v_lon, v_lat of the vertex that strays most (the first), if any strays."""
    inner = vertices.where("i > 0 and i < last").select(F.col("route").alias("_r"), "i", "km", "lon", "lat")
    met = pieces.join(inner, (F.col("route") == F.col("_r")) & (F.col("km") > F.col(low)) & (F.col("km") < F.col(high)))
    dev = roads.chord_deviation_km(*(F.col(c) for c in ("lon", "lat", "a_lon", "a_lat", "b_lon", "b_lat")))
    worst = met.withColumn("_dev", dev).where("_dev > 0").groupBy(*keys).agg(F.max_by(F.struct(F.col("_dev").alias("dev"), F.col("km").alias("v_km"), F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat")), F.struct("_dev", -F.col("i"))).alias("_w"))
    return pieces.join(worst, keys, "left").select(*pieces.columns, F.coalesce("_w.dev", F.lit(0.0)).alias("dev"), "_w.v_km", "_w.v_lon", "_w.v_lat")


def _pieces(stops: DataFrame) -> DataFrame:
    """Neighbouring stops of each route (route, km, lon, lat)."""
    along = Window.partitionBy("route").orderBy("km")
    nexts = [F.lead(c).over(along).alias(f"b_{c}") for c in ("km", "lon", "lat")]
    return stops.select("route", *[F.col(c).alias(f"a_{c}") for c in ("km", "lon", "lat")], *nexts).where("b_km is not null")


def _refined(stops: DataFrame, vertices: DataFrame, lines: DataFrame, budget: int) -> DataFrame:
    """Stops added where a piece strays or spans most, until none is over its bound or the budget is spent."""
    for _ in range(budget):
        each = _measured(_pieces(stops), vertices, ["route", "a_km"]).withColumn("_gap", (F.col("b_km") - F.col("a_km")) / GAP_KM).withColumn("_off", F.col("dev") / DEVIATION_KM)
        one = _same("a_", "b_")
        each = each.withColumn("_score", F.when(one & (F.col("dev") > 0), float("inf")).otherwise(F.greatest("_off", "_gap"))).where("_score > 1").join(lines.select("route", "pieces"), "route")
        at_vertex = (F.col("dev") > 0) & (one | (F.col("_off") >= F.col("_gap")))
        middle = (F.col("a_km") + F.col("b_km")) / 2
        half = place(F.col("pieces"), middle)
        pick = lambda v, other: F.when(at_vertex, F.col(v)).otherwise(other)
        each = each.select("route", "a_km", "a_lon", "a_lat", "b_lon", "b_lat", "_score", pick("v_km", middle).alias("n_km"), pick("v_lon", half["x"]).alias("n_lon"), pick("v_lat", half["y"]).alias("n_lat"))
        each = each.where(~_same("n_", "a_") & ~_same("n_", "b_"))
        best = each.groupBy("route").agg(F.min(F.struct((-F.col("_score")).alias("s"), "a_km", "n_km", "n_lon", "n_lat")).alias("b"))
        best = written(best.select("route", F.col("b.n_km").alias("km"), F.col("b.n_lon").alias("lon"), F.col("b.n_lat").alias("lat")), "added")
        if best.isEmpty():
            break
        stops = written(stops.unionByName(best), "stops")
    return stops


def _spread(stops: DataFrame, vertices: DataFrame, lines: DataFrame, budget: int) -> DataFrame:
    """Routes that the budget does not do justice to: evenly spaced stops, each moved to the bend in its span that serves best, from both ends inward."""
    ends = stops.join(lines.select("route", "total"), "route")
    shape = written(ends.where("km > 0 and km < total").select("route", "km", "lon", "lat"), "shape")
    step = F.col("total") / (budget + 1)
    inner = lines.withColumn("idx", F.explode(F.sequence(F.lit(1), F.lit(budget)))).withColumn("km", F.col("idx") * step).withColumn("_p", place(F.col("pieces"), F.col("km")))
    outer = ends.where("km = 0 or km = total").select("route", F.when(F.col("km") == 0, 0).otherwise(budget + 1).alias("idx"), "km", "lon", "lat")
    state = written(inner.select("route", "idx", "km", F.col("_p.x").alias("lon"), F.col("_p.y").alias("lat")).unionByName(outer), "spread")
    for j in range(budget):
        i = budget - j // 2 if j % 2 else 1 + j // 2
        at = lambda n, name: state.where(F.col("idx") == n).select("route", *[F.col(c).alias(f"{name}{c}") for c in ("km", "lon", "lat")])
        span = at(i - 1, "a_").join(at(i + 1, "b_"), "route").join(lines.select("route", ((i - 0.5) * step).alias("_lo"), ((i + 0.5) * step).alias("_hi")), "route")
        bend = _measured(span, vertices, ["route"], "_lo", "_hi")
        given = at(i, "c_").withColumn("_nth", F.lit(0))
        near = shape.join(span.select("route", "_lo", "_hi"), "route").where("km >= _lo and km <= _hi")
        near = near.select("route", *[F.col(c).alias(f"c_{c}") for c in ("km", "lon", "lat")], F.row_number().over(Window.partitionBy("route").orderBy("km")).alias("_nth"))
        strayed = bend.where("v_km is not null").select("route", *[F.col(f"v_{c}").alias(f"c_{c}") for c in ("km", "lon", "lat")], F.lit(1 << 20).alias("_nth"))
        tried = given.unionByName(near).unionByName(strayed).join(span, "route").where(~_same("c_", "a_") & ~_same("c_", "b_"))
        tried = written(tried, "tried")
        side = lambda a, b: tried.select("route", "_nth", *[F.col(f"{a}{c}").alias(f"a_{c}") for c in ("km", "lon", "lat")], *[F.col(f"{b}{c}").alias(f"b_{c}") for c in ("km", "lon", "lat")])
        both = _measured(side("a_", "c_"), vertices, ["route", "_nth"]).unionByName(_measured(side("c_", "b_"), vertices, ["route", "_nth"]))
        score = both.groupBy("route", "_nth").agg(F.max("dev").alias("_dev")).join(tried, ["route", "_nth"])
        best = score.groupBy("route").agg(F.min(F.struct("_dev", "_nth", "c_km", "c_lon", "c_lat")).alias("b"))
        moved = best.select("route", F.lit(i).alias("idx"), F.col("b.c_km").alias("km"), F.col("b.c_lon").alias("lon"), F.col("b.c_lat").alias("lat"))
        state = written(state.join(moved.select("route", "idx"), ["route", "idx"], "left_anti").unionByName(moved), "spread")
    return state


def _approached(stops: DataFrame, lines: DataFrame) -> DataFrame:
    """Stops (route, idx, km, lon, lat) at a bend of 45 degrees or more are put on the way to it."""
    along = Window.partitionBy("route").orderBy("idx")
    both = stops.withColumns({"_before": F.lag("km").over(along), "_after": F.lead("km").over(along), "a_lon": F.lag("lon").over(along), "a_lat": F.lag("lat").over(along)}).join(lines, "route")
    probe = F.least(F.lit(PROBE_KM), (F.col("km") - F.col("_before")) / 4, (F.col("_after") - F.col("km")) / 4)
    both = both.withColumn("_a", place(F.col("pieces"), F.col("km") - probe)).withColumn("_b", place(F.col("pieces"), F.col("km") + probe))
    scale = F.cos(F.radians("lat"))
    x1, y1, x2, y2 = (F.col("lon") - F.col("_a.x")) * scale, F.col("lat") - F.col("_a.y"), (F.col("_b.x") - F.col("lon")) * scale, F.col("_b.y") - F.col("lat")
    size = F.hypot(x1, y1) * F.hypot(x2, y2)
    bend = F.col("_before").isNotNull() & F.col("_after").isNotNull() & (size > 0) & ((x1 * x2 + y1 * y2) / size < math.sqrt(0.5))
    back = F.col("km") - F.least(F.lit(APPROACH_KM), (F.col("km") - F.col("_before")) / 4)
    both = both.withColumn("_q", place(F.col("pieces"), back))
    moves = bend & ~((F.col("_q.x") == F.col("a_lon")) & (F.col("_q.y") == F.col("a_lat")))
    return both.select("route", F.when(moves, back).otherwise(F.col("km")).alias("km"), F.when(moves, F.col("_q.x")).otherwise(F.col("lon")).alias("lon"), F.when(moves, F.col("_q.y")).otherwise(F.col("lat")).alias("lat"))


def navigation(points: DataFrame, loop: bool, budget: int = MOST_STOPS) -> DataFrame:
    """(route, stops, href, limited, max_gap_km, max_deviation_km) of routes (route, seq, lon, lat) with two places or more.

    stops: km, lon, lat in order, the ends among them, at most `budget` between. limited: a piece still strays or spans
    more than it should. A loop is closed. Places off the map and links that are too long raise an error; missing places are left out.
    """
    if not 1 <= budget <= MOST_STOPS:
        raise ValueError(f"a link has 1 to {MOST_STOPS} stops")
    with passing(points.sparkSession):
        vertices, lines = _lines(points, loop)
        ends = vertices.where("i = 0 or i = last").select("route", "km", "lon", "lat")
        stops = _refined(written(ends, "stops"), vertices, lines, budget)
        over = (F.col("dev") > DEVIATION_KM + 1e-9) | (F.col("b_km") - F.col("a_km") > GAP_KM + 1e-9)
        short = written(_measured(_pieces(stops), vertices, ["route", "a_km"]).where(over).select("route").distinct(), "short")
        spread = _spread(stops.join(short, "route", "left_semi"), vertices, lines.join(short, "route", "left_semi"), budget)
        placed = written(stops.join(short, "route", "left_anti").select("route", "km", "lon", "lat").unionByName(_approached(spread, lines)), "placed")
        gaps = _measured(_pieces(placed), vertices, ["route", "a_km"]).groupBy("route").agg(F.max(F.col("b_km") - F.col("a_km")).alias("max_gap_km"), F.max("dev").alias("max_deviation_km"))
        named = placed.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("km", "lon", "lat"))).alias("stops")).join(gaps, "route")
        text = lambda p: F.concat(p["lat"].cast("string"), F.lit(","), p["lon"].cast("string"))
        between = F.transform(F.slice("stops", 2, F.size("stops") - 2), text)
        ways = F.when(F.size("stops") > 2, F.concat(F.lit("&waypoints="), F.url_encode(F.array_join(between, "|")))).otherwise("")
        href = F.concat(F.lit("https://www.google.com/maps/dir/?api=1&origin="), F.url_encode(text(F.element_at("stops", 1))), F.lit("&destination="), F.url_encode(text(F.element_at("stops", -1))), F.lit("&travelmode=driving"), ways)
        fits = F.when(F.length(href) <= MOST_TEXT, href).otherwise(F.raise_error(F.lit("a link that is too long")).cast("string"))
        limited = (F.col("max_gap_km") > GAP_KM + 1e-9) | (F.col("max_deviation_km") > DEVIATION_KM + 1e-9)
        return written(named.select("route", "stops", fits.alias("href"), limited.alias("limited"), "max_gap_km", "max_deviation_km"), "navigation", kept=True)
