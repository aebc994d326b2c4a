"""Linear referencing: places, directions and nearest positions along polylines, and matches of records to roads by them.

A line is one row: `pieces`, an array of (m0, ax, ay, m1, bx, by) from vertex to vertex with the distance along the line
at both ends, and `length`. So a place or a tangent at any position is an expression on the row, without a join. Lines
that are searched for are dealt to grid cells piece by piece; a piece meets just the cells that it passes within the radius.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import large, segment_distance

#: Where an edge is sampled, the weights of names that differ, are unknown, agree, and their confidence.
SAMPLES = (0.25, 0.5, 0.75)
NAME_WEIGHT = (1.0, 2.0, 3.0)
NAME_CONFIDENCE = (0.15, 0.5, 1.0)
#: Shares of distance, heading, name, reliability and votes in a match's confidence.
CONFIDENCE = {"distance": 0.35, "heading": 0.25, "name": 0.20, "reliability": 0.10, "votes": 0.10}


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value) with value worked out once."""
    return F.transform(F.array(value), function)[0]


def lines_of(vertices: DataFrame, line: str, seq: str = "seq") -> DataFrame:
    """(line, pieces, length) from vertices (line, seq, x, y). Lines of one vertex have no length and are left out."""
    along = Window.partitionBy(line).orderBy(seq)
    bx, by = F.lead("x").over(along), F.lead("y").over(along)
    steps = vertices.select(line, seq, F.col("x").alias("ax"), F.col("y").alias("ay"), bx.alias("bx"), by.alias("by")).where("bx is not null")
    m1 = F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("m1", m1).withColumn("m0", F.coalesce(F.lag("m1").over(along), F.lit(0.0)))
    packed = steps.groupBy(line).agg(F.array_sort(F.collect_list(F.struct("m0", seq, "ax", "ay", "m1", "bx", "by"))).alias("_p"))
    pieces = F.transform("_p", lambda g: F.struct(*[g[c].alias(c) for c in ("m0", "ax", "ay", "m1", "bx", "by")]))
    return packed.select(line, pieces.alias("pieces"), F.element_at("_p", -1)["m1"].alias("length"))


def place(pieces: Column, s: Column) -> Column:
    """The point (x, y) at distance s along the line; beyond the ends, the ends."""

    def on(g: Column) -> Column:
        t = F.when(g["m1"] > g["m0"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - g["m0"]) / (g["m1"] - g["m0"])))).otherwise(0.0)
        return F.struct((g["ax"] + t * (g["bx"] - g["ax"])).alias("x"), (g["ay"] + t * (g["by"] - g["ay"])).alias("y"))

    ahead = F.slice(F.filter(pieces, lambda g: g["m1"] >= s), 1, 1)
    return F.transform(F.concat(ahead, F.slice(pieces, -1, 1)), on)[0]


def tangent(pieces: Column, length: Column, s: Column, delta: float = 5.0) -> Column:
    """The unit vector (x, y) along the line at s, from delta before to delta behind it (half the line, if shorter).

    Where these places coincide the line's ends count; a closed line's vector is (0, 0) then.
    """
    half = F.least(F.lit(delta), F.greatest(length / 2, F.lit(1e-6)))
    inside = lambda v: F.greatest(F.lit(0.0), F.least(length, v))
    ends = F.transform(F.array(inside(s - half), inside(s + half), F.lit(0.0), length), lambda m: place(pieces, m))

    def unit(e: Column) -> Column:
        near = F.struct((e[1]["x"] - e[0]["x"]).alias("x"), (e[1]["y"] - e[0]["y"]).alias("y"))
        whole = F.struct((e[3]["x"] - e[2]["x"]).alias("x"), (e[3]["y"] - e[2]["y"]).alias("y"))
        chosen = F.when(F.hypot(near["x"], near["y"]) < 1e-9, whole).otherwise(near)
        return let(chosen, lambda v: let(F.hypot(v["x"], v["y"]), lambda n: F.struct(*[(v[c] / F.when(n < 1e-9, 1.0).otherwise(n)).alias(c) for c in "xy"])))

    return let(ends, unit)


def bearing(vector: Column) -> Column:
    """Compass bearing in degrees."""
    return F.pmod(F.degrees(F.atan2(vector["x"], vector["y"])), F.lit(360.0))


def piece_cells(ax: Column, ay: Column, bx: Column, by: Column, radius: float, side: float) -> Column:
    """The grid cells that hold the points within the radius of a segment: for each column of cells the rows it passes."""
    lo, hi = F.floor((F.least(ax, bx) - radius) / side), F.floor((F.greatest(ax, bx) + radius) / side)

    def height(x: Column) -> Column:
        inside = F.greatest(F.least(ax, bx), F.least(F.greatest(ax, bx), x))
        return ay + (by - ay) * (inside - ax) / (bx - ax)

    def column(cx: Column) -> Column:
        level = F.abs(bx - ax) > 1e-9
        y0 = F.when(level, height(cx * side - radius)).otherwise(ay)
        y1 = F.when(level, height((cx + 1) * side + radius)).otherwise(by)
        rows = F.sequence(F.floor((F.least(y0, y1) - radius) / side), F.floor((F.greatest(y0, y1) + radius) / side))
        return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(lo, hi), column))


def near_lines(points: DataFrame, point: list[str], lines: DataFrame, line: str, radius: float, side: float | None = None) -> DataFrame:
    """(*point, line, distance, at) for each point (x, y) and each line within the radius; at: the nearest position along it.

    Of equally near positions the first counts.
    """
    side = side or 4.0 * radius
    pieces = lines.select(line, F.posexplode("pieces").alias("_nth", "_g")).select(line, "_nth", "_g.*")
    cells = pieces.withColumn("_cell", F.explode(piece_cells(*(F.col(c) for c in ("ax", "ay", "bx", "by")), radius, side)))
    asked = points.select(*point, "x", "y").withColumn("_at", F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    px, py, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    distance = segment_distance(px, py, ax, ay, bx, by)
    met = asked.join(large(cells), (F.col("_at") == F.col("_cell")) & (distance <= radius))
    long2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / long2))).otherwise(0.0)
    at = F.col("m0") + t * (F.col("m1") - F.col("m0"))
    best = met.groupBy(*point, line).agg(F.min(F.struct(distance.alias("distance"), F.col("_nth"), at.alias("at"))).alias("_b"))
    return best.select(*point, line, "_b.distance", "_b.at")


def edges_of_slices(edges: DataFrame) -> DataFrame:
    """(slice_id, edges): the directed edges of each physical slice, the lowest id first."""
    return edges.groupBy("slice_id").agg(F.array_sort(F.collect_list(F.struct("edge_id", "reversed"))).alias("edges"))


def match_speeds(edges: DataFrame, lines: DataFrame, official: DataFrame, official_lines: DataFrame, radius: float = 25.0, heading_tol: float = 40.0) -> DataFrame:
    """The official speed of each edge that has one: edge_id, speed, row_id, votes, and the parts of the confidence.

    edges: edge_id, slice_id, reversed, name (null: unknown); lines: (slice_id, pieces, length). official: row_id, wvk,
    speed, direction (1 along the line, -1 against it, 0 both), reliability (0 to 1), name; official_lines: (row_id, ...).

    Each edge is sampled at three places. A record counts at a sample if its line is within the radius, runs within
    heading_tol of the edge's heading (either way) and holds for the direction of travel. Records vote for their speed
    by their name; the speed with most votes wins, then the nearest, the lowest wvk, the lowest row_id. Its nearest
    record stands for it. Speeds of 0 and null names are unknown. Only samples and pieces near them are shuffled.
    """
    both = edges.join(large(lines), "slice_id")
    fractions = F.array(*[F.struct(F.lit(i).alias("sample"), F.lit(f).alias("f")) for i, f in enumerate(SAMPLES)])
    asked = both.select("edge_id", "reversed", "name", "pieces", "length", F.explode(fractions).alias("_s"))
    s = F.when(F.col("reversed"), 1 - F.col("_s.f")).otherwise(F.col("_s.f")) * F.col("length")
    asked = asked.select("edge_id", "name", F.col("_s.sample").alias("sample"), place(F.col("pieces"), s).alias("_p"), tangent(F.col("pieces"), F.col("length"), s).alias("_t"), F.when(F.col("reversed"), -1.0).otherwise(1.0).alias("_sign"))
    asked = asked.select("edge_id", "name", "sample", "_p.x", "_p.y", (F.col("_t.x") * F.col("_sign")).alias("_hx"), (F.col("_t.y") * F.col("_sign")).alias("_hy"))
    key = ["edge_id", "name", "sample", "_hx", "_hy"]
    records = official.where("speed > 0").withColumnRenamed("name", "_named")
    near = near_lines(asked, key, official_lines.join(large(records.select("row_id")), "row_id", "left_semi"), "row_id", radius)
    met = near.join(large(records.join(large(official_lines), "row_id")), "row_id").withColumn("_u", tangent(F.col("pieces"), F.col("length"), F.col("at")))
    met = met.withColumn("_cos", F.col("_hx") * F.col("_u.x") + F.col("_hy") * F.col("_u.y"))
    holds = (F.col("direction") == 0) | ((F.col("direction") > 0) == (F.col("_cos") >= 0))
    met = met.where((F.abs("_cos") >= math.cos(math.radians(heading_tol))) & holds)
    unknown = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("_named", F.lit("")) == "")
    state = F.when(unknown, 1).when(F.col("name") == F.col("_named"), 2).otherwise(0)
    pick = lambda values: F.array(*map(F.lit, values))[F.col("_state")]
    met = met.withColumn("_state", state).withColumn("_weight", pick(NAME_WEIGHT)).withColumn("_name_part", pick(NAME_CONFIDENCE))
    head = F.struct("distance", "wvk", "row_id", "sample", F.abs("_cos").alias("cos"), "_name_part", "reliability")
    groups = met.groupBy("edge_id", "speed").agg(F.sum("_weight").alias("votes"), F.min(head).alias("h"))
    order = F.struct((-F.col("votes")).alias("v"), F.col("h.distance").alias("d"), F.col("h.wvk").alias("w"), F.col("h.row_id").alias("r"), "speed", "h")
    won = groups.groupBy("edge_id").agg(F.min(order).alias("b"), F.sum("votes").alias("_all"))
    heading = F.degrees(F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.h.cos")))))
    parts = {
        "distance": 1 - F.least(F.col("b.d"), F.lit(radius)) / radius,
        "heading": 1 - F.least(heading, F.lit(heading_tol)) / heading_tol,
        "name": F.col("b.h._name_part"),
        "reliability": F.col("b.h.reliability"),
        "votes": -F.col("b.v") / F.col("_all"),
    }
    total = sum((value * CONFIDENCE[name] for name, value in parts.items()), F.lit(0.0))
    return won.select("edge_id", "b.speed", F.col("b.r").alias("row_id"), (-F.col("b.v")).alias("votes"), *[v.alias(f"{n}_part") for n, v in parts.items()], total.alias("confidence"))


def match_signs(signs: DataFrame, edges: DataFrame, lines: DataFrame, radius: float = 25.0, dir_tol: float = 60.0) -> DataFrame:
    """(sign_id, edge_id, distance, off): the edge that each sign stands for.

    signs: sign_id, x, y, bearing (null: unknown). A sign goes to the nearest line within the radius (of equally near
    ones, to that of the lowest edge) and there to the direction of travel nearest to its bearing, the lower edge if
    there is no bearing or no difference. A sign that is more than dir_tol off is dropped. off: degrees, null if unknown.
    """
    slices = edges_of_slices(edges).join(large(lines), "slice_id")
    near = near_lines(signs, ["sign_id", "bearing"], lines, "slice_id", radius)
    first = near.join(large(slices.select("slice_id", F.col("edges")[0]["edge_id"].alias("_first"))), "slice_id")
    best = first.groupBy("sign_id").agg(F.min(F.struct("distance", "_first", "slice_id", "at", "bearing")).alias("b")).select("sign_id", "b.*")
    on = best.join(large(slices), "slice_id").withColumn("_along", bearing(tangent(F.col("pieces"), F.col("length"), F.col("at"))))
    off = lambda e: F.abs(F.pmod(F.col("bearing") - F.col("_along") - F.when(e["reversed"], 180.0).otherwise(0.0) + 180, F.lit(360.0)) - 180)
    choice = F.array_min(F.transform(F.slice("edges", 1, 2), lambda e: F.struct(F.coalesce(off(e), F.lit(0.0)).alias("off"), e["edge_id"].alias("edge_id"))))
    chosen = on.withColumn("_c", choice).where(F.col("bearing").isNull() | (F.col("_c.off") <= dir_tol))
    return chosen.select("sign_id", "_c.edge_id", "distance", F.when(F.col("bearing").isNotNull(), F.col("_c.off")).alias("off"))
