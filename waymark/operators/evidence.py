"""Lines beside lines and points beside areas: how much of a road runs within a record's reach, and which roads lie in scenery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import let, near_lines, piece_cells
from .spatial import inside_rings, large, segment_distance

INF = float("inf")


def locate(pieces: Column, x: Column, y: Column) -> Column:
    """The position along the line that is nearest to a point; of equally near ones the first."""

    def seen(g: Column, i: Column) -> Column:
        dx, dy = g["bx"] - g["ax"], g["by"] - g["ay"]
        long2 = dx * dx + dy * dy
        t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - g["ax"]) * dx + (y - g["ay"]) * dy) / long2))).otherwise(0.0)
        return F.struct(segment_distance(x, y, g["ax"], g["ay"], g["bx"], g["by"]).alias("d"), i.alias("i"), (g["m0"] + t * (g["m1"] - g["m0"])).alias("at"))

    return F.array_min(F.transform(pieces, seen))["at"]


def span_within(radius: float) -> Column:
    """(t0, t1), empty if t0 > t1: the part of the segment a -> b, as shares, that is within the radius of the segment c -> d.

    The places around a segment are a rectangle and two discs. Together they are convex, so the part is one span: from
    the first entry into any of the three to the last exit. Columns: ax, ay, bx, by, cx, cy, dx, dy; both have a length.
    """
    ax, ay, bx, by, cx, cy, dx, dy = (F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"))
    long_ = F.hypot(dx - cx, dy - cy)
    along = lambda px, py: (px * (dx - cx) + py * (dy - cy)) / long_
    across = lambda px, py: (px * (dy - cy) - py * (dx - cx)) / long_
    at = F.struct(
        along(ax - cx, ay - cy).alias("u"), along(bx - ax, by - ay).alias("du"), across(ax - cx, ay - cy).alias("w"), across(bx - ax, by - ay).alias("dw"), long_.alias("l"),
    )

    def between(v: Column, dv: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        flat = F.abs(dv) < 1e-12
        fits = (v >= lo) & (v <= hi)
        first, last = F.least((lo - v) / dv, (hi - v) / dv), F.greatest((lo - v) / dv, (hi - v) / dv)
        return F.when(flat, F.when(fits, -INF).otherwise(INF)).otherwise(first), F.when(flat, F.when(fits, INF).otherwise(-INF)).otherwise(last)

    def disc(e: Column, u: Column) -> tuple[Column, Column]:
        a, half, c = e["du"] * e["du"] + e["dw"] * e["dw"], u * e["du"] + e["w"] * e["dw"], u * u + e["w"] * e["w"] - radius * radius
        root = F.sqrt(F.greatest(F.lit(0.0), half * half - a * c))
        meets = half * half >= a * c
        return F.when(meets, (-half - root) / a).otherwise(INF), F.when(meets, (-half + root) / a).otherwise(-INF)

    def inside(pair: tuple[Column, Column]) -> tuple[Column, Column]:
        first, last = F.greatest(F.lit(0.0), pair[0]), F.least(F.lit(1.0), pair[1])
        return F.when(first <= last, first).otherwise(INF), F.when(first <= last, last).otherwise(-INF)

    def span(e: Column) -> Column:
        beside, level = between(e["u"], e["du"], F.lit(0.0), e["l"]), between(e["w"], e["dw"], F.lit(-radius), F.lit(radius))
        parts = [inside((F.greatest(beside[0], level[0]), F.least(beside[1], level[1]))), inside(disc(e, e["u"])), inside(disc(e, e["u"] - e["l"]))]
        return F.struct(F.least(*[p[0] for p in parts]).alias("t0"), F.greatest(*[p[1] for p in parts]).alias("t1"))

    return let(at, span)


def covered_length(lines: DataFrame, line: str, others: DataFrame, other: str, radius: float) -> DataFrame:
    """(line, other, covered): the length of each line that runs within the radius of each other line near it.

    Spans of pieces are put together along the line, and what they share counts once. Both: (key, pieces, length).
    """
    side = 4.0 * radius
    piece = lambda df, key: df.select(key, F.explode("pieces").alias("_g")).select(key, "_g.*").where("m1 > m0")
    box = lambda a, b: F.sequence(F.floor(F.least(a, b) / side), F.floor(F.greatest(a, b) / side))
    # a span of a piece is found in each cell that the piece's box meets; equal spans are one by the union
    mine = piece(lines, line).withColumn("_cx", F.explode(box(F.col("ax"), F.col("bx")))).withColumn("_cy", F.explode(box(F.col("ay"), F.col("by"))))
    theirs = piece(others, other).select(other, *[F.col(a).alias(b) for a, b in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"), strict=True)])
    theirs = theirs.withColumn("_c", F.explode(piece_cells(*(F.col(c) for c in ("cx", "cy", "dx", "dy")), radius, side)))
    met = mine.join(large(theirs), (F.col("_cx") == F.col("_c.cx")) & (F.col("_cy") == F.col("_c.cy"))).withColumn("_s", span_within(radius)).where("_s.t0 <= _s.t1")
    length = F.col("m1") - F.col("m0")
    spans = met.select(line, other, (F.col("m0") + F.col("_s.t0") * length).alias("a"), (F.col("m0") + F.col("_s.t1") * length).alias("b")).distinct()
    before = Window.partitionBy(line, other).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(-INF))))
    return spans.withColumn("_new", fresh).groupBy(line, other).agg(F.sum("_new").alias("covered"))


def register_evidence(lines: DataFrame, register: DataFrame, radius: float = 12.0, least_span: float = 0.95, least_covered: float = 0.90) -> DataFrame:
    """(line_id, oid, value, distance) of the lines that the register speaks of without doubt.

    lines: line_id, refs (road numbers, may be empty), pieces, length; register: oid, road, value (an array; null: nothing
    is known), pieces, length. A record counts for a line if it has one of the line's numbers (any, if the line has none),
    nine tenths of the line run within the radius of it, and the line's ends are far enough apart along it. If the line
    runs against the record its value is turned round. All records that count must agree, and be of one road if the line
    has no number. The nearest stands for them (of equally near ones the least oid).
    """
    near = covered_length(lines.select("line_id", "pieces"), "line_id", register.where("value is not null").select("oid", "pieces"), "oid", radius)
    record = register.select("oid", "road", "value", F.col("pieces").alias("_record"))
    pairs = near.join(large(lines), "line_id").where(F.col("covered") >= least_covered * F.col("length")).join(large(record), "oid")
    pairs = pairs.where((F.size("refs") == 0) | F.array_contains("refs", F.col("road")))
    first, last = F.col("pieces")[0], F.element_at("pieces", -1)
    pairs = pairs.withColumn("_a", locate(F.col("_record"), first["ax"], first["ay"])).withColumn("_b", locate(F.col("_record"), last["bx"], last["by"]))
    pairs = pairs.where(F.abs(F.col("_b") - F.col("_a")) >= least_span * F.col("length"))
    apart = pairs.select("line_id", "oid", "road", "refs", F.when(F.col("_b") < F.col("_a"), F.reverse("value")).otherwise(F.col("value")).alias("value"), line_distance("pieces", "_record").alias("distance"))
    found = apart.groupBy("line_id").agg(
        F.min(F.struct("distance", "oid", "value")).alias("b"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min("road").alias("_r0"), F.max("road").alias("_r1"), F.max(F.size("refs")).alias("_n"),
    )
    return found.where("_lo = _hi and (_n > 0 or _r0 = _r1)").select("line_id", "b.oid", "b.value", "b.distance")


def line_distance(pieces: str, others: str) -> Column:
    """The least distance of two lines on one row: 0 where pieces cross, else from an end of a piece to the other line."""

    def crossing(g: Column, h: Column) -> Column:
        side = lambda p, x, y: (p["bx"] - p["ax"]) * (y - p["ay"]) - (p["by"] - p["ay"]) * (x - p["ax"])
        apart = lambda p, q: side(p, q["ax"], q["ay"]) * side(p, q["bx"], q["by"]) < 0
        return apart(g, h) & apart(h, g)

    def least(g: Column, h: Column) -> Column:
        to = lambda p, x, y: segment_distance(x, y, p["ax"], p["ay"], p["bx"], p["by"])
        ends = F.least(to(g, h["ax"], h["ay"]), to(g, h["bx"], h["by"]), to(h, g["ax"], g["ay"]), to(h, g["bx"], g["by"]))
        return F.when(crossing(g, h), 0.0).otherwise(ends)

    return F.array_min(F.transform(pieces, lambda g: F.array_min(F.transform(others, lambda h: least(g, h)))))


def near_areas(points: DataFrame, point: str, rings: DataFrame, radius: float) -> DataFrame:
    """(point, area, distance): the areas within the radius of each point (x, y); 0 inside.

    rings: area, ring, pieces (closed). An area may have parts and holes: a point is inside if a ray crosses its rings an
    odd number of times.
    """
    edges = rings.select("area", F.explode("pieces").alias("_g")).select("area", "_g.ax", "_g.ay", "_g.bx", "_g.by")
    inside = inside_rings(points.select(point, "x", "y"), edges, point, "area").withColumn("distance", F.lit(0.0))
    named = rings.select(F.struct("area", "ring").alias("_line"), "pieces")
    beside = near_lines(points, [point], named, "_line", radius).select(point, "_line.area", "distance")
    return inside.select(point, "area", "distance").unionByName(beside).groupBy(point, "area").agg(F.min("distance").alias("distance"))


def scenery_share(edges: DataFrame, rings: DataFrame, buffer: float = 40.0, least_area: float = 10_000.0) -> DataFrame:
    """(edge_id, share): how many of an edge's three probes lie in or beside scenery.

    edges: edge_id, vertices (array of x, y); the probes are the vertices a quarter, half and three quarters along the
    array. Areas whose outer box is under least_area are too small to count. Edges without a probe in scenery have 0.
    """
    box = F.struct(*[f(F.expr(f"aggregate(pieces, double(pieces[0].{a}), (s, g) -> {g}(s, g.{a}))")).alias(f"{g}_{a}") for f, g, a in ((F.min, "least", "ax"), (F.max, "greatest", "ax"), (F.min, "least", "ay"), (F.max, "greatest", "ay"))])
    boxes = rings.groupBy("area").agg(box.alias("b")).where((F.col("b.greatest_ax") - F.col("b.least_ax")) * (F.col("b.greatest_ay") - F.col("b.least_ay")) >= least_area)
    wide = rings.where(F.size("pieces") >= 3).join(large(boxes.select("area")), "area", "left_semi")
    probes = edges.select("edge_id", "vertices", F.explode(F.array(*[F.lit(f) for f in (0.25, 0.5, 0.75)])).alias("_f"))
    probes = probes.withColumn("_v", F.get("vertices", F.floor((F.size("vertices") - 1) * F.col("_f")).cast("int"))).select(F.struct("edge_id", "_f").alias("_probe"), "_v.x", "_v.y")
    hit = near_areas(probes, "_probe", wide, buffer).select("_probe").distinct().groupBy(F.col("_probe.edge_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("_n"))
    return edges.select("edge_id").join(large(hit), "edge_id", "left").select("edge_id", (F.coalesce("_n", F.lit(0)) / 3.0).alias("share"))
