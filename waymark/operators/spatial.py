"""Spatial joins and densities on a grid: equi-joins on cells, with the exact predicate as a residual condition.

The side with the larger cells' worth of rows keeps one cell; the other is dealt to the 3x3 cells around its own, which
hold everything within one cell's width. Shuffles hash the cell, and AQE splits cells that are too full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Parts of a grid cell by its left rows.
PARTS = 4


def large(df: DataFrame) -> DataFrame:
    """df, to be shuffled where it is joined.

    What Spark guesses of rows that come from explode or hold arrays is far under their size, as it is for a narrow part
    of a file that packs well: it would broadcast what has no bound.
    """
    return df.hint("merge")


#: Rows of a few numbers that one task sorts and groups: some 400 bytes for each.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as its rows ask for; where the session's number is enough, left to Spark."""
    tasks = -(-rows // TASK_ROWS)
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def cell(x: Column, y: Column, side: float) -> Column:
    return F.struct(F.floor(x / side).alias("cx"), F.floor(y / side).alias("cy"))


def around(x: Column, y: Column, side: float, reach: int = 1) -> Column:
    """The cells around a place."""
    near = F.sequence(F.lit(-reach), F.lit(reach))
    cx, cy = F.floor(x / side), F.floor(y / side)
    return F.flatten(F.transform(near, lambda dx: F.transform(near, lambda dy: F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")))))


def within(left: DataFrame, right: DataFrame, radius: float, how: str = "inner", same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows at most radius apart, with `distance`; both sides have x and y, and right's are renamed rx, ry.

    `same` names a column of each side that must be equal too, as part of the equi-join.
    """
    # pairs are many more than rows: a full cell is dealt to PARTS tasks by the left rows, and so many tasks are not merged;
    # groups that must be equal are parts of their own
    parts = 1 if same else PARTS
    tasks = 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.withColumn("_part", F.pmod(F.hash("x", "y"), F.lit(parts))).withColumn("_cell", F.explode(around(F.col("x"), F.col("y"), radius)))
    b = right.withColumnsRenamed({"x": "rx", "y": "ry"}).withColumn("_part2", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    b = b.withColumn("_cell2", cell(F.col("rx"), F.col("ry"), radius))
    if not same:
        a, b = a.repartition(tasks, "_cell", "_part"), b.repartition(tasks, "_cell2", "_part2")
    distance = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    condition = (F.col("_cell") == F.col("_cell2")) & (F.col("_part") == F.col("_part2")) & (distance <= radius)
    if same:
        condition = condition & (F.col(same[0]) == F.col(same[1]))
    if how == "left_semi":
        return a.join(large(b), condition, "left_semi").drop("_cell", "_part").distinct()
    return a.join(large(b), condition).withColumn("distance", distance).drop("_cell", "_cell2", "_part", "_part2")


def nearest(left: DataFrame, right: DataFrame, radius: float, key: str, tie: str) -> DataFrame:
    """For each left row its nearest right row within the radius; of equally near ones the least `tie`.

    Places are looked at once, however many rows lie there. A round finds the nearest within a radius of its own; what it
    finds is final, and the places without any go on with twice the radius. The first radius holds about four places, so
    pairs grow with the rows and not with their square.
    """
    columns = [c for c in right.columns if c not in ("x", "y")]
    heads = written(right.where("x is not null and y is not null").groupBy("x", "y").agg(F.min_by(F.struct(*columns), tie).alias("_row")), "places")
    n, *box = heads.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    reach = math.sqrt(4 * (box[1] - box[0] or 1.0) * (box[3] - box[2] or 1.0) / (math.pi * n)) if n else radius
    reach = radius if not reach < radius else max(reach, radius / 1024)
    open_, found = left.where("x is not null and y is not null").select("x", "y").distinct(), None
    while True:
        best = within(open_, heads, reach).groupBy("x", "y").agg(F.min(F.struct("distance", F.col(f"_row.{tie}").alias("_tie"), "rx", "ry", "_row")).alias("_b"))
        best = written(best, "nearest")
        found = best if found is None else found.unionByName(best)
        if reach >= radius:
            break
        open_ = written(open_.join(large(best), ["x", "y"], "left_anti"), "open")
        reach = min(2 * reach, radius)
    got = left.join(large(found), ["x", "y"]).select(*[left[c] for c in left.columns], *[F.col(f"_b.{c}") for c in ("rx", "ry")], *[F.col(f"_b._row.{c}") for c in columns], "_b.distance")
    w = Window.partitionBy(key).orderBy("distance", tie)
    return got.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def box_count(points: DataFrame, queries: DataFrame, side: float, weight: str | None = None, reach: int = 1, from_points: bool = False) -> DataFrame:
    """queries with `density`: the points' weights in the (2 reach + 1)^2 cells around. Cells are summed first.

    With from_points the grid starts one cell before the points' least coordinates, and a query beyond the grid counts
    as if it were in the grid's outermost cell, two cells behind the points.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    at = cell(F.col("x"), F.col("y"), side)
    if from_points:
        ends = [f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"]
        edge = F.broadcast(points.agg(*ends))  # one row
        points, queries = points.join(edge), queries.join(edge)
        number = lambda c: F.floor((F.col(c) - (F.col(f"_min_{c}") - side)) / side)
        last = lambda c: F.floor((F.col(f"_max_{c}") - (F.col(f"_min_{c}") - side)) / side) + 2
        at = F.struct(*[F.greatest(F.lit(0), F.least(number(c), last(c))).alias(f"c{c}") for c in "xy"])
    cells = points.groupBy(at.alias("_cell")).agg(amount.alias("_w"))
    queries = queries.withColumn("_at", at).drop("_min_x", "_min_y", "_max_x", "_max_y")
    # each distinct cell that is asked for is summed once
    near = F.sequence(F.lit(-reach), F.lit(reach))
    places = F.flatten(F.transform(near, lambda dx: F.transform(near, lambda dy: F.struct((F.col("_at.cx") + dx).alias("cx"), (F.col("_at.cy") + dy).alias("cy")))))
    sums = queries.select("_at").distinct().withColumn("_cell", F.explode(places)).join(cells, "_cell").groupBy("_at").agg(F.sum("_w").alias("_w"))
    return queries.join(sums, "_at", "left").withColumn("density", F.coalesce("_w", F.lit(0))).drop("_at", "_w")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def point_to_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (x, y) and segments (ax, ay, bx, by) at most radius apart, with `distance`.

    A segment is dealt to every cell that its box, widened by the radius, meets.
    """
    side = F.lit(float(radius))
    lo = lambda a, b: F.floor((F.least(F.col(a), F.col(b)) - radius) / side)
    hi = lambda a, b: F.floor((F.greatest(F.col(a), F.col(b)) + radius) / side)
    cells = segments.withColumn("_cx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("_cy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    asked = points.withColumn("_px", F.floor(F.col("x") / side)).withColumn("_py", F.floor(F.col("y") / side))
    distance = segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    joined = asked.join(large(cells), (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & (distance <= radius))
    return joined.withColumn("distance", distance).drop("_cx", "_cy", "_px", "_py")


def inside_rings(points: DataFrame, ring_edges: DataFrame, key: str, ring: str, side: float | None = None) -> DataFrame:
    """(key, ring) where a point lies in a closed ring, by counting the edges that a ray to the right crosses.

    Edges are dealt to the rows of a grid that they span, so a point meets only edges at its own height. A row is `side`
    high, by default a 64th of the highest edge: no edge is dealt to more than 65 rows.
    """
    if side is None:
        side = (ring_edges.agg(F.max(F.abs(F.col("by") - F.col("ay")))).first()[0] or 64.0) / 64
    rows = ring_edges.withColumn("_row", F.explode(F.sequence(F.floor(F.least("ay", "by") / side), F.floor(F.greatest("ay", "by") / side))))
    asked = points.withColumn("_at", F.floor(F.col("y") / side))
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right_of = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    crossed = asked.join(large(rows), (F.col("_at") == F.col("_row")) & spans & right_of)
    return crossed.groupBy(key, ring).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")


def bilinear(points: DataFrame, cells: DataFrame, size: float, columns: int, rows: int) -> DataFrame:
    """points with z, between the four cell centres around; null outside the raster or if any of them has no value.

    Between the outermost centres and the raster's edge the outermost centres count. cells: (row, col, z) of one raster
    whose row 0 is at y = 0; centres are half a cell in.
    """
    inside = F.col("x").between(0, columns * size) & F.col("y").between(0, rows * size)
    gx = F.greatest(F.lit(0.0), F.least(F.lit(columns - 1.0), F.col("x") / size - 0.5))
    gy = F.greatest(F.lit(0.0), F.least(F.lit(rows - 1.0), F.col("y") / size - 0.5))
    c0 = F.least(F.floor(gx), F.lit(max(columns - 2, 0)))
    r0 = F.least(F.floor(gy), F.lit(max(rows - 2, 0)))
    at = points.withColumn("_c", c0).withColumn("_r", r0).withColumn("_fx", gx - c0).withColumn("_fy", gy - r0)
    corner = F.explode(F.array(*[
        F.struct((F.col("_r") + dr).alias("row"), (F.col("_c") + dc).alias("col"), (wr * wc).alias("w"))
        for dr, wr in ((0, 1 - F.col("_fy")), (1, F.col("_fy"))) for dc, wc in ((0, 1 - F.col("_fx")), (1, F.col("_fx")))
    ]))
    keys = points.columns
    four = at.withColumn("_k", corner).select(*keys, "_k.row", "_k.col", "_k.w").where("w > 0").join(cells, ["row", "col"], "left")
    return four.groupBy(*keys).agg(F.when(inside & (F.count("z") == F.count(F.lit(1))), F.sum(F.col("w") * F.col("z"))).alias("z"))
