"""Route profiles: parts of equal distance, their medians and means, heights along the way, and corner markers.

Bounds and edges of a route are put in one order along it, so a bound learns by a running count which edge it falls
into; a part's edges are then met by equality. Medians come from counts of values, so no group's values are held together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .spatial import large


def equal_parts(steps: DataFrame, parts: Column, key: str = "route") -> DataFrame:
    """(key, part, i0, i1, at): the edges i0 to i1 of each of the route's `parts` equal spans of distance.

    steps: key, pos (from 0, without gaps), length_m; parts: an expression on `total_m` and `n_edges`. A part has the
    edges that begin in it; a part in which none begins has the one that begins next (the last edge at the end), so each
    has one at least. at: where edge i0 begins. A route without length is one part.
    """
    ends = _placed(steps.select(key, "pos", "length_m"), key)
    return _spans(ends, parts, key).join(large(ends.select(key, F.col("pos").cast("long").alias("i0"), F.col("_start").alias("at"))), [key, "i0"]).select(key, "part", "i0", "i1", "at")


def _placed(steps: DataFrame, key: str) -> DataFrame:
    """steps with _start and _end along their route."""
    along = Window.partitionBy(key).orderBy("pos")
    ends = steps.withColumn("_end", F.sum("length_m").over(along))
    return ends.withColumn("_start", F.coalesce(F.lag("_end").over(along), F.lit(0.0)))


def _spans(ends: DataFrame, parts: Column, key: str) -> DataFrame:
    """(key, part, i0, i1) of equal_parts, from placed steps."""
    total = ends.groupBy(key).agg(F.max("_end").alias("total_m"), F.max("pos").alias("_last"), F.count(F.lit(1)).alias("n_edges"))
    total = total.withColumn("_parts", F.when(F.col("total_m") > 0, parts.cast("int")).otherwise(1))
    bounds = total.select(key, "_last", "_parts", "total_m", F.explode(F.sequence(F.lit(0), F.col("_parts"))).alias("_k"))
    at = F.when(F.col("_k") == F.col("_parts"), F.col("total_m")).otherwise(F.col("_k") * (F.col("total_m") / F.col("_parts")))
    placed_at = lambda c: F.round(c, 6)  # noqa: E731  sums of doubles that are one place count as one
    marks = bounds.select(key, placed_at(at).alias("_s"), F.lit(0).alias("_kind"), "_k", F.col("_last").cast("long").alias("_last"), "_parts", "total_m")
    none = lambda kind: F.lit(None).cast(kind)
    mark = lambda place: [key, placed_at(F.col(place)).alias("_s"), F.lit(1).alias("_kind"), none("int").alias("_k"), none("long").alias("_last"), none("int").alias("_parts"), none("double").alias("total_m")]
    order = Window.partitionBy(key).orderBy("_s", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.unionByName(ends.select(*mark("_start"))).unionByName(total.select(*mark("total_m"))).withColumn("_before", F.sum("_kind").over(order)).where("_kind = 0")
    after = F.lead("_before").over(Window.partitionBy(key).orderBy("_k"))
    spans = seen.withColumn("_after", after).where("_k < _parts")
    first, last = F.least("_before", "_last").cast("long"), F.col("_last")
    flat = ~F.coalesce(F.col("total_m") > 0, F.lit(False))  # a route without length: all of its edges
    return spans.select(
        key, F.col("_k").alias("part"), F.when(flat, F.lit(0).cast("long")).otherwise(first).alias("i0"), F.when(flat, last).otherwise(F.greatest(first, F.least(F.col("_after") - 1, last))).cast("long").alias("i1"),
    )


def median_by_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, median) of a value, from how often each of its values is there."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    each = Window.partitionBy(*keys)
    upto = F.sum("_n").over(each.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(each))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    ends = [F.min(F.when(F.col("_upto") >= at, F.col(value))) for at in (low, high)]
    return placed.groupBy(*keys).agg(((ends[0] + ends[1]) / 2).alias("median"))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*keys, a column for each share) of a value, between the two rows around (n - 1) * share in proportion; nulls do not count.

    Values are counted and dealt by range, so a group's values lie in many tasks; their numbers of rows, one for each task
    and group, tell which ranges hold the ranks that are asked for, and only those are put in order.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("_n")).repartitionByRange(tasks, *keys, value)
    counts = written(counts.withColumn("_part", F.spark_partition_id()), "counts")
    sums = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"))
    each = Window.partitionBy(*keys)
    sums = sums.withColumn("_all", F.sum("_rows").over(each)).withColumn("_first", F.sum("_rows").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"))
    at = {name: (F.col("_all") - 1) * share for name, share in shares.items()}
    ranks = [rank(place).cast("long") + 1 for place in at.values() for rank in (F.floor, F.ceil)]
    here = lambda rank: (F.col("_first") < rank) & (F.col("_first") + F.col("_rows") >= rank)
    asked = sums.withColumn("_asked", F.array_contains(F.array(*map(here, ranks)), True)).where("_asked or _all = 0")
    named = {c: f"_{c}_asked" for c in [*keys, "_part"]}
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()))
    met = counts.join(large(asked.withColumnsRenamed(named)), same).drop(*named.values())
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = met.withColumn("_upto", F.col("_first") + upto)
    found = placed.groupBy(*keys, "_all").agg(*[F.min(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col(value))).alias(f"_v{k}") for k, rank in enumerate(ranks)])
    between = lambda k, place: F.when(F.col(f"_v{k}") == F.col(f"_v{k + 1}"), F.col(f"_v{k}").cast("double")).otherwise((F.ceil(place) - place) * F.col(f"_v{k}") + (place - F.floor(place)) * F.col(f"_v{k + 1}"))
    return found.select(*keys, *[between(2 * k, place).alias(name) for k, (name, place) in enumerate(at.items())])


def route_profile(steps: DataFrame, points: DataFrame, key: str = "route") -> DataFrame:
    """(key, part, i0, i1, fun, lim, v, km, head): a part for each 1.5 km, from 8 to 40 of them.

    steps: key, pos, length_m, fun, legal_speed, head_per_km; points: key, n_points (vertices of the drawn line). fun is in
    hundredths, weighted by length; lim the median limit and v the same, at most 130; head the turning for each km of
    350 degrees, at most 1. i0 and i1 are places on the drawn line in proportion to the distance, km where the part begins.
    """
    # what the steps come from is worked out once
    steps = _placed(steps.select(key, F.col("pos").cast("long").alias("pos"), "length_m", "fun", "legal_speed", "head_per_km"), key)
    steps = written(steps.withColumn("_s", F.col("_end") - F.col("length_m")), "steps")
    km = F.col("total_m") / 1000
    parts = _spans(steps, F.greatest(F.lit(8), F.least(F.lit(40), F.bround(km / 1.5, 0))), key)
    met = parts.select(key, "part", F.col("i0").alias("_i0"), F.explode(F.sequence("i0", "i1")).alias("pos")).join(large(steps.drop("_end")), [key, "pos"])
    # a row for each limit of a part: places, means and medians come from the same sums
    sums = met.groupBy(key, "part", "legal_speed").agg(
        F.count("legal_speed").alias("_n"), F.sum("length_m").alias("_m"), F.sum(F.col("fun") * F.col("length_m")).alias("_fun"), F.sum(F.col("head_per_km") * F.col("length_m")).alias("_head"),
        F.min(F.when(F.col("pos") == F.col("_i0"), F.col("_start"))).alias("_at"), F.max("_s").alias("_at1"),
    )
    each = Window.partitionBy(key, "part")
    placed = sums.withColumn("_upto", F.sum("_n").over(each.orderBy("legal_speed").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(each))
    limit = [F.min(F.when((F.col("_upto") >= at) & (F.col("_n") > 0), F.col("legal_speed"))) for at in (F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1)]
    weight = F.greatest(F.sum("_m"), F.lit(1e-9))
    found = placed.groupBy(key, "part").agg(
        (F.sum("_fun") / weight).alias("_fun"), (F.sum("_head") / weight).alias("_head"), ((limit[0] + limit[1]) / 2).alias("median"), F.min("_at").alias("at"), F.max("_at1").alias("_at1"),
    ).where("median is not null")
    total = steps.groupBy(key).agg(F.greatest(F.sum("length_m"), F.lit(1e-9)).alias("_total")).join(large(points), key)
    joined = found.join(large(total), key)
    place = lambda s: F.bround(F.round(s * ((F.col("n_points") - 1) / F.col("_total")), 9), 0).cast("long")
    return joined.select(
        key, "part", place(F.col("at")).alias("i0"), place(F.col("_at1")).alias("i1"), F.bround(F.round(F.col("_fun") * 100, 9), 0).cast("int").alias("fun"), F.bround("median", 0).cast("int").alias("lim"),
        F.bround(F.least("median", F.lit(130)), 0).cast("int").alias("v"), F.round(F.col("at") / 1000, 2).alias("km"), F.round(F.least(F.col("_head") / 350, F.lit(1.0)), 2).alias("head"),
    )


def exact_profile(steps: DataFrame, key: str = "route") -> DataFrame:
    """(key, part, i0, i1, fun, lim, v) with a part for each edge and its own posted limit: where all vertices are drawn.

    steps: key, pos, n_vertices of the edge, fun, legal_speed. Neighbours share the vertex at their joint.
    """
    along = Window.partitionBy(key).orderBy("pos")
    last = F.sum(F.col("n_vertices") - 1).over(along)
    return steps.withColumn("i1", last).select(
        key, F.col("pos").alias("part"), (F.col("i1") - F.col("n_vertices") + 1).alias("i0"), "i1", F.bround(F.col("fun") * 100, 0).cast("int").alias("fun"),
        F.col("legal_speed").cast("int").alias("lim"), F.col("legal_speed").cast("int").alias("v"),
    )


def height_profile(points: DataFrame, most: int = 60, gaps: bool = True, key: str = "route") -> DataFrame:
    """(key, nth, km, z): heights at evenly numbered places between a route's vertices, a place for each 1.5 km, 8 to `most`.

    points: key, seq (from 0), s, z (null: unknown). A place between two vertices lies in proportion between them and is
    unknown if one of them is. Unknown places take the median of the known ones; without `gaps` a route with an unknown
    place has no profile, and a route without any known place never has one.
    """
    # a vertex holds the next one, so a place meets one row; what the points come from is worked out once
    along = Window.partitionBy(key).orderBy("seq")
    follows = F.lead("seq").over(along) == F.col("seq") + 1
    ahead = [F.when(follows, F.lead(c).over(along)).alias(f"_{c}1") for c in ("s", "z")]
    vertices = written(points.select(key, F.col("seq").cast("long").alias("_i"), F.col("s").alias("_s0"), F.col("z").alias("_z0"), *ahead), "vertices")
    whole = vertices.groupBy(key).agg(F.max("_i").alias("_last"), F.max("_s0").alias("_total")).where("_last >= 1")
    n = F.greatest(F.lit(8), F.least(F.lit(most), F.bround(F.col("_total") / 1000 / 1.5, 0))).cast("int")
    asked = whole.withColumn("_n", n).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    asked = asked.withColumn("_at", F.col("nth") * (F.col("_last") / (F.col("_n") - 1))).withColumn("_i", F.least(F.floor("_at"), F.col("_last")).cast("long"))
    both = asked.select(key, "nth", "_last", "_i", (F.col("_at") - F.col("_i")).alias("_f")).join(large(vertices), [key, "_i"])
    between = lambda a, b: F.when(F.col(b).isNull() & (F.col("_i") == F.col("_last")), F.col(a)).otherwise(F.col(a) * (1 - F.col("_f")) + F.col(b) * F.col("_f"))
    placed = both.select(key, "nth", between("_s0", "_s1").alias("_s"), between("_z0", "_z1").alias("_z"))
    median = median_by_counts(placed, [key], "_z")
    if not gaps:
        placed = placed.join(large(placed.where("_z is null").select(key).distinct()), key, "left_anti")
    return placed.join(large(median), key).select(key, "nth", F.round(F.col("_s") / 1000, 2).alias("km"), F.round(F.coalesce("_z", "median"), 1).alias("z"))


def corner_markers(routes: DataFrame, corners: DataFrame, edges: DataFrame, vertices: DataFrame, most: int = 24, key: str = "route") -> DataFrame:
    """(key, nth, x, y, r, dir, v): the first engaged corners on a route's edges, by the corner's own number.

    routes: key, edge_id; corners: corner, edge_id, s, radius, sign, speed, engaged; edges: edge_id, slice_id, rev,
    length_m; vertices: slice_id, seq (from 0), x, y. A corner lies as far along the numbers of its slice's vertices as it
    does along its edge's length. dir is L for a turn to the left.
    """
    on = routes.select(key, "edge_id").distinct().join(large(corners.where("engaged")), "edge_id")
    first = on.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("corner"))).where(F.col("nth") <= most)
    ends = vertices.groupBy("slice_id").agg(F.max("seq").alias("_last"))
    placed = first.join(large(edges), "edge_id").join(large(ends), "slice_id")
    share = F.col("s") / F.greatest("length_m", F.lit(1e-9))
    placed = placed.withColumn("_at", F.when(F.col("rev"), F.col("_last") - share * F.col("_last")).otherwise(share * F.col("_last")))
    placed = placed.withColumn("_i", F.greatest(F.lit(0), F.least(F.floor("_at"), F.col("_last"))).cast("long")).withColumn("_j", F.least(F.col("_i") + 1, F.col("_last")).cast("long"))
    placed = placed.withColumn("_f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_at") - F.col("_i"))))
    side = lambda i, n: vertices.select("slice_id", F.col("seq").cast("long").alias(i), F.col("x").alias(f"_x{n}"), F.col("y").alias(f"_y{n}"))
    met = placed.join(large(side("_i", 0)), ["slice_id", "_i"]).join(large(side("_j", 1)), ["slice_id", "_j"])
    between = lambda c: F.col(f"_{c}0") * (1 - F.col("_f")) + F.col(f"_{c}1") * F.col("_f")
    return met.select(
        key, F.col("nth").cast("long").alias("nth"), between("x").alias("x"), between("y").alias("y"), F.bround("radius", 0).cast("int").alias("r"), F.when(F.col("sign") > 0, "L").otherwise("R").alias("dir"),
        F.bround("speed", 0).cast("int").alias("v"),
    )
