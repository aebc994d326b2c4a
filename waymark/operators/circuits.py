"""Circuits of all areas together: the way out, the way back on dearer ground, side trips taken out, and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import passing, written
from .routes import retrace_share, route_points, trace
from .search import broken, cheapest_routes, ground, slice_share, steps_of
from .spatial import large

#: A side trip goes if so much of it retraces itself; a circuit with more is an out-and-back.
SIDE_TRIP, OUT_AND_BACK = 0.80, 0.6


def farthest_ends(stretches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area, start, goal): the start of each area's first stretch, and the stretch end in the area farthest from it.

    stretches: area, rank, start_node, end_node. Of equally far ends the first counts; an area without another end is left out.
    """
    ends = stretches.select("area", "rank", F.posexplode(F.array("start_node", "end_node")).alias("side", "node"))
    first = stretches.groupBy("area").agg(F.min_by("start_node", "rank").alias("start"))
    start = first.join(large(nodes.select(F.col("node").alias("start"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))), "start")
    far = ends.join(large(start), "area").join(large(nodes), "node").withColumn("_d", F.round(F.hypot(F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy")), 9))
    best = far.groupBy("area", "start").agg(F.min(F.struct((-F.col("_d")).alias("d"), "rank", "side", "node")).alias("b"))
    return best.where(F.col("b.node") != F.col("start")).select("area", "start", F.col("b.node").alias("goal"))


def without_side_trips(routes: DataFrame, edges: DataFrame, segments: DataFrame, key: str = "route") -> DataFrame:
    """(key, edges) of closed routes without reversals and without side trips that mostly retrace themselves.

    A side trip leaves a node and comes back to it. Of all that may go, the one that ends first goes first (a reversal
    before others, then the shortest), until none is left: each round takes one out of every route. The start stays, and
    so do real loops. Retracing is measured on the roads' own lines. routes: key, edges; edges: edge_id, u, v, slice_id,
    rev; segments: slice_id, line. A route that is broken or open raises an error. Rounds: the most trips of any route.
    """
    spark = routes.sparkSession
    steps = written(steps_of(routes, key), "steps")
    if not broken(steps, edges, key).isEmpty():
        raise ValueError("a circuit has to be continuous and closed")
    known = edges.select("edge_id", "u", "v", "slice_id", "rev")
    done, open_ = [], steps
    along = Window.partitionBy(key).orderBy("pos")
    while True:
        with passing(spark):
            walk = written(open_.withColumn("pos", F.row_number().over(along) - 1).join(large(known), "edge_id"), "walk")
            turn = (F.lead("slice_id").over(along) == F.col("slice_id")) & (F.lead("u").over(along) == F.col("v")) & (F.lead("v").over(along) == F.col("u"))
            turns = walk.withColumn("_turn", turn).where("_turn").groupBy(key).agg(F.min("pos").alias("_at"))
            turns = turns.select(key, (F.col("_at") + 2).alias("end"), F.col("_at").alias("begin"))
            leave = walk.where("pos > 0").select(key, F.col("pos").alias("begin"), F.col("u").alias("_node"))
            return_ = walk.select(key, (F.col("pos") + 1).alias("end"), F.col("v").alias("_node"))
            trips = leave.join(large(return_), [key, "_node"]).where("begin < end").join(large(turns.select(key, F.col("end").alias("_turned"))), key, "left")
            trips = trips.where("_turned is null or end < _turned").select(F.struct(key, "begin", "end").alias("trip"))
            inside = trips.join(large(walk), (F.col(f"trip.{key}") == walk[key]) & F.col("pos").between(F.col("trip.begin"), F.col("trip.end") - 1))
            drawn = trace(route_points(inside.select(F.col("trip").alias("route"), (F.col("pos") - F.col("trip.begin")).alias("pos"), "slice_id", "rev"), segments))
            back = retrace_share(drawn).where(F.col("share") >= SIDE_TRIP).select(f"route.{key}", "route.end", "route.begin")
            first = back.unionByName(turns).groupBy(key).agg(F.min(F.struct("end", (-F.col("begin")).alias("b"))).alias("_cut"))
            marked = written(walk.join(large(first), key, "left").select(key, "pos", "edge_id", "_cut"), "marked", kept=True)
        done.append(marked.where("_cut is null").select(key, "pos", "edge_id"))
        going = marked.where("_cut is not null")
        if going.isEmpty():
            break
        open_ = written(going.where("not (pos >= -_cut.b and pos < _cut.end)").select(key, "pos", "edge_id"), "steps")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "edge_id"))).alias("_e")).select(key, F.col("_e.edge_id").alias("edges"))


def dearer_by(used: DataFrame, factor: float, before: DataFrame | None) -> DataFrame:
    """(pair, slice_id, factor): `before` with the used (pair, slice_id) at `factor` times their cost."""
    more = used.select("pair", "slice_id").distinct().withColumn("factor", F.lit(float(factor)))
    both = more if before is None else more.unionByName(before)
    return both.groupBy("pair", "slice_id").agg(F.product("factor").alias("factor"))


def circuits(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, segments: DataFrame, dearer: DataFrame | None = None, reuse: float = 2.5, **options) -> DataFrame:
    """(pair, edges, out_and_back) of each pair (pair, start, goal) that has a way out and a way back.

    The way back sees the way out's slices at `reuse` times their cost, on top of the pair's own `dearer` (pair,
    slice_id, factor). edges: edge_id, u, v, slice_id, cost, length_m, rev.
    """
    lengths = edges.select("edge_id", "slice_id", "length_m")
    out = cheapest_routes(edges, nodes, pairs, dearer=dearer, **options).where(F.size("path") > 0).select("pair", F.col("path").alias("out"))
    gone = steps_of(out, "pair", "out")
    home = pairs.join(large(out), "pair", "left_semi").select("pair", F.col("goal").alias("start"), F.col("start").alias("goal"))
    twice = written(dearer_by(gone.join(large(lengths), "edge_id"), reuse, dearer), "dearer")
    back = cheapest_routes(edges, nodes, home, dearer=twice, **options).where(F.size("path") > 0).select("pair", F.col("path").alias("back"))
    both = written(out.join(large(back), "pair"), "ways")
    clean = written(without_side_trips(both.select("pair", F.concat("out", "back").alias("edges")), edges, segments, "pair"), "circuits")
    shared = slice_share(steps_of(both, "pair", "out").drop("pos"), steps_of(both, "pair", "back").drop("pos"), lengths, ["pair"])
    drawn = trace(route_points(steps_of(clean, "pair").join(large(edges.select("edge_id", "slice_id", "rev")), "edge_id").select(F.col("pair").alias("route"), "pos", "slice_id", "rev"), segments))
    traced = retrace_share(drawn).select(F.col("route").alias("pair"), F.col("share").alias("_traced"))
    measured = clean.join(large(both), "pair").join(large(shared), "pair").join(large(traced), "pair", "left")
    cut = F.size("edges") < F.size("out") + F.size("back")
    return measured.select("pair", "edges", (F.when(cut, F.coalesce("_traced", F.lit(0.0))).otherwise(F.col("share")) > OUT_AND_BACK).alias("out_and_back"))


def circuit_variants(
    pairs: DataFrame, edges: DataFrame, nodes: DataFrame, segments: DataFrame, most: int = 2, reuse: float = 2.5, most_overlap: float = 0.30, **options
) -> DataFrame:
    """(pair, variant, edges, out_and_back): up to `most` circuits of each pair, all pairs together.

    After each turn the slices that a pair has used cost it `reuse` times as much as before. A pair stops at a circuit
    that shares more than most_overlap of its own length with an earlier one of the pair, or when it has none.
    """
    edges, nodes, segments, pairs = (written(df, what, kept=True) for df, what in ((edges, "edges"), (nodes, "nodes"), (segments, "segments"), (pairs, "pairs")))  # searched many times
    options = {"ground": ground(edges, nodes, options.get("rate", 1.0)), **options}
    lengths = edges.select("edge_id", "slice_id", "length_m")
    kept, dearer, going = None, None, pairs
    for variant in range(most):
        with passing(pairs.sparkSession):
            found = written(circuits(going, edges, nodes, segments, dearer, reuse, **options), "found")
            if kept is not None:
                each = kept.select("pair", F.col("variant").alias("_old"))
                mine = steps_of(found, "pair").drop("pos").join(large(each), "pair")
                theirs = steps_of(kept.select("pair", F.col("variant").alias("_old"), "edges").withColumn("_key", F.struct("pair", "_old")), "_key").select("_key.pair", "_key._old", "edge_id")
                alike = slice_share(mine, theirs, lengths, ["pair", "_old"]).where(F.col("share") > most_overlap).select("pair").distinct()
                found = found.join(large(alike), "pair", "left_anti")
            new = written(found.withColumn("variant", F.lit(variant)), "variants", kept=True)
            used = steps_of(new, "pair").join(large(lengths), "edge_id").select("pair", "slice_id")
            dearer = written(dearer_by(used, reuse, dearer), "dearer", kept=True)
        kept = new if kept is None else kept.unionByName(new)
        going = going.join(large(new.select("pair")), "pair", "left_semi")
    return kept.select("pair", "variant", "edges", "out_and_back")
