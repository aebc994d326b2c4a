"""Searches for many pairs of nodes together: goal-directed, tile by tile, with costs that may differ by pair.

Nodes are dealt to tiles of places near each other, at most TILE nodes in each. A row of the state is a node that a pair's
search has reached: its cost, the edge into it, and an estimate of the whole way through it (cost plus the straight distance
to the goal at the least rate). A round takes each tile where a pair has open rows whose estimate lies within a bucket above
the pair's least one, and goes on inside it, least estimate first; what leaves the tile is met there in the next round.
Nothing is expanded that cannot beat the goal's best known cost. So rounds are as many as tiles and buckets on the way, all
pairs move on together, and a task holds one tile and one pair's rows in it at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import passing, written
from .spatial import large

#: Rows of a side that is broadcast, one for each pair and tile that a round takes, or the ends of ways; more are shuffled.
FEW, FEW_OPEN = 1 << 17, 1 << 15
#: Nodes of a tile at most.
TILE = 1 << 12


def cheapest_routes(
    edges: DataFrame, nodes: DataFrame, pairs: DataFrame, bucket: float | None = None, dearer: DataFrame | None = None, rate: float = 1.0,
    bound: float | None = None, most_rounds: int = 100_000, closed: DataFrame | None = None,
    ground: Ground | None = None,
) -> DataFrame:
    """(pair, cost, path) of the cheapest way of each pair that has one; ties by the lesser last edge.

    edges: edge_id, u, v, cost (null: closed), and slice_id if `dearer` is given; nodes: node, x, y; pairs: pair, start,
    goal. No edge may cost less than `rate` for each unit of the straight distance between its ends: that is looked at.
    dearer: (pair, slice_id, factor), factors of 1 or more, null for closed; a pair's slice has one row. closed: (pair,
    edge_id) that a pair may not use. If pairs have `window` (bits), a pair uses the edges whose `mask` has one of them.
    bucket: the width of a round in cost, by default a tile's width of mean edges. Ways dearer than `bound` are not looked
    for. A pair whose ends are one node costs 0. Pairs, slices and edges are numbers. ground: what `ground` gave for the same
    edges, nodes and rate, for those who search them many times.
    """
    return _search(edges, nodes, pairs, bucket, dearer, rate, bound, most_rounds, closed, ground)


def reached_nodes(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """(pair, node) that the search of cheapest_routes reaches: what it costs."""
    return _search(edges, nodes, pairs, **{"bucket": None, "dearer": None, "rate": 1.0, "bound": None, "most_rounds": 100_000, "closed": None, "given": None, **options}, reached=True)


STATE = ["pair", "tile", "node", "cost", "edge", "before", "origin", "est", "open", "end"]
STATE_DDL = "pair long, tile long, node long, cost double, edge long, before long, origin long, est double, open boolean, end boolean"
ASKED = ["goal", "win", "gx", "gy", "limit", "best"]
WAYS = ["u", "edge", "step", "vx", "vy", "vtile", "slice", "mask", "v"]


@dataclass(frozen=True)
class Ground:
    """A network dealt to tiles: places (node, x, y, tile), usable (tile, and an edge in columns), ways (tile, and all of
    its edges in arrays), and the mean cost of an edge."""

    places: DataFrame
    usable: DataFrame
    ways: DataFrame
    mean: float


def ground(edges: DataFrame, nodes: DataFrame, rate: float = 1.0) -> Ground:
    places = _tiles(nodes)
    usable = _usable(edges, places, rate)
    listed = usable.groupBy("tile").agg(F.collect_list(F.struct(*WAYS)).alias("_w"))
    ways = written(listed.select("tile", *[F.col(f"_w.{c}").alias(f"_{c}") for c in WAYS]), "ways")
    return Ground(places, usable, ways, usable.agg(F.avg("step")).first()[0] or 1.0)


def _search(edges, nodes, pairs, bucket, dearer, rate, bound, most_rounds, closed, given, reached=False):
    spark = edges.sparkSession
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with passing(spark):
        net = given or ground(edges, nodes, rate)
        place = lambda name, *more: net.places.select(F.col("node").alias(name), *more)
        if bucket is None:
            bucket = math.sqrt(TILE) * net.mean
        start = pairs.select(F.col("pair").cast("long").alias("pair"), F.col("start").cast("long").alias("node"), F.col("goal").cast("long").alias("goal"), (F.col("window") if "window" in pairs.columns else F.lit(None)).cast("long").alias("win")).distinct()
        start = start.join(large(place("goal", F.col("x").alias("gx"), F.col("y").alias("gy"))), "goal").join(large(place("node", "tile", "x", "y")), "node")
        start = written(start, "start")
        none, same = F.lit(None).cast("long"), F.col("node") == F.col("goal")
        straight = F.hypot(F.col("gx") - F.col("x"), F.col("gy") - F.col("y")) * rate
        known = start.select("pair", "tile", "node", F.lit(0.0).alias("cost"), none.alias("edge"), none.alias("before"), none.alias("origin"), straight.alias("est"), (~same).alias("open"), same.alias("end"))
        asked = start.select("pair", "goal", "win", "gx", "gy")
        bars = _bars(net.usable, dearer, closed)
        for _ in range(most_rounds):
            best = F.coalesce(F.min(F.when(F.col("end"), F.col("cost"))), F.lit(math.inf))
            marks = known.groupBy("pair").agg((F.min(F.when(F.col("open"), F.col("est"))) + bucket).alias("limit"), (best if bound is None else F.least(best, F.lit(float(bound)))).alias("best"))
            now = F.col("open") & (F.col("est") <= F.col("limit")) & (F.col("est") <= F.col("best") + 1e-9)
            taken = known.where("open").select("pair", "tile", "est", "open").join(large(marks.where("limit is not null")), "pair").where(now).select("pair", "tile", "limit", "best").distinct()
            taken = written(taken.join(large(asked), "pair").select("pair", "tile", *ASKED), "taken")
            if not (going := taken.count()):
                break
            taken = (F.broadcast if going <= FEW else large)(taken)  # what a round takes goes to the rows, or is dealt together with them
            met = known.join(taken, ["pair", "tile"], "left")
            rows = met.where("limit is not null").withColumn("kind", F.lit(2))
            rows = rows.unionByName(net.ways.join(taken, "tile", "left_semi").withColumn("kind", F.lit(0)), allowMissingColumns=True)
            if bars is not None:
                rows = rows.unionByName(bars.join(taken, ["pair", "tile"]).select(*bars.columns, F.lit(1).alias("kind")), allowMissingColumns=True)
            rows = rows.select("tile", "pair", "kind", *STATE[2:], *ASKED, *[f"_{c}" for c in WAYS])
            grown = rows.repartition(min(tasks, going), "tile").sortWithinPartitions("tile", "pair", "kind").mapInArrow(_grown(rate), STATE_DDL)
            known = written(grown.unionByName(met.where("limit is null").select(*STATE)), "known")
        else:
            raise RuntimeError(f"the search has not ended in {most_rounds} rounds")
        if reached:
            return written(known.select("pair", "node").distinct(), "reached", kept=True)
        ends = known.where("end") if bound is None else known.where(F.col("end") & (F.col("cost") <= bound))
        return written(_ways_to(ends, known, tasks), "routes", kept=True)


def _tiles(nodes: DataFrame) -> DataFrame:
    """(node, x, y, tile): cells of a grid that hold most of TILE nodes each; a fuller cell is cut along x."""
    box = nodes.agg(F.count(F.lit(1)), *[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    width, height = ((box[2 * i + 2] or 0.0) - (box[2 * i + 1] or 0.0) or 1.0 for i in range(2))
    share = 0.8 * TILE / max(box[0], 1)
    side = max(math.sqrt(width * height * share), max(width, height) * share)  # a long strip is one cell wide
    cell = [F.floor(F.col(c) / side).alias(f"_c{c}") for c in "xy"]
    nth = F.row_number().over(Window.partitionBy("_cx", "_cy").orderBy("x", "y", "node"))
    cut = nodes.select(F.col("node").cast("long").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *cell).withColumn("_part", F.floor((nth - 1) / TILE))
    return written(cut.select("node", "x", "y", F.xxhash64("_cx", "_cy", "_part").alias("tile")), "tiles")


def _usable(edges: DataFrame, places: DataFrame, rate: float) -> DataFrame:
    """The edges that are not closed, with the tiles of both ends; too cheap ones raise an error."""
    place = lambda name, *more: places.select(F.col("node").alias(name), *more)
    own = lambda name: (F.col(name) if name in edges.columns else F.lit(None)).cast("long")
    ids = [F.col(c).cast("long").alias(c) for c in ("u", "v")]
    usable = edges.where("cost is not null").select(F.col("edge_id").cast("long").alias("edge"), *ids, F.col("cost").cast("double").alias("step"), own("slice_id").alias("slice"), F.coalesce(own("mask"), F.lit(0)).alias("mask"))
    usable = usable.join(large(place("u", "tile", F.col("x").alias("_ux"), F.col("y").alias("_uy"))), "u").join(large(place("v", F.col("tile").alias("vtile"), F.col("x").alias("vx"), F.col("y").alias("vy"))), "v")
    straight = F.hypot(F.col("vx") - F.col("_ux"), F.col("vy") - F.col("_uy")) * rate
    wrong = F.raise_error(F.lit("an edge costs less than the straight way at the least rate")).cast("double")
    return written(usable.withColumn("step", F.when(F.col("step") >= straight * (1 - 1e-9) - 1e-9, F.col("step")).otherwise(wrong)).select("tile", *WAYS), "usable")


def _bars(usable: DataFrame, dearer: DataFrame | None, closed: DataFrame | None) -> DataFrame | None:
    """(pair, tile, node, cost) of slices and (pair, tile, edge) of closed edges: what a pair's search in a tile has to know."""
    bars = None
    if dearer is not None:
        factor = F.coalesce(F.col("factor").cast("double"), F.lit(math.inf)).alias("cost")
        at = usable.select(F.col("slice").alias("node"), "tile").distinct()
        bars = dearer.select(F.col("pair").cast("long").alias("pair"), F.col("slice_id").cast("long").alias("node"), factor).join(large(at), "node").withColumn("edge", F.lit(None).cast("long"))
    if closed is not None:
        shut = closed.select(F.col("pair").cast("long").alias("pair"), F.col("edge_id").cast("long").alias("edge")).join(large(usable.select("edge", "tile")), "edge")
        shut = shut.withColumn("node", F.lit(None).cast("long")).withColumn("cost", F.lit(None).cast("double"))
        bars = shut if bars is None else bars.unionByName(shut)
    return None if bars is None else written(bars.select("pair", "tile", "node", "cost", "edge"), "bars")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _grown(rate: float):
    """One round inside tiles. Rows come by tile: its ways first, then by pair what is barred and what is known there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ways, at = [], {}, None
        for (tile, pair), group in groupby(_rows(batches), itemgetter(0, 1)):
            if pair is None:
                ways, at = {}, tile
                for row in group:
                    for u, *way in zip(*row[-len(WAYS) :], strict=True):
                        ways.setdefault(u, []).append(way)
                continue
            factor, shut, known, asked = {}, set(), {}, None
            for _, _, kind, node, cost, edge, before, origin, est, open_, end, *more in group:
                if kind == 2:
                    _meet(known, node, [cost, edge, before, origin, est, open_, end, tile])
                    asked = more[: len(ASKED)]
                elif edge is None:
                    factor[node] = cost
                else:
                    shut.add(edge)
            if asked is not None:
                made += [(pair, row[7], node, *row[:7]) for node, row in _inside(ways if at == tile else {}, known, tile, asked, factor, shut, rate)]
            if len(made) >= 8192:
                yield _batch(made, STATE_DDL)
                made = []
        if made:
            yield _batch(made, STATE_DDL)

    return run


def _meet(table: dict, node: int, row: list) -> bool:
    """Take a way to a node into a table: the cheapest one, of equal ones the lesser edge. Whether it is cheaper than before."""
    old = table.get(node)
    if old is None or row[0] < old[0]:
        table[node] = row
        return True
    if row[0] == old[0]:
        old[5] = old[5] and row[5]  # if one of them has been expanded, the cost has
        if old[1] is not None and (row[1] is None or row[1] < old[1]):
            old[1:4] = row[1:4]
    return False


def _inside(ways: dict, known: dict, tile: int, asked: list, factor: dict, shut: set, rate: float) -> list[tuple]:
    """(node, row) of one pair in one tile after a round, and of the nodes beyond that it leads to."""
    goal, win, gx, gy, limit, best = asked
    beyond: dict = {}
    heap = [(row[4], row[0], node) for node, row in known.items() if row[5] and row[4] <= limit]
    heapq.heapify(heap)
    while heap and heap[0][0] <= best + 1e-9:
        _, gone, node = heapq.heappop(heap)
        row = known[node]
        if not row[5] or row[0] != gone:
            continue
        row[5] = False
        for edge, step, vx, vy, vtile, slice_, mask, v in ways.get(node, ()):
            if (win is not None and not mask & win) or edge in shut:
                continue
            cost = gone + step * factor.get(slice_, 1.0)
            est = cost + math.hypot(gx - vx, gy - vy) * rate
            if cost == math.inf or est > best + 1e-9:
                continue
            table = known if vtile == tile else beyond
            if cost == gone and v in table and table[v][0] == cost:
                continue  # a way of no cost does not take the place of an equal one: ways never lead in a circle
            if v == goal:
                best = min(best, cost)
            if _meet(table, v, [cost, edge, node, tile, est, v != goal, v == goal, vtile]) and vtile == tile and v != goal and est <= limit:
                heapq.heappush(heap, (est, cost, v))
    return [(node, row) for table in (known, beyond) for node, row in table.items() if not row[5] or row[4] <= best + 1e-9]


def _ways_to(ends: DataFrame, known: DataFrame, tasks: int) -> DataFrame:
    """(pair, cost, path) from each pair's start to its end: a round goes back through one tile, however long the way in it."""
    first = F.min(F.struct("cost", "edge", "tile", "node")).alias("b")
    heads = ends.groupBy("pair").agg(first).select("pair", F.when(F.col("b.edge").isNotNull(), F.col("b.tile")).alias("tile"), "b.node", "b.cost", F.expr("cast(array() as array<long>)").alias("path"))
    heads, found = written(heads, "heads"), []
    kinds = "pair long, tile long, node long, cost double, path array<long>"
    while True:
        found.append(heads.where("tile is null").select("pair", "cost", "path"))
        going = heads.where("tile is not null")
        if not (n := going.count()):
            break
        some = F.broadcast if n <= FEW_OPEN else large
        rows = known.join(some(going.select("pair", "tile")), ["pair", "tile"], "left_semi").select("pair", "tile", "node", "cost", "edge", "before", "origin")
        rows = going.unionByName(rows, allowMissingColumns=True).select("tile", "pair", "node", "cost", "edge", "before", "origin", "path")
        heads = written(rows.repartition(min(tasks, n), "tile").sortWithinPartitions("tile", "pair").mapInArrow(_back, kinds), "heads")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = []
    for (tile, pair), group in groupby(_rows(batches), itemgetter(0, 1)):
        known, head = {}, None
        for _, _, node, cost, edge, before, origin, path in group:
            if path is not None:
                head = node, cost, path
            else:
                _meet(known, node, [cost, edge, before, origin, 0.0, False])
        node, cost, path = head
        back, at = [], tile
        while at == tile and (edge := known[node][1]) is not None:
            node, at = known[node][2:4]
            back.append(edge)
            if len(back) > len(known):
                raise ValueError("a way leads in a circle")
        made.append((pair, None if at == tile else at, node, cost, back[::-1] + path))
    yield _batch(made, "pair long, tile long, node long, cost double, path array<long>")


def steps_of(routes: DataFrame, key: str = "route", edges: str = "edges") -> DataFrame:
    """(key, pos, edge_id): the edges of each route one by one."""
    return routes.select(key, F.posexplode(edges).alias("pos", "edge_id"))


def slice_share(a: DataFrame, b: DataFrame, lengths: DataFrame, key: list[str]) -> DataFrame:
    """(*key, share): the length of slices of a that b uses too, over a's length with repeats (1 m at least).

    a, b: (*key, edge_id) with a row for each use; lengths: edge_id, slice_id, length_m. A key of a without b has 0.
    """
    mine = a.join(large(lengths), "edge_id")
    theirs = b.join(large(lengths.select("edge_id", "slice_id")), "edge_id").select(*key, "slice_id").distinct().withColumn("_too", F.lit(True))
    each = mine.groupBy(*key, "slice_id").agg(F.min("length_m").alias("_m"), F.sum("length_m").alias("_all")).join(large(theirs), [*key, "slice_id"], "left")
    return each.groupBy(*key).agg((F.sum(F.when(F.col("_too"), F.col("_m")).otherwise(0.0)) / F.greatest(F.sum("_all"), F.lit(1.0))).alias("share"))


def broken(steps: DataFrame, edges: DataFrame, key: str = "route") -> DataFrame:
    """(key) of the routes that are not continuous or do not end where they begin."""
    along = Window.partitionBy(key).orderBy("pos")
    walked = steps.join(large(edges.select("edge_id", "u", "v")), "edge_id").withColumn("_gap", F.lead("u").over(along) != F.col("v"))
    ends = walked.groupBy(key).agg(F.max("_gap").alias("_gap"), F.min_by("u", "pos").alias("_a"), F.max_by("v", "pos").alias("_b"))
    return ends.where(F.coalesce("_gap", F.lit(False)) | (F.col("_a") != F.col("_b"))).select(key)
