"""Heights of points from many raster tiles: points and tiles are dealt together, and a task decodes each of its tiles once.

A tile's row comes before its points in the sorted stream, so a task holds one decoded tile and one batch of points. A
tile with very many points is dealt to several tasks, each with its own copy of the tile; no cell becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import geotiff
from ..storage import written
from . import sequence

#: Points of one tile that one task takes.
POINTS = 1 << 20


def tile_of(x: Column, y: Column, tile_m: float) -> Column:
    return F.struct(F.floor(x / tile_m).cast("long").alias("tx"), F.floor(y / tile_m).cast("long").alias("ty"))


def read_tiles(spark, path: str, name: str = r"(-?\d+)_(-?\d+)\.tiff?$") -> DataFrame:
    """(tx, ty, content) of tile files whose names end in their numbers; others are left out."""
    files = spark.read.format("binaryFile").load(path)
    number = lambda i: F.regexp_extract("path", name, i)
    return files.where(number(1) != "").select(number(1).cast("long").alias("tx"), number(2).cast("long").alias("ty"), "content")


def sample_tiles(points: DataFrame, tiles: DataFrame, tile_m: float, epsg: int | None = None) -> DataFrame:
    """points (x, y, ...) with z, null where no tile is, outside of it, and beside a gap.

    tiles: tx, ty, content (GeoTIFF; one row for each tile). A point belongs to the tile at its floor.
    """
    columns = points.columns
    placed = points.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_p"), tile_of(F.col("x"), F.col("y"), tile_m).alias("_t"), "x", "y")
    full = placed.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).select("_t", F.ceil(F.col("_n") / POINTS).cast("int").alias("_parts"))
    many = full.where("_parts > 1")  # at most a tile for every POINTS points
    mine = placed.join(many, "_t", "left").withColumn("_part", F.pmod(F.xxhash64("x", "y", "_p"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    named = tiles.select(F.struct(F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty")).alias("_t"), "content")
    theirs = named.join(full, "_t").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    kind = points.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_p")).schema["_p"].dataType.simpleString()
    nothing = F.lit(None)
    stream = mine.select("_t", "_part", F.lit(1).alias("_kind"), "x", "y", "_p", nothing.cast("binary").alias("content")).unionByName(
        theirs.select("_t", "_part", F.lit(0).alias("_kind"), nothing.cast("double").alias("x"), nothing.cast("double").alias("y"), nothing.cast(kind).alias("_p"), "content")
    )
    dealt = stream.repartition("_t", "_part").sortWithinPartitions("_t", "_part", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at = None, None
        for batch in batches:
            place, kinds = batch.column(0), batch.column(2).to_numpy()
            tx, ty = place.field(0).to_numpy(), place.field(1).to_numpy()
            x, y = (batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (3, 4))
            z = np.full(len(kinds), np.nan)
            new = np.flatnonzero((np.diff(tx, prepend=np.nan) != 0) | (np.diff(ty, prepend=np.nan) != 0) | (kinds == 0))
            for lo, hi in zip(new, [*new[1:], len(kinds)], strict=True):
                key = (int(tx[lo]), int(ty[lo]))
                if kinds[lo] == 0:
                    tile, at = geotiff.decode(batch.column(6)[lo].as_py(), epsg), key
                if at == key and tile is not None:
                    some = slice(lo + (kinds[lo] == 0), hi)
                    z[some] = tile.sample(x[some], y[some])
            mine = kinds == 1
            yield pa.RecordBatch.from_arrays([batch.column(5).filter(pa.array(mine)), pa.array(z[mine], from_pandas=True)], names=["_p", "z"])

    return dealt.mapInArrow(run, f"_p {kind}, z double").select("_p.*", "z")


def edge_elevation(vertices: DataFrame, edges: DataFrame, tiles: DataFrame, tile_m: float, step: float = 10.0, epsg: int | None = None) -> DataFrame:
    """(edge_id, climb_m, descent_m, max_grade, elev_start, elev_ok) of directed edges from the heights along their slices.

    vertices: slice_id, seq, x, y; edges: edge_id, slice_id, rev, raised (bridge or tunnel: its inside is no ground, so a
    straight line between the slice's ends stands for it). Each slice is sampled once; for the other direction climb and
    descent change places. elev_start is the slice's least height. Slices without two heights have zeros and elev_ok 0.
    """
    raised = edges.groupBy("slice_id").agg(F.max("raised").alias("_raised"))
    line = vertices.withColumnRenamed("slice_id", "line")
    placed = sequence.resample(line, step).withColumnRenamed("k", "seq")
    known = written(sample_tiles(placed, tiles, tile_m, epsg), "heights")
    least = known.groupBy("line").agg(F.min("z").alias("elev_start"), F.max("seq").alias("_last"))
    ground = known.join(least, "line").join(raised.withColumnRenamed("slice_id", "line"), "line").withColumn("_inside", F.col("_raised") & (F.col("seq") > 0) & (F.col("seq") < F.col("_last")))
    repaired = sequence.repair_flagged(ground, "z", "_inside", "_z")
    stats = sequence.grade_stats(repaired.select("line", "seq", "s", "_z").withColumnRenamed("_z", "z"), "z").join(least.select("line", "elev_start"), "line")
    both = edges.join(stats.withColumnRenamed("line", "slice_id"), "slice_id", "left")
    up, down = F.coalesce("climb_m", F.lit(0.0)), F.coalesce("descent_m", F.lit(0.0))
    return both.select(
        "edge_id", F.when(F.col("rev"), down).otherwise(up).alias("climb_m"), F.when(F.col("rev"), up).otherwise(down).alias("descent_m"),
        F.coalesce("max_grade", F.lit(0.0)).alias("max_grade"), "elev_start", F.col("climb_m").isNotNull().cast("int").alias("elev_ok"),
    )
