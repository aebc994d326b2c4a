"""Reading the inputs: every reader is a Spark scan with a fixed schema, so filters and columns reach the source."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import geopackage


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, size and SHA-256 of every input file."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("fetched_at"))


def drifted(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded files that are missing or have another checksum."""
    return recorded.join(found.select("file", "sha256"), ["file", "sha256"], "left_anti")


def newest(listing: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """The entry of the latest day-month-year that the pattern's three groups give."""
    part = lambda i: F.regexp_extract(column, pattern, i).cast("int")
    dated = listing.where(F.col(column).rlike(pattern)).withColumn("_day", F.struct(part(3).alias("y"), part(2).alias("m"), part(1).alias("d")))
    return dated.agg(F.max_by(column, "_day").alias("entry"))


def signs(spark: SparkSession, path: str, codes: list[str], camera: str = r"(?i)camera|flits|snelheidscontrole|trajectcontrole") -> DataFrame:
    """Placed traffic signs of the wanted codes or with a camera's text; rows without finite coordinates go."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    x, y = F.col("rdX").try_cast("double"), F.col("rdY").try_cast("double")
    wanted = F.upper("rvvCode").isin([c.upper() for c in codes]) | F.coalesce(F.col("textSigns").rlike(camera), F.lit(False))
    placed = (F.col("status") == "PLACED") & (F.coalesce("removedOn", F.lit("")) == "") & wanted
    finite = x.isNotNull() & y.isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return rows.where(placed & finite).select(F.col("rvvCode").alias("code"), x.alias("x"), y.alias("y"), F.col("bearing").try_cast("double").alias("bearing"), F.col("drivingDirection").alias("direction"), F.col("textSigns").alias("text"), "blackCode", "zoneCode")


def speed_rows(rows: DataFrame, lanes: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Official speed rows with a limit, of the wanted lanes, whose box meets the given one (range filters push down)."""
    kept = rows.where(F.col("MAXSHD").isNotNull() & F.col("BST_CODE").isin(lanes))
    if box:
        west, south, east, north = box
        kept = kept.where((F.col("min_x") <= east) & (F.col("max_x") >= west) & (F.col("min_y") <= north) & (F.col("max_y") >= south))
    return kept


def population(rows: DataFrame, column: str) -> DataFrame:
    """Grid cells with negative codes as no people."""
    return rows.withColumn("population", F.greatest(F.col(column), F.lit(0)))


def register_pages(spark: SparkSession, path: str, hits: int | None = None) -> DataFrame:
    """Features of overlapping pages, one of each id; pages that differ about an id, or a wrong number, raise."""
    pages = spark.read.option("multiLine", True).json(path)
    features = pages.select(F.explode("features").alias("f")).select(F.col("f.properties.oid").alias("oid"), F.to_json("f").alias("feature"))
    by = features.groupBy("oid").agg(F.countDistinct("feature").alias("_kinds"), F.min("feature").alias("feature"))
    odd, n = by.agg(F.coalesce(F.sum((F.col("_kinds") > 1).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    if odd or (hits is not None and n != hits):
        raise ValueError(f"{odd} features differ between pages; {n} features, {hits} expected")
    return by.drop("_kinds")


def wkb_line(blob: str) -> Column:
    """Vertices of a line in WKB, or in a GeoPackage blob around it."""
    return geopackage.line(F.col(blob))


def npy_tiles(spark: SparkSession, path: str, tile: Column) -> DataFrame:
    """Cells (tile, row, col, z) of raster tiles kept as NPY files, row 0 in the north."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("struct<width:long,z:array<float>>")
    def cells(content: pd.Series) -> pd.DataFrame:
        grids = [np.load(io.BytesIO(raw), allow_pickle=False) for raw in content]
        return pd.DataFrame({"width": [g.shape[1] for g in grids], "z": [g.astype(np.float32).ravel() for g in grids]})

    flat = files.select(tile.alias("tile"), cells("content").alias("_g")).select("tile", "_g.width", F.posexplode("_g.z").alias("_at", "z"))
    return flat.select("tile", F.expr("_at div width").alias("row"), (F.col("_at") % F.col("width")).alias("col"), F.nanvl("z", F.lit(None).cast("float")).alias("z"))


def split_ways(ways: DataFrame) -> DataFrame:
    """Pieces of ways between junctions: way, piece, refs, xy. ways: way, refs array, xy array<struct<x,y>>.

    A node that two uses share, also inside one way, is a junction and ends one piece and begins the next.
    """
    nodes = ways.select("way", F.posexplode(F.arrays_zip(F.col("refs").alias("ref"), F.col("xy").alias("p"))).alias("pos", "n")).select("way", "pos", F.col("n.ref").alias("ref"), F.col("n.p").alias("p"))
    shared = nodes.groupBy("ref").agg(F.count(F.lit(1)).alias("_uses")).where("_uses >= 2").select("ref", F.lit(True).alias("_cut"))
    order = Window.partitionBy("way").orderBy("pos")
    marked = nodes.join(shared, "ref", "left").withColumn("_last", F.max("pos").over(Window.partitionBy("way")))
    cut = (F.coalesce("_cut", F.lit(False)) & (F.col("pos") > 0) & (F.col("pos") < F.col("_last"))).cast("int")
    numbered = marked.withColumn("_c", cut).withColumn("piece", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = numbered.withColumn("piece", F.explode(F.when(F.col("_c") == 1, F.array(F.col("piece") - 1, "piece")).otherwise(F.array("piece"))))
    packed = both.groupBy("way", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "p"))).alias("_n"))
    return packed.select("way", "piece", F.col("_n.ref").alias("refs"), F.col("_n.p").alias("xy")).where(F.size("refs") >= 2)


def catalogue_documents(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of one list of a catalogue document; rows that do not fit the schema are null in `row` and kept aside."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{field}"), "array<string>")).alias("item"))
    return items.select(F.from_json("item", schema, {"mode": "PERMISSIVE"}).alias("row"), "item")
