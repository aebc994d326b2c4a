"""The catalogue: reasons, facets, orders, search, overlap and checks over route rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roads import road_key

# Cells of the overlap raster, in degrees.
CELL_LON, CELL_LAT = 0.0009, 0.0006


def reasons(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order: why a row is not among the results. None: it matches."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def facets(rows: DataFrame, kind: str, without_kind: Column) -> DataFrame:
    """Matches by kind and for all kinds, whatever kind is selected: one pass, as grouping sets."""
    return rows.where(F.size(without_kind) == 0).rollup(kind).agg(F.count(F.lit(1)).alias("matches")).withColumn(kind, F.coalesce(kind, F.lit("all")))


def search(entries: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """The best `limit` of entries (label, kind, count): exact, prefix, word prefix, anywhere; areas before roads."""
    q = road_key(F.lit(text))
    key = road_key(F.col("label"))
    starts = F.exists(F.split(key, r"[\s-]+"), lambda w: w.startswith(q))
    rank = F.when(key == q, 0).when(key.startswith(q), 1).when(starts, 2).when(F.contains(key, q), 3)
    order = [F.col("rank"), F.when(F.col("kind") == "area", 0).otherwise(1), F.desc("count"), F.col("label")]
    found = entries.withColumn("rank", rank).where((F.length(q) >= 2) & F.col("rank").isNotNull()).orderBy(*order).limit(limit)
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # `limit` rows


def top_per_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def overlaps(lines: DataFrame, least: float = 0.2) -> DataFrame:
    """(route, circuit, share): vertices of a route within a cell of a circuit's line. lines: key, is_circuit, seq, lon, lat."""
    w = Window.partitionBy("key").orderBy("seq")
    circuits = lines.where("is_circuit").withColumn("_x", F.lag("lon").over(w)).withColumn("_y", F.lag("lat").over(w)).where("_x is not null")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lon") - F.col("_x")) / CELL_LON, F.abs(F.col("lat") - F.col("_y")) / CELL_LAT) * 2)).cast("int")
    drawn = circuits.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("_i") / F.col("_n")
    cells = drawn.select(F.col("key").alias("circuit"), F.floor(at("_x", "lon") / CELL_LON).alias("cx"), F.floor(at("_y", "lat") / CELL_LAT).alias("cy")).distinct()
    near = F.sequence(F.lit(-1), F.lit(1))
    others = lines.where("not is_circuit").withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("key")))
    probes = others.select(F.col("key").alias("route"), "seq", "_len", F.explode(F.flatten(F.transform(near, lambda dx: F.transform(near, lambda dy: F.struct((F.floor(F.col("lon") / CELL_LON) + dx).alias("cx"), (F.floor(F.col("lat") / CELL_LAT) + dy).alias("cy")))))).alias("_c"))
    hits = probes.select("route", "seq", "_len", "_c.cx", "_c.cy").join(cells, ["cx", "cy"])
    shares = hits.groupBy("route", "circuit").agg((F.countDistinct("seq") / F.first("_len")).alias("share"))
    return shares.where(F.col("share") >= least)


def set_signature(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def quarantine(rows: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their problems."""
    marked = rows.withColumn("problems", problems)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)
