"""Report tables: each is a small aggregate of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_mix(edges: DataFrame, source: str = "speed_source") -> DataFrame:
    """Edges and their share by source of the speed."""
    by = edges.groupBy(source).agg(F.count(F.lit(1)).alias("edges"))
    return by.withColumn("share", F.col("edges") / F.sum("edges").over(Window.partitionBy()))  # one row for each source


def disagreements(edges: DataFrame, limit: int = 12) -> DataFrame:
    """The edges whose official and tagged limits differ most, ties by the lesser id."""
    gap = F.abs(F.col("official") - F.col("tagged"))
    return edges.where("official > 0 and tagged > 0 and official <> tagged").withColumn("gap", gap).orderBy(F.desc("gap"), "edge_id").limit(limit)


def confidence(edges: DataFrame, column: str = "confidence") -> DataFrame:
    """Mean, median and share above .8 of matched edges."""
    return edges.where(F.col(column) > 0).agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.avg((F.col(column) > 0.8).cast("double")).alias("above_08"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(column)


def coverage(features: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with and without a value, by column."""
    counts = features.agg(F.count(F.lit(1)).alias("all"), *[F.count(c).alias(c) for c in columns])
    return counts.select("all", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("known")) for c in columns])).alias("c")).select("c.column", "c.known", (F.col("all") - F.col("c.known")).alias("missing"))
