"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of their key; a keyed Feistel network permutes the numbers, walking on while it lands
beyond the last row. The permuted number p gives shard p mod n and slot p div n, so counts are at most one apart, slots
have no gaps, and both the place of a row and the row of a place are computed, not looked up.

Numbers come from range-partitioned narrow rows (no text moves): position inside the partition plus the rows of the
partitions before it. The numbered rows are written first, so that both reads see the same partitions.

Defined cases: a null text has size 1 and CRC 0; rows that tie in every narrow column are interchangeable; null keys
come first; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROUNDS = 6


class Permutation:
    """A keyed bijection of 0 .. rows-1."""

    def __init__(self, rows: int, seed: int = 1):
        self.rows = rows
        self.half = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64) for i in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & np.uint64((1 << self.half) - 1)
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return left << half | right

    def __call__(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._network(np.asarray(numbers).astype(np.uint64), back)
        while (beyond := x >= self.rows).any():
            x[beyond] = self._network(x[beyond], back)
        return x.astype(np.int64)


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """df (narrow rows) with `row_number` from 0 in the given order, without a single task or a second sort."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = written(placed, "numbered")
    # one row for each partition
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("row_number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row under the law `rows`."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = df.select(F.col(key), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = numbered(narrow, [key, "text_crc32", "size"])
    total = rows.count()

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(Permutation(total, seed)(number.to_numpy()))

    return rows.withColumn("_place", permuted("row_number")).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
