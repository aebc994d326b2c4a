"""Queries of heights: customers are places on a ground of many raster tiles, written as GeoTIFF and read again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rasters
from ..sources import geotiff
from .base import Tables, query

TILE, CELLS = 1000.0, 50


def tiles(places: DataFrame) -> DataFrame:
    """A tile of 20 m cells around every place that has one; tiles whose numbers add up to a multiple of 7 are missing."""

    @F.pandas_udf("binary")
    def made(tx: pd.Series, ty: pd.Series) -> pd.Series:
        def one(a: int, b: int) -> bytes:
            column, row = np.meshgrid(np.arange(CELLS), np.arange(CELLS))
            number = (a * CELLS + column) * 3 + (b * CELLS + CELLS - 1 - row) * 7  # cells counted from the south-west of the whole ground
            z = (number % 101).astype(np.float32)
            z[number % 211 == 0] = np.nan
            return geotiff.encode(geotiff.Tile(z, a * TILE, (b + 1) * TILE, TILE / CELLS, TILE / CELLS, 28992), predictor=1 + (a + b) % 3)

        return pd.Series([one(a, b) for a, b in zip(tx, ty, strict=True)])

    keys = places.select(rasters.tile_of(F.col("x"), F.col("y"), TILE).alias("t")).distinct().select("t.*").where("pmod(tx + ty, 7) <> 0")
    return keys.withColumn("content", made("tx", "ty"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal + 5000 AS x, c_custkey * 1.3::DOUBLE + 0.25 AS y FROM customer),
t AS (SELECT *, CAST(floor(x / 1000) AS BIGINT) AS tx, CAST(floor(y / 1000) AS BIGINT) AS ty FROM p),
g AS (SELECT *, greatest(0, least(49, (x - tx * 1000) / 20 - 0.5)) AS u, greatest(0, least(49, ((ty + 1) * 1000 - y) / 20 - 0.5)) AS v FROM t),
c AS (SELECT *, CAST(least(floor(u) + i, 49) AS BIGINT) AS cc, CAST(least(floor(v) + j, 49) AS BIGINT) AS rr, (CASE i WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END) * (CASE j WHEN 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END) AS w FROM g, range(2) a(i), range(2) b(j)),
n AS (SELECT *, (tx * 50 + cc) * 3 + (ty * 50 + 49 - rr) * 7 AS number FROM c)
SELECT c_custkey, CASE WHEN ((any_value(tx + ty) % 7) + 7) % 7 > 0 AND count(*) FILTER (number % 211 = 0) = 0 THEN round(sum(w * (number % 101)), 4) END AS z FROM n GROUP BY c_custkey""")
def heights_of_places(t: Tables) -> DataFrame:
    """Heights from tiles of all three predictors, null on missing tiles and beside gaps."""
    places = t.customer.select("c_custkey", (F.col("c_acctbal") + 5000).alias("x"), (F.col("c_custkey") * 1.3 + 0.25).alias("y"))
    return rasters.sample_tiles(places, tiles(places), TILE, 28992).select("c_custkey", F.round("z", 4).alias("z"))
