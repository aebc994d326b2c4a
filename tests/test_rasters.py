"""GeoTIFF round trips, heights across tile edges, and edges' climbs on a ramp."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import rasters
from waymark.sources import geotiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("deflate", [True, False])
def test_round_trip(order, predictor, deflate):
    z = np.random.default_rng(predictor).normal(3, 40, (37, 23)).astype(np.float32)
    z[5, 6] = z[36, 0] = np.nan
    tile = geotiff.Tile(z, 1000.0, 5000.0, 20.0, 25.0, 28992)
    got = geotiff.decode(geotiff.encode(tile, predictor, deflate, order=order), 28992)
    assert np.array_equal(got.z, z, equal_nan=True) and (got.x0, got.y_top, got.dx, got.dy, got.epsg) == (1000.0, 5000.0, 20.0, 25.0, 28992)


def test_what_is_not_read():
    good = geotiff.encode(geotiff.Tile(np.zeros((4, 4), np.float32), 0.0, 0.0, 1.0, 1.0, 3301))
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.decode(b"GIF89a..")
    with pytest.raises(ValueError, match="3301 in place of 28992"):
        geotiff.decode(good, 28992)
    huge = geotiff.decode(geotiff.encode(geotiff.Tile(np.full((2, 2), 3.4e38, np.float32), 0.0, 0.0, 1.0, 1.0), nodata=None))
    assert np.isnan(huge.z).all()


def ramp(tx, ty, tile_m=5000.0, n=250, gap=None):
    """z = x / 1000 + y / 500 at the cells' centres."""
    side = tile_m / n
    column, row = np.meshgrid(np.arange(n), np.arange(n))
    z = (0.001 * (tx * tile_m + (column + 0.5) * side) + 0.002 * ((ty + 1) * tile_m - (row + 0.5) * side)).astype(np.float32)
    if gap:
        z[gap] = np.nan
    return tx, ty, geotiff.encode(geotiff.Tile(z, tx * tile_m, (ty + 1) * tile_m, side, side))


def test_heights_on_a_ramp(spark, monkeypatch):
    monkeypatch.setattr(rasters, "POINTS", 40)  # a tile with more points goes to several tasks
    tiles = spark.createDataFrame([ramp(20, 98), ramp(21, 98), ramp(20, 97, gap=(0, 10))], "tx long, ty long, content binary")
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(100_020, 109_980, 300), rng.uniform(490_020, 494_980, 300)))]
    rows += [(900, 105_000.0, 492_000.0), (901, 104_999.9, 492_000.0), (902, 99_000.0, 492_000.0), (903, 100_210.0, 489_990.0), (904, 100_500.0, 489_000.0)]
    df = spark.createDataFrame(rows, "p long, x double, y double").selectExpr("*", "1 as content", "2 as z0")
    got = {r["p"]: r["z"] for r in rasters.sample_tiles(df, tiles, 5000.0).collect()}
    assert len(got) == len(rows) and got[902] is None and got[903] is None  # no tile; beside a gap
    for p, x, y in rows:
        if p not in (902, 903):
            near = min(x % 5000, 5000 - x % 5000, y % 5000, 5000 - y % 5000) < 10  # the outermost half cell is flat
            assert got[p] == pytest.approx(0.001 * x + 0.002 * y, abs=0.035 if near else 1e-3)
    assert rasters.sample_tiles(df.where("false"), tiles, 5000.0).collect() == []


def test_tiles_are_read_by_name(spark, tmp_path):
    for tx, ty in ((20, 98), (-1, 3)):
        (tmp_path / f"dtm_{tx}_{ty}.tif").write_bytes(ramp(tx, ty, n=10)[2])
    (tmp_path / "notes.txt").write_text("no tile")
    got = rasters.read_tiles(spark, str(tmp_path)).collect()
    assert {(r["tx"], r["ty"]) for r in got} == {(20, 98), (-1, 3)}


def test_climbs_of_edges(spark):
    tiles = spark.createDataFrame([ramp(20, 98), ramp(21, 98)], "tx long, ty long, content binary")
    lines = {0: [(102_000, 492_000), (103_000, 492_000), (104_000, 493_000)], 1: [(101_000, 491_000), (101_000, 492_000)], 2: [(10, 10), (500, 10)]}
    vertices = spark.createDataFrame([(s, k, float(x), float(y)) for s, line in lines.items() for k, (x, y) in enumerate(line)], "slice_id long, seq int, x double, y double")
    edges = spark.createDataFrame([(0, 0, False, False), (1, 0, True, False), (2, 1, True, True), (3, 2, False, False)], "edge_id long, slice_id long, rev boolean, raised boolean")
    got = {r["edge_id"]: r for r in rasters.edge_elevation(vertices, edges, tiles, 5000.0).collect()}
    rise = 0.001 * 2000 + 0.002 * 1000
    assert got[0]["climb_m"] == pytest.approx(rise, abs=0.2) and got[0]["descent_m"] == pytest.approx(0.0, abs=0.01)
    assert got[1]["climb_m"] == got[0]["descent_m"] and got[1]["descent_m"] == got[0]["climb_m"] and got[1]["elev_ok"] == 1
    assert got[0]["max_grade"] == pytest.approx(100 * 0.003 / math.sqrt(2), abs=0.02) and got[0]["elev_start"] == pytest.approx(102 + 984, abs=0.01)
    assert got[2]["descent_m"] == pytest.approx(2.0, abs=0.1)
    assert (got[3]["climb_m"], got[3]["max_grade"], got[3]["elev_ok"], got[3]["elev_start"]) == (0.0, 0.0, 0, None)
