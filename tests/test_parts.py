"""Rules and operators of the catalogue on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from waymark.functions import browse, roads
from waymark.operators import route_parts, spatial


@pytest.mark.parametrize(
    ("tags", "ways", "want"),
    [
        ({"maxspeed": "90"}, (True, True), (90, 90)), ({"maxspeed": "200"}, (True, True), (0, 0)), ({"maxspeed": "walk", "source:maxspeed": "EE:urban"}, (True, True), (0, 0)),
        ({"source:maxspeed": "EE:rural"}, (True, True), (90, 90)), ({"maxspeed:type": "EE:urban"}, (True, True), (50, 50)), ({}, (True, True), (0, 0)),
        ({"maxspeed": "70", "maxspeed:forward": "50"}, (True, True), (50, 70)), ({"maxspeed": "70", "maxspeed:backward": "30"}, (True, False), (70, 70)),
        ({"maxspeed": "70", "maxspeed:backward": "30"}, (False, True), (30, 30)),
    ],
)
def test_mapped_speeds(spark, tags, ways, want):
    df = spark.createDataFrame([(tags, *ways)], "tags map<string,string>, f boolean, b boolean")
    assert tuple(df.select(*browse.mapped_speeds(F.col("tags"), F.col("f"), F.col("b"))).first()) == want


def test_shown_values(spark):
    one = spark.createDataFrame([(3.14159, 12.0, 12.34, 0.256, 1234567, datetime.date(2026, 3, 9), None)], "a double, b double, c double, s double, n long, d date, e date")
    got = one.select(*[browse.shown_km(F.col(c)) for c in "abc"], browse.shown_share(F.col("s")), browse.shown_count(F.col("n"), "road"), browse.shown_date(F.col("d")), browse.shown_date(F.col("e"))).first()
    assert tuple(got) == ("3.1 km", "12 km", "12.3 km", "26%", "1,234,567 roads", "9 March 2026", "unknown date")


def test_keys(spark):
    rows = spark.createDataFrame([("circuit:a", "nl"), ("ee:circuit:a", "ee"), ("ee:circuit:a", "nl"), ("other:a", "nl"), ("circuit:a", "ee")], "k string, c string")
    assert [r[0] for r in rows.select(browse.belongs_to(F.col("k"), F.col("c"))).collect()] == [True, True, False, False, False]
    names = spark.createDataFrame([("Děčín — Łódź",), (" Õismäe ",), ("Žižkov",)], "n string")
    assert [r[0] for r in names.select(roads.road_key(F.col("n"))).collect()] == ["decin → łodz", "oismae", "zizkov"]


def test_raster_has_no_value_outside(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row long, col long, z double")
    points = spark.createDataFrame([(0, 1.5, 1.5), (1, 0.0, 0.0), (2, 3.0, 3.0), (3, 3.1, 1.0), (4, 1.0, -0.1)], "i int, x double, y double")
    assert {r["i"]: r["z"] for r in spatial.bilinear(points, cells, 1.0, 3, 3).collect()} == {0: 11.0, 1: 0.0, 2: 22.0, 3: None, 4: None}


def test_points_along_a_line(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.0, 3.0), (2, 0, 5.0, 5.0), (3, 0, 1.0, 1.0), (3, 1, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "line int, seq int, lon double, lat double")
    for fraction, lat in ((0.0, 0.0), (1 / 3, 1.0), (0.5, 1.5), (1.0, 3.0), (2.0, 3.0)):
        got = {r["line"]: (r["lon"], r["lat"]) for r in route_parts.point_at_fraction(points, fraction).collect()}
        assert got[1] == pytest.approx((0.0, lat), abs=1e-6) and got[2] == (5.0, 5.0) and got[3] == (1.0, 1.0)


def test_densities_of_nothing(spark):
    none = spark.createDataFrame([], "x double, y double, kind int")
    asked = spark.createDataFrame([(1, 2.0, 3.0)], "i int, x double, y double")
    assert route_parts.kind_density(none, asked, [1], 10.0).first()["density"] == 0
