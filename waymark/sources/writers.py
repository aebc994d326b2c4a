"""Writing results: tracks, links, documents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gpx(name: Column, line: Column) -> Column:
    """A GPX 1.1 track of all vertices; line: array<struct<lon, lat>>."""
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    dots = F.transform(line, lambda p: F.format_string('<trkpt lat="%s" lon="%s"/>', p["lat"].cast("string"), p["lon"].cast("string")))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="waymark" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'),
        escape(name), F.lit("</name><trkseg>"), F.array_join(dots, ""), F.lit("</trkseg></trk></gpx>"),
    )


def file_name(name: Column, most: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', " "), r"\s+", " ")), 1, most)


def spread(values: Column, n: int) -> Column:
    """Up to n elements at even index distances, both ends among them."""
    last = F.size(values) - 1
    at = F.transform(F.sequence(F.lit(0), F.least(F.lit(n - 1), last)), lambda i: F.floor(i * last / F.greatest(F.least(F.lit(n - 1), last), F.lit(1))).cast("int"))
    return F.transform(F.array_distinct(at), lambda i: F.element_at(values, i + 1))


def maps_link(line: Column, stops: int = 8) -> Column:
    """A link for navigation that begins and ends at the line's start, with evenly spaced stops."""
    place = lambda p: F.concat(F.round(p["lat"], 5).cast("string"), F.lit(","), F.round(p["lon"], 5).cast("string"))
    home, points = place(F.element_at(line, 1)), F.transform(spread(line, stops), place)
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&travelmode=driving&origin="), F.url_encode(home), F.lit("&destination="), F.url_encode(home), F.lit("&waypoints="), F.url_encode(F.array_join(points, "|")))


def documents(rows: DataFrame, path: str) -> None:
    """One JSON document for each row; Spark's commit makes the whole write appear at once."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def sprint_report(sprints: DataFrame, home: str, within_km: float = 100.0, most: int = 50) -> DataFrame:
    """Lines of a Markdown table of the nearest sprints."""
    near = sprints.withColumn("_d", F.col("distance_km")[home]).where(F.col("_d") <= within_km).orderBy("_d", F.desc("fun_km"), "id").limit(most)
    return near.select(F.format_string("| %s | %s km | %s | %s km |", "name", F.col("km").cast("string"), F.col("fun").cast("string"), F.col("_d").cast("string")).alias("line"))


def published_name(content: Column, stem: str) -> Column:
    """A file name with the content's hash in it."""
    return F.concat(F.lit(f"{stem}-"), F.substring(F.sha2(content, 256), 1, 16), F.lit(".json"))
