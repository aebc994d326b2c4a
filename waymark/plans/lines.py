"""Queries over lines: a user's events in order of time are a line with a point every 150 m and the value as y."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roads
from ..operators import sequence
from ..rubric import RUBRIC
from ..storage import written
from .base import Tables, query, r6

POINTS = """points AS (
  SELECT user_id AS line, seq, 150.0 * (seq - 1) AS x, value AS y, event_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events))"""
PLACED = (
    POINTS
    + """, stepped AS (
  SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step_m FROM points WINDOW w AS (PARTITION BY line ORDER BY seq)),
placed AS (SELECT *, sum(step_m) OVER (PARTITION BY line ORDER BY seq) AS s FROM stepped)"""
)
CURVINESS = "CASE WHEN v <= 0 THEN 0.0 WHEN v <= 60 THEN v * 0.25 / 60 WHEN v <= 120 THEN 0.25 + (v - 60) * 0.25 / 60 WHEN v <= 220 THEN 0.5 + (v - 120) * 0.25 / 100 WHEN v <= 350 THEN 0.75 + (v - 220) * 0.25 / 130 ELSE 1.0 END"


def points(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("seq", F.row_number().over(order).cast("long"))
    return rows.select(F.col("user_id").alias("line"), "seq", (150.0 * (F.col("seq") - 1)).alias("x"), F.col("value").alias("y"), "event_id", "event_type")


@query(f"""WITH {PLACED}, turned AS (
  SELECT *, abs(CASE WHEN d - floor(d / (2 * pi())) * 2 * pi() IS NULL THEN NULL ELSE d - floor(d / (2 * pi())) * 2 * pi() - pi() END) AS turn FROM (
    SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) - atan2(y - lag(y) OVER w, x - lag(x) OVER w) + pi() AS d FROM placed WINDOW w AS (PARTITION BY line ORDER BY seq))),
summed AS (SELECT line, max(s) AS length_m, coalesce(sum(degrees(turn)), 0) AS turn_deg FROM turned GROUP BY line),
scored AS (SELECT *, turn_deg / greatest(length_m / 1000, 1e-4) AS v FROM summed)
SELECT line, round(length_m, 6) AS length_m, round(turn_deg, 6) AS turn_deg, round(v, 6) AS turn_per_km, round({CURVINESS}, 6) AS score,
  row_number() OVER (ORDER BY round({CURVINESS}, 6) DESC, line) AS rank FROM scored""")
def polyline_twistiness(t: Tables) -> DataFrame:
    """Lines ranked by turning per km on the rubric's scale."""
    turned = sequence.turn_angle(sequence.running_distance(points(t)))
    lines = turned.groupBy("line").agg(F.max("s").alias("length_m"), F.coalesce(F.sum(F.abs(F.degrees("turn"))), F.lit(0.0)).alias("turn_deg"))
    lines = lines.withColumn("v", F.col("turn_deg") / F.greatest(F.col("length_m") / 1000, F.lit(1e-4)))
    lines = lines.withColumn("score", r6(roads.piecewise(RUBRIC["anchors"]["curviness"], F.col("v"))))
    # one row for each line: the rank is the report's order
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "line"))
    return lines.select("line", r6("length_m").alias("length_m"), r6("turn_deg").alias("turn_deg"), r6("v").alias("turn_per_km"), "score", rank.cast("long").alias("rank"))


@query(f"""WITH {POINTS}, legs AS (
  SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, seq, round(coalesce(2 * ((x - x0) * (y2 - y) - (y - y0) * (x2 - x)) / (sqrt(pow(x - x0, 2) + pow(y - y0, 2)) * sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) * sqrt(pow(x2 - x0, 2) + pow(y2 - y0, 2))), 0), 8) AS curvature FROM legs""")
def polyline_curvature(t: Tables) -> DataFrame:
    """Signed three-point curvature of every point."""
    return sequence.curvature(points(t)).select("line", "seq", F.round("curvature", 8).alias("curvature"))


@query(f"""WITH {POINTS}, framed AS (
  SELECT line, seq, y, row_number() OVER w AS pos, count(*) OVER (PARTITION BY line) AS n, sum(y) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS total,
    first_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
  FROM points WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, seq, round(CASE WHEN n < 3 THEN y ELSE (total + greatest(0, 3 - pos) * f + greatest(0, 2 - (n - pos)) * l) / 5 END, 6) AS smoothed FROM framed""")
def polyline_smooth(t: Tables) -> DataFrame:
    """Five-sample centred mean with repeated ends."""
    return sequence.smooth(points(t), "y", "smoothed").select("line", "seq", r6("smoothed").alias("smoothed"))


@query(f"""WITH {POINTS}, hit AS (SELECT line, seq, seq - lag(seq) OVER (PARTITION BY line ORDER BY seq) AS gap FROM points WHERE y > 50),
runs AS (SELECT line, seq, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY seq) AS run FROM hit)
SELECT line, CAST(run AS BIGINT) AS run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows FROM runs GROUP BY line, run""")
def polyline_islands(t: Tables) -> DataFrame:
    """Runs of values over 50 with one other sample allowed inside."""
    return sequence.islands(points(t), F.col("y") > 50, gap=1).withColumn("run", F.col("run").cast("long"))


@query(f"""WITH {PLACED}, ends AS (SELECT line, max(s) AS total, greatest(floor(max(s) / 100) + 1, 2) AS n FROM placed GROUP BY line HAVING max(s) > 0),
samples AS (SELECT line, total, n, unnest(range(CAST(n AS BIGINT))) AS k FROM ends),
spots AS (SELECT line, k, k * (total / (n - 1)) AS s0, total FROM samples),
pieces AS (SELECT line, seq, s, x, y, lag(s) OVER w AS ps, lag(x) OVER w AS px, lag(y) OVER w AS py FROM placed WINDOW w AS (PARTITION BY line ORDER BY seq)),
matched AS (SELECT a.line, a.k, a.s0, p.*, row_number() OVER (PARTITION BY a.line, a.k ORDER BY p.seq) AS nth FROM spots a JOIN pieces p ON p.line = a.line AND p.ps IS NOT NULL AND a.s0 <= p.s + 1e-7 AND a.s0 >= p.ps - 1e-7)
SELECT line, k, round(s0, 4) AS s, round(px + (s0 - ps) / (s - ps) * (x - px), 4) AS x, round(py + (s0 - ps) / (s - ps) * (y - py), 4) AS y FROM matched WHERE nth = 1""")
def resample_interpolate(t: Tables) -> DataFrame:
    """Lines resampled evenly, at most 100 m apart."""
    return sequence.resample(points(t), 100.0).select("line", "k", *[F.round(c, 4).alias(c) for c in ("s", "x", "y")])


@query(f"""WITH {PLACED}, hidden AS (SELECT line, seq, s, CASE WHEN event_id % 3 <> 0 THEN y END AS v FROM placed),
near AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN s END IGNORE NULLS) OVER b AS s0, last_value(v IGNORE NULLS) OVER b AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN s END IGNORE NULLS) OVER f AS s1, first_value(v IGNORE NULLS) OVER f AS v1 FROM hidden
  WINDOW b AS (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY line ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT line, seq, round(coalesce(v, CASE WHEN s1 > s0 THEN v0 + (s - s0) / (s1 - s0) * (v1 - v0) END, v0, v1), 6) AS filled FROM near""")
def gap_interpolation(t: Tables) -> DataFrame:
    """Values of every third event, filled in between their neighbours along the line."""
    hidden = sequence.running_distance(points(t)).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("y")))
    return sequence.fill_gaps(hidden, "v", "filled").select("line", "seq", r6("filled").alias("filled"))


@query(f"""WITH {PLACED}, sm AS (
  SELECT line, seq, s, n, pos, CASE WHEN n < 3 THEN y ELSE (total + greatest(0, 3 - pos) * f + greatest(0, 2 - (n - pos)) * l) / 5 END AS z FROM (
    SELECT line, seq, s, y, row_number() OVER w AS pos, count(*) OVER (PARTITION BY line) AS n, sum(y) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS total,
      first_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
    FROM placed WINDOW w AS (PARTITION BY line ORDER BY seq)) WHERE n >= 2),
d AS (SELECT *, z - lag(z) OVER w AS dz, s - lag(s) OVER w AS h FROM sm WINDOW w AS (PARTITION BY line ORDER BY seq)),
k AS (SELECT line, greatest(1, CAST(round_even(100 / greatest(median(h), 1e-6), 0) AS INT)) AS k FROM d GROUP BY line),
j AS (SELECT d.*, e.z AS z2, e.s AS s2 FROM d JOIN k USING (line) LEFT JOIN d e ON e.line = d.line AND e.pos = d.pos + least(k.k, d.n - 1))
SELECT line, round(coalesce(sum(CASE WHEN dz > 0 THEN dz END), 0), 4) AS climb_m, round(coalesce(sum(CASE WHEN dz < 0 THEN -dz END), 0), 4) AS descent_m,
  round(max(CASE WHEN s2 > s THEN abs(z2 - z) / (s2 - s) * 100 ELSE 0 END), 4) AS max_grade FROM j GROUP BY line""")
def polyline_smooth_grade(t: Tables) -> DataFrame:
    """Climb, descent and greatest grade of each line, its values taken as heights."""
    placed = sequence.running_distance(points(t)).withColumn("z", F.col("y"))
    return sequence.grade_stats(placed, "z").select("line", *[F.round(c, 4).alias(c) for c in ("climb_m", "descent_m", "max_grade")])


@query(f"""WITH {POINTS}, named AS (SELECT line, x, y, least(CAST(floor((seq - 1) * 8 / greatest(n, 1)) AS BIGINT), 7) AS chunk, event_type FROM (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM points))
SELECT line, chunk, count(*) AS points, round(avg(y), 6) AS mean_y, round(median(y), 6) AS median_y, round(sum(y) / sum(sum(y)) OVER (PARTITION BY line), 6) AS share FROM named GROUP BY line, chunk""")
def profile_chunks(t: Tables) -> DataFrame:
    """Eight equal parts of each line: mean, median and share of the line's total."""
    n = F.count(F.lit(1)).over(Window.partitionBy("line"))
    chunked = points(t).withColumn("chunk", F.least(F.floor((F.col("seq") - 1) * 8 / F.greatest(n, F.lit(1))), F.lit(7)).cast("long"))
    parts = chunked.groupBy("line", "chunk").agg(F.count(F.lit(1)).alias("points"), F.avg("y").alias("mean_y"), F.median("y").alias("median_y"), F.sum("y").alias("_sum"))
    share = F.col("_sum") / F.sum("_sum").over(Window.partitionBy("line"))
    return parts.select("line", "chunk", "points", r6("mean_y").alias("mean_y"), r6("median_y").alias("median_y"), r6(share).alias("share"))


@query(f"""WITH {PLACED}, mix AS (SELECT line, event_type, sum(step_m) AS m FROM placed GROUP BY line, event_type)
SELECT line, event_type, round(m / greatest(sum(m) OVER (PARTITION BY line), 1e-9), 6) AS share FROM mix""")
def limit_mix(t: Tables) -> DataFrame:
    """Share of each line's length by kind of event."""
    mix = sequence.running_distance(points(t)).groupBy("line", "event_type").agg(F.sum("step_m").alias("_m"))
    whole = F.greatest(F.sum("_m").over(Window.partitionBy("line")), F.lit(1e-9))
    return mix.select("line", "event_type", r6(F.col("_m") / whole).alias("share"))


@query(f"""WITH {POINTS}, w AS (SELECT line, seq, y, sum(y) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM points)
SELECT line, seq, max_so_far FROM (SELECT line, seq, round(max(y) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS max_so_far FROM points)""")
def running_maximum(t: Tables) -> DataFrame:
    """The greatest value before each point."""
    before = Window.partitionBy("line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return points(t).select("line", "seq", r6(F.max("y").over(before)).alias("max_so_far"))


@query(None)
def corner_features(t: Tables) -> DataFrame:
    """Corners of each line and their shares of esses and straights (folds over runs: tested on closed forms)."""
    placed = sequence.running_distance(points(t))
    corners = written(sequence.detect_corners(sequence.resample(points(t), 10.0)), "corners")
    lines = placed.groupBy("line").agg(F.max("s").alias("length_m"))
    counted = corners.groupBy("line").agg(F.count(F.lit(1)).alias("n_corners"), r6(F.sum("heading")).alias("heading"), r6(F.min("radius")).alias("min_radius"))
    out = lines.join(counted, "line", "left").join(sequence.esses_share(corners), "line", "left").join(sequence.straight_share(lines, corners), "line")
    return out.select("line", r6("length_m").alias("length_m"), F.coalesce("n_corners", F.lit(0)).alias("n_corners"), "heading", "min_radius", r6(F.coalesce("esses", F.lit(0.0))).alias("esses"), r6("straight_share").alias("straight_share"))
