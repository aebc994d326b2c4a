"""Queries of route profiles: a customer's line items, in order, are the edges of a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import profiles
from ..operators.spatial import large
from .base import Tables, query

STEPS = """step AS MATERIALIZED (SELECT o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_quantity * 26.371::DOUBLE AS length_m, l_discount * 10 AS fun, 30 + 10 * ((l_linenumber + l_partkey) % 11) AS legal_speed, l_tax * 3977.7::DOUBLE + l_partkey % 13 * 1.37::DOUBLE AS head_per_km, l_partkey AS part, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ends AS MATERIALIZED (SELECT *, sum(length_m) OVER (PARTITION BY route ORDER BY pos) AS e, sum(length_m) OVER (PARTITION BY route ORDER BY pos) - length_m AS s, max(pos) OVER (PARTITION BY route) AS last FROM step)"""


def steps(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t.lineitem.join(large(t.orders), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("route"), (F.row_number().over(order) - 1).alias("pos"), (F.col("l_quantity") * 26.371).alias("length_m"), (F.col("l_discount") * 10).alias("fun"),
        (30 + 10 * ((F.col("l_linenumber") + F.col("l_partkey")) % 11)).alias("legal_speed"), (F.col("l_tax") * 3977.7 + F.col("l_partkey") % 13 * 1.37).alias("head_per_km"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
    )


@query(f"""WITH {STEPS},
tot AS (SELECT route, max(e) AS total, max(last) AS last, CAST(greatest(8, least(40, round_even(max(e) / 1000 / 1.5, 0))) AS INT) AS n FROM ends GROUP BY route),
b AS (SELECT route, k, n, last, total, CASE k WHEN n THEN total ELSE k * (total / n) END AS bnd FROM tot, range(41) g(k) WHERE k <= n),
idx AS (SELECT b.route, k, n, any_value(b.last) AS last, any_value(total) AS total, count(*) FILTER (round(s, 6) < round(bnd, 6)) + (CASE WHEN round(any_value(total), 6) < round(any_value(bnd), 6) THEN 1 ELSE 0 END) AS i FROM b JOIN ends USING (route) GROUP BY b.route, k, n),
span AS (SELECT route, k AS part, total, least(i, last) AS i0, greatest(least(i, last), least(nxt - 1, last)) AS i1 FROM (SELECT *, lead(i) OVER (PARTITION BY route ORDER BY k) AS nxt FROM idx) WHERE k < n),
st AS (SELECT p.route, p.part, any_value(total) AS total, any_value(i0) AS i0, any_value(i1) AS i1, sum(fun * length_m) / sum(length_m) AS fun, sum(head_per_km * length_m) / sum(length_m) AS head, median(legal_speed) AS lim, min(s) AS at0, max(s) AS at1 FROM span p JOIN ends e ON e.route = p.route AND pos BETWEEN i0 AND i1 GROUP BY p.route, p.part)
SELECT route, CAST(part AS INT) AS part, CAST(round_even(round(at0 * (99 / total), 9), 0) AS BIGINT) AS i0, CAST(round_even(round(at1 * (99 / total), 9), 0) AS BIGINT) AS i1, CAST(round_even(round(fun * 100, 9), 0) AS INT) AS fun, CAST(round_even(lim, 0) AS INT) AS lim, CAST(round_even(least(lim, 130), 0) AS INT) AS v, round(at0 / 1000, 2) AS km, round(least(head / 350, 1), 2) AS head FROM st""")
def route_profiles(t: Tables) -> DataFrame:
    """Parts of each route of equal distance: fun, median limit, turning."""
    rows = steps(t)
    points = t.orders.select(F.col("o_custkey").alias("route")).distinct().withColumn("n_points", F.lit(100))
    return profiles.route_profile(rows, points)


@query(f"""WITH {STEPS}, pt AS (SELECT route, pos AS seq, s, CASE WHEN part % 9 > 0 THEN part % 80 / 4.3::DOUBLE END AS z, last, sum(length_m) OVER (PARTITION BY route) - 0 AS whole FROM ends),
n AS (SELECT route, last, max(s) AS total, CAST(greatest(8, least(60, round_even(max(s) / 1000 / 1.5, 0))) AS INT) AS n FROM pt WHERE last >= 1 GROUP BY route, last),
a AS (SELECT route, nth, last, nth * (last / (n - 1)) AS bnd FROM n, range(60) g(nth) WHERE nth < n),
f AS (SELECT *, least(CAST(floor(bnd) AS BIGINT), last) AS i, bnd - least(CAST(floor(bnd) AS BIGINT), last) AS f FROM a),
z AS (SELECT f.route, nth, CASE WHEN i = f.last THEN p.s ELSE p.s * (1 - f.f) + q.s * f.f END AS s, CASE WHEN i = f.last THEN p.z ELSE p.z * (1 - f.f) + q.z * f.f END AS z FROM f JOIN pt p ON p.route = f.route AND p.seq = i LEFT JOIN pt q ON q.route = f.route AND q.seq = i + 1),
m AS (SELECT route, median(z) AS m FROM z GROUP BY route HAVING m IS NOT NULL)
SELECT route, CAST(nth AS INT) AS nth, round(s / 1000, 2) AS km, round(coalesce(z, m), 1) AS z FROM z JOIN m USING (route)""")
def height_profiles(t: Tables) -> DataFrame:
    """Heights at evenly numbered places of each route, gaps filled by the median."""
    along = F.sum("length_m").over(Window.partitionBy("route").orderBy("pos")) - F.col("length_m")
    height = F.when(F.col("part") % 9 > 0, (F.col("part") % 80) / 4.3)
    return profiles.height_profile(steps(t).select("route", F.col("pos").alias("seq"), along.alias("s"), height.alias("z")))


@query(f"""WITH {STEPS}, c AS (SELECT p_partkey AS corner, p_partkey AS edge_id, p_size * 2.0 AS s, p_retailprice / 10 AS radius, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS sign, p_size + 0.5 AS speed FROM part WHERE p_size % 3 > 0),
o AS (SELECT route, c.*, row_number() OVER (PARTITION BY route ORDER BY corner) AS nth FROM (SELECT DISTINCT route, part FROM step) r JOIN c ON edge_id = part),
p AS (SELECT *, CASE WHEN edge_id % 2 = 1 THEN 4 - s / 110.0 * 4 ELSE s / 110.0 * 4 END AS bnd FROM o WHERE nth <= 24),
q AS (SELECT *, greatest(0, least(floor(bnd), 4)) AS i FROM p)
SELECT route, nth, round((edge_id % 50 * 10 + 25 * i) * (1 - (bnd - i)) + (edge_id % 50 * 10 + 25 * least(i + 1, 4)) * (bnd - i), 5) AS x, round((edge_id % 70 + (i * 3) % 7) * (1 - (bnd - i)) + (edge_id % 70 + (least(i + 1, 4) * 3) % 7) * (bnd - i), 5) AS y, CAST(round_even(radius, 0) AS INT) AS r, CASE WHEN sign > 0 THEN 'L' ELSE 'R' END AS dir, CAST(round_even(speed, 0) AS INT) AS v FROM q""")
def corners_on_routes(t: Tables) -> DataFrame:
    """The first two dozen engaged corners of each route, placed on their slices."""
    corners = t.part.select(F.col("p_partkey").alias("corner"), F.col("p_partkey").alias("edge_id"), (F.col("p_size") * 2.0).alias("s"), (F.col("p_retailprice") / 10).alias("radius"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("sign"), (F.col("p_size") + 0.5).alias("speed"), (F.col("p_size") % 3 > 0).alias("engaged"))
    edges = t.part.select(F.col("p_partkey").alias("edge_id"), F.col("p_partkey").alias("slice_id"), (F.col("p_partkey") % 2 == 1).alias("rev"), F.lit(110.0).alias("length_m"))
    vertices = edges.select("slice_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq")).select("slice_id", "seq", (F.col("slice_id") % 50 * 10.0 + 25 * F.col("seq")).alias("x"), (F.col("slice_id") % 70 + (F.col("seq") * 3) % 7).cast("double").alias("y"))
    found = profiles.corner_markers(steps(t).select("route", F.col("part").alias("edge_id")), corners, edges, vertices)
    return found.select("route", "nth", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "r", "dir", "v")
