"""Queries that match records to roads: customers are two-way roads of five vertices, parts are official speed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import linear
from .base import Tables, query, r6


def _vertices(rows: DataFrame, key: str, x: Column, y: Column, step: float, n: int, bend: int) -> DataFrame:
    """n vertices for each row, `step` apart and bent by the key."""
    k = F.col("seq")
    at = rows.select(key, x.alias("_x"), y.alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("seq"))
    return at.select(key, "seq", (F.col("_x") + step * k + (F.col(key) * (k + 3)) % 11).alias("x"), (F.col("_y") + (F.col(key) * (k + 5)) % bend).alias("y"))


def _names(key: str) -> Column:
    return F.when(F.col(key) % 4 > 0, F.concat(F.lit("road"), (F.col(key) % 6).cast("string")))


def roads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Edges in both directions (reversed: the second of a slice) and the slices' lines."""
    slices = t.customer.select(F.col("c_custkey").alias("slice_id"), "c_acctbal")
    lines = linear.lines_of(_vertices(slices, "slice_id", F.col("c_acctbal"), F.col("slice_id") * 1.3, 30.0, 5, 23), "slice_id")
    ways = F.explode(F.array(F.lit(False), F.lit(True))).alias("reversed")
    edges = slices.select("slice_id", ways).select((F.col("slice_id") * 2 + F.col("reversed").cast("int")).alias("edge_id"), "slice_id", "reversed", _names("slice_id").alias("name"))
    return edges, lines


def records(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.part.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 1000).alias("wvk"), ((F.col("p_size") % 6) * 10).alias("speed"), (F.col("p_partkey") % 3 - 1).cast("int").alias("direction"), ((F.col("p_partkey") % 6) / 5.0).alias("reliability"), _names("p_partkey").alias("name"))
    x, y = (F.col("row_id") * 7919) % 11000 - 1000, F.col("row_id") * 0.975
    return rows, linear.lines_of(_vertices(rows, "row_id", x, y, 40.0, 4, 13), "row_id")


NET = """r AS (SELECT c_custkey AS slice_id, seq, c_acctbal + 30 * seq + (c_custkey * (seq + 3)) % 11 AS x, c_custkey * 1.3::DOUBLE + (c_custkey * (seq + 5)) % 23 AS y FROM customer, range(5) g(seq)),
o AS (SELECT p_partkey AS row_id, seq, (p_partkey * 7919) % 11000 - 1000 + 40.0::DOUBLE * seq + (p_partkey * (seq + 3)) % 11 AS x, p_partkey * 0.975::DOUBLE + (p_partkey * (seq + 5)) % 13 AS y FROM part, range(4) g(seq)),
seg AS MATERIALIZED (SELECT *, coalesce(lag(m1) OVER (PARTITION BY kind, line ORDER BY seq), 0) AS m0, max(m1) OVER (PARTITION BY kind, line) AS len FROM (SELECT *, sum(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2))) OVER (PARTITION BY kind, line ORDER BY seq) AS m1 FROM (
  SELECT kind, line, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM (SELECT 'r' AS kind, slice_id AS line, seq, x, y FROM r UNION ALL SELECT 'o', row_id, seq, x, y FROM o) WINDOW w AS (PARTITION BY kind, line ORDER BY seq)) WHERE bx IS NOT NULL))"""


def _placed(asked: str, kind: str, s: str, keys: str) -> str:
    """SQL of (keys, x, y) at distance s along the line `id` of each row of asked."""
    return f"""SELECT {keys}, ax + t * (bx - ax) AS x, ay + t * (b_y - ay) AS y FROM (SELECT {keys}, ax, ay, bx, b_y, greatest(0, least(1, (q.{s} - m0) / (m1 - m0))) AS t FROM {asked} q JOIN seg ON seg.kind = '{kind}' AND seg.line = q.id AND m1 >= q.{s} - 1e-9 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq) = 1)"""


def _tangents(asked: str, kind: str, keys: str) -> str:
    """SQL of (keys, tx, ty): unit tangents at s over 5 m either way; rows of asked hold id, s, len."""
    ends = f"(SELECT *, greatest(0, least(len, s + (CASE e WHEN 0 THEN -1 ELSE 1 END) * least(5, len / 2))) AS se FROM {asked}, range(2) g(e))"
    placed = _placed(ends, kind, "se", f"{keys}, e")
    return f"SELECT {keys}, dx / sqrt(dx * dx + dy * dy) AS tx, dy / sqrt(dx * dx + dy * dy) AS ty FROM (SELECT {keys}, max(CASE e WHEN 1 THEN x END) - max(CASE e WHEN 0 THEN x END) AS dx, max(CASE e WHEN 1 THEN y END) - max(CASE e WHEN 0 THEN y END) AS dy FROM ({placed}) GROUP BY {keys})"


FOOT = "greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2))))"
BOX = "x BETWEEN least(ax, bx) - 25 AND greatest(ax, bx) + 25 AND y BETWEEN least(ay, b_y) - 25 AND greatest(ay, b_y) + 25"


def _near(points: str, kind: str, keys: str) -> str:
    """SQL of (keys, id, distance, s, len): lines within 25 of points, with the nearest position along them."""
    return f"""SELECT {keys}, line AS id, distance, s, len FROM (SELECT *, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2)) AS distance, m0 + t * (m1 - m0) AS s FROM (SELECT q.*, seg.*, {FOOT} AS t FROM {points} q JOIN seg ON seg.kind = '{kind}' AND {BOX})) WHERE distance <= 25 QUALIFY row_number() OVER (PARTITION BY {keys}, line ORDER BY distance, seq) = 1"""


@query(f"""WITH {NET},
edge AS (SELECT c_custkey * 2 + rev AS edge_id, c_custkey AS id, rev, CASE WHEN c_custkey % 4 > 0 THEN 'road' || (c_custkey % 6) END AS name FROM customer, range(2) g(rev)),
ask AS MATERIALIZED (SELECT edge_id, edge.id, name, rev, sample, (CASE rev WHEN 1 THEN 1 - f ELSE f END) * len AS s, len FROM edge JOIN (SELECT DISTINCT line, len FROM seg WHERE kind = 'r') l ON l.line = edge.id, (VALUES (0, 0.25::DOUBLE), (1, 0.5), (2, 0.75)) v(sample, f)),
pt AS MATERIALIZED ({_placed('ask', 'r', 's', 'edge_id, sample')}),
tan AS MATERIALIZED ({_tangents('ask', 'r', 'edge_id, sample')}),
near AS MATERIALIZED ({_near('pt', 'o', 'edge_id, sample')}),
utan AS MATERIALIZED ({_tangents('near', 'o', 'edge_id, sample, id')}),
met AS (SELECT n.edge_id, n.sample, n.id AS row_id, n.distance, p.p_partkey % 1000 AS wvk, (p.p_size % 6) * 10 AS speed, (p.p_partkey % 6) / 5.0 AS reliability, (CASE rev WHEN 1 THEN -1 ELSE 1 END) * (t.tx * u.tx + t.ty * u.ty) AS c, p.p_partkey % 3 - 1 AS direction,
  CASE WHEN a.name IS NULL OR p.p_partkey % 4 = 0 THEN 1 WHEN a.name = 'road' || (p.p_partkey % 6) THEN 2 ELSE 0 END AS state
  FROM near n JOIN tan t USING (edge_id, sample) JOIN utan u USING (edge_id, sample, id) JOIN ask a USING (edge_id, sample) JOIN part p ON p.p_partkey = n.id),
good AS (SELECT *, abs(c) AS co, CAST(state + 1 AS DOUBLE) AS weight FROM met WHERE speed > 0 AND abs(c) >= cos(radians(40)) AND (direction = 0 OR (direction > 0) = (c >= 0))),
head AS (SELECT *, sum(weight) OVER (PARTITION BY edge_id, speed) AS votes, sum(weight) OVER (PARTITION BY edge_id) AS total FROM good QUALIFY row_number() OVER (PARTITION BY edge_id, speed ORDER BY distance, wvk, row_id, sample) = 1),
won AS (SELECT *, 1 - distance / 25 AS d, 1 - least(degrees(acos(least(1, co))), 40) / 40 AS h, CASE state WHEN 0 THEN 0.15 WHEN 1 THEN 0.5 ELSE 1.0 END AS n, votes / total AS v FROM head QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY votes DESC, distance, wvk, row_id) = 1)
SELECT edge_id, CAST(speed AS INT) AS speed, row_id, votes, round(d, 6) AS distance_part, round(h, 6) AS heading_part, round(n::DOUBLE, 6) AS name_part, round(reliability, 6) AS reliability_part, round(v, 6) AS votes_part, round(0.35 * d + 0.25 * h + 0.2 * n + 0.1 * reliability + 0.1 * v, 6) AS confidence FROM won""")
def official_speeds(t: Tables) -> DataFrame:
    """The official speed of each directed road by three samples, heading, direction and name, with its confidence."""
    found = linear.match_speeds(*roads(t), *records(t))
    parts = ["distance_part", "heading_part", "name_part", "reliability_part", "votes_part", "confidence"]
    return found.select("edge_id", "speed", "row_id", "votes", *[r6(p).alias(p) for p in parts])


SIGN = "SELECT s_suppkey * 100 + k AS sign_id, s_acctbal + 20 * k AS x, (s_suppkey * 100 + k) * 0.195::DOUBLE AS y, CASE WHEN (s_suppkey + k) % 5 > 0 THEN CAST((s_suppkey * 71 + k * 31) % 360 AS DOUBLE) END AS bearing FROM supplier, range(100) g(k)"


@query(f"""WITH {NET}, sign AS MATERIALIZED ({SIGN}),
near AS MATERIALIZED ({_near('sign', 'r', 'sign_id')}),
best AS MATERIALIZED (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY distance, id) = 1),
t AS ({_tangents('best', 'r', 'sign_id, id')}),
way AS (SELECT sign_id, id * 2 + rev AS edge_id, distance, bearing, abs((((bearing - degrees(atan2(tx, ty)) - 180 * rev + 180) % 360) + 360) % 360 - 180) AS off FROM best JOIN t USING (sign_id, id) JOIN sign USING (sign_id), range(2) g(rev))
SELECT sign_id, edge_id, round(distance, 6) AS distance, round(off, 5) AS off FROM way QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY coalesce(off, 0), edge_id) = 1 AND (bearing IS NULL OR off <= 60)""")
def signs_to_edges(t: Tables) -> DataFrame:
    """The directed road that each sign stands for, by nearness and by the bearing it faces."""
    k = F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")
    signs = t.supplier.select("s_suppkey", "s_acctbal", k).select(
        (F.col("s_suppkey") * 100 + F.col("k")).alias("sign_id"), (F.col("s_acctbal") + 20 * F.col("k")).alias("x"), ((F.col("s_suppkey") * 100 + F.col("k")) * 0.195).alias("y"),
        F.when((F.col("s_suppkey") + F.col("k")) % 5 > 0, ((F.col("s_suppkey") * 71 + F.col("k") * 31) % 360).cast("double")).alias("bearing"),
    )
    return linear.match_signs(signs, *roads(t)).select("sign_id", "edge_id", r6("distance").alias("distance"), F.round("off", 5).alias("off"))
