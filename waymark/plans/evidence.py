"""Queries of lines beside lines and roads in scenery: customers are roads, their register records run beside most of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, linear, spatial
from .base import Tables, query, r6
from .matching import NET, roads

def _macros(sql: str) -> str:
    """@pd(x, y, ax, ay, bx, by), the squared distance of a point from a segment, and @side(...), written out."""
    forms = {
        "pd": "(pow({0} - {2} - greatest(0, least(1, (({0} - {2}) * ({4} - {2}) + ({1} - {3}) * ({5} - {3})) / (pow({4} - {2}, 2) + pow({5} - {3}, 2)))) * ({4} - {2}), 2) + pow({1} - {3} - greatest(0, least(1, (({0} - {2}) * ({4} - {2}) + ({1} - {3}) * ({5} - {3})) / (pow({4} - {2}, 2) + pow({5} - {3}, 2)))) * ({5} - {3}), 2))",
        "side": "(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))",
    }
    return re.sub(r"@(pd|side)\(([^()]*)\)", lambda m: forms[m[1]].format(*[a.strip() for a in m[2].split(",")]), sql)


#: A register line follows its road at an offset, reaches beyond it or ends before it, and half of them run against it.
REGISTER = """g AS (SELECT c_custkey AS id, k, c_custkey * 2 + k AS oid FROM customer, range(2) t(k) WHERE c_custkey % 3 > 0 AND (k = 0 OR c_custkey % 5 = 0)),
rec AS (SELECT oid, id, CAST((id + (CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END) + (CASE WHEN k = 1 AND id % 20 = 5 THEN 1 ELSE 0 END)) % 7 AS VARCHAR) AS road,
  CASE WHEN id % 13 = 0 THEN NULL ELSE [CAST(50 + 10 * (id % 4) AS INT), CAST(60 + (CASE WHEN k = 1 AND id % 10 = 0 THEN 10 ELSE 0 END) AS INT)] END AS value FROM g)"""


def register(t: Tables) -> DataFrame:
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    rows = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal", k).where("id % 3 > 0 and (k = 0 or id % 5 = 0)").withColumn("oid", F.col("id") * 2 + F.col("k"))
    at = rows.select("oid", "id", "k", "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("step")).withColumn("p", F.expr("if((id + k) % 2 = 0, step, 4 - step)"))
    x = F.col("c_acctbal") + 30 * F.col("p") + (F.col("id") * (F.col("p") + 3)) % 11 + F.when(F.col("p") == 0, -F.lit(10)).when(F.col("p") == 4, F.when(F.col("id") % 8 == 0, -25).otherwise(10)).otherwise(0)
    y = F.col("id") * 1.3 + (F.col("id") * (F.col("p") + 5)) % 23 + (F.col("id") + 3 * F.col("k")) % 17
    lines = linear.lines_of(at.select("oid", F.col("step").alias("seq"), x.alias("x"), y.alias("y")), "oid")
    road = (F.col("id") + F.when(F.col("id") % 11 == 0, 1).otherwise(0) + F.when((F.col("k") == 1) & (F.col("id") % 20 == 5), 1).otherwise(0)) % 7
    value = F.when(F.col("id") % 13 != 0, F.array((50 + 10 * (F.col("id") % 4)).cast("int"), (60 + F.when((F.col("k") == 1) & (F.col("id") % 10 == 0), 10).otherwise(0)).cast("int")))
    return rows.select("oid", road.cast("string").alias("road"), value.alias("value")).join(spatial.large(lines), "oid")


@query(_macros(f"""WITH {NET}, {REGISTER},
v AS (SELECT g.oid, step, CASE WHEN (g.id + k) % 2 = 0 THEN step ELSE 4 - step END AS p, g.id, k, c_acctbal FROM g JOIN customer ON c_custkey = g.id, range(5) s(step)),
w AS (SELECT oid, step, c_acctbal + 30 * p + (id * (p + 3)) % 11 + CASE p WHEN 0 THEN -10 WHEN 4 THEN CASE WHEN id % 8 = 0 THEN -25 ELSE 10 END ELSE 0 END AS x, id * 1.3::DOUBLE + (id * (p + 5)) % 23 + (id + 3 * k) % 17 AS y FROM v),
rs AS MATERIALIZED (SELECT *, sqrt(pow(dx - cx, 2) + pow(dy - cy, 2)) AS l, coalesce(sum(sqrt(pow(dx - cx, 2) + pow(dy - cy, 2))) OVER (PARTITION BY oid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0
  FROM (SELECT oid, step, x AS cx, y AS cy, lead(x) OVER w2 AS dx, lead(y) OVER w2 AS dy FROM w WINDOW w2 AS (PARTITION BY oid ORDER BY step)) WHERE dx IS NOT NULL),
ls AS MATERIALIZED (SELECT line AS id, seq, ax, ay, bx, b_y, m0, m1, len FROM seg WHERE kind = 'r'),
pr AS (SELECT ls.*, rs.*, ((ax - cx) * (dx - cx) + (ay - cy) * (dy - cy)) / l AS u, ((bx - ax) * (dx - cx) + (b_y - ay) * (dy - cy)) / l AS du, ((ax - cx) * (dy - cy) - (ay - cy) * (dx - cx)) / l AS w, ((bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx)) / l AS dw
  FROM ls JOIN rs ON greatest(cx, dx) >= least(ax, bx) - 12 AND least(cx, dx) <= greatest(ax, bx) + 12 AND greatest(cy, dy) >= least(ay, b_y) - 12 AND least(cy, dy) <= greatest(ay, b_y) + 12),
q AS (SELECT *, du * du + dw * dw AS aa, u * du + w * dw AS h0, u * u + w * w - 144 AS c0, (u - l) * du + w * dw AS h1, (u - l) * (u - l) + w * w - 144 AS c1 FROM pr),
cut AS (SELECT *, unnest([
   {{'f': greatest(CASE WHEN abs(du) < 1e-12 THEN CASE WHEN u BETWEEN 0 AND l THEN -1 ELSE 9 END ELSE least(-u / du, (l - u) / du) END, CASE WHEN abs(dw) < 1e-12 THEN CASE WHEN abs(w) <= 12 THEN -1 ELSE 9 END ELSE least((-12 - w) / dw, (12 - w) / dw) END, 0),
     'g': least(CASE WHEN abs(du) < 1e-12 THEN 9 ELSE greatest(-u / du, (l - u) / du) END, CASE WHEN abs(dw) < 1e-12 THEN 9 ELSE greatest((-12 - w) / dw, (12 - w) / dw) END, 1)}},
   {{'f': CASE WHEN h0 * h0 >= aa * c0 THEN greatest(0, (-h0 - sqrt(greatest(0, h0 * h0 - aa * c0))) / aa) ELSE 9 END, 'g': CASE WHEN h0 * h0 >= aa * c0 THEN least(1, (-h0 + sqrt(greatest(0, h0 * h0 - aa * c0))) / aa) ELSE -1 END}},
   {{'f': CASE WHEN h1 * h1 >= aa * c1 THEN greatest(0, (-h1 - sqrt(greatest(0, h1 * h1 - aa * c1))) / aa) ELSE 9 END, 'g': CASE WHEN h1 * h1 >= aa * c1 THEN least(1, (-h1 + sqrt(greatest(0, h1 * h1 - aa * c1))) / aa) ELSE -1 END}}]) AS s FROM q),
span AS (SELECT id, oid, m0 + s.f * (m1 - m0) AS a, m0 + s.g * (m1 - m0) AS b, len FROM cut WHERE s.f <= s.g),
cover AS (SELECT id, oid, sum(greatest(0, b - greatest(a, coalesce(before, -1)))) AS covered, any_value(len) AS len FROM (SELECT *, max(b) OVER (PARTITION BY id, oid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM span) GROUP BY id, oid HAVING covered >= 0.9 * any_value(len)),
ends AS (SELECT id, e, CASE e WHEN 0 THEN arg_min(ax, seq) ELSE arg_max(bx, seq) END AS x, CASE e WHEN 0 THEN arg_min(ay, seq) ELSE arg_max(b_y, seq) END AS y FROM ls, range(2) t(e) GROUP BY id, e),
foot AS (SELECT c.id, c.oid, e, n0 + t * l AS at FROM (SELECT c.id, c.oid, e.e, x, y, rs.cx, rs.cy, rs.dx, rs.dy, l, n0, step, greatest(0, least(1, ((x - cx) * (dx - cx) + (y - cy) * (dy - cy)) / (l * l))) AS t FROM cover c JOIN ends e USING (id) JOIN rs ON rs.oid = c.oid) c
  QUALIFY row_number() OVER (PARTITION BY c.id, c.oid, e ORDER BY sqrt(pow(x - cx - t * (dx - cx), 2) + pow(y - cy - t * (dy - cy), 2)), step) = 1),
gap AS (SELECT id, oid, sqrt(min(least(pd(ax, ay, cx, cy, dx, dy), pd(bx, b_y, cx, cy, dx, dy), pd(cx, cy, ax, ay, bx, b_y), pd(dx, dy, ax, ay, bx, b_y)) * (CASE WHEN side(ax, ay, bx, b_y, cx, cy) * side(ax, ay, bx, b_y, dx, dy) < 0 AND side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, b_y) < 0 THEN 0 ELSE 1 END))) AS distance FROM ls JOIN cover USING (id) JOIN rs USING (oid) GROUP BY id, oid),
ok AS (SELECT c.id, c.oid, CASE WHEN b.at < a.at THEN [value[2], value[1]] ELSE value END AS value, rec.road, distance FROM cover c JOIN rec ON rec.oid = c.oid JOIN foot a ON a.id = c.id AND a.oid = c.oid AND a.e = 0 JOIN foot b ON b.id = c.id AND b.oid = c.oid AND b.e = 1 JOIN gap ON gap.id = c.id AND gap.oid = c.oid
  WHERE value IS NOT NULL AND abs(b.at - a.at) >= 0.95 * c.len AND (c.id % 4 > 0 OR rec.road = CAST(c.id % 7 AS VARCHAR)))
SELECT id AS line_id, arg_min(oid, (round(distance, 9), oid)) AS oid, any_value(value)[1] AS forward, any_value(value)[2] AS backward, round(min(distance), 6) AS distance FROM ok GROUP BY id HAVING count(DISTINCT value) = 1 AND (id % 4 = 0 OR count(DISTINCT road) = 1)""".replace("pd(", "@pd(").replace("side(", "@side(")))
def register_on_roads(t: Tables) -> DataFrame:
    """The register's speeds for the roads that a record follows, with its number, direction and agreement."""
    _, lines = roads(t)
    refs = F.when(F.col("slice_id") % 4 == 0, F.array((F.col("slice_id") % 7).cast("string"))).otherwise(F.expr("cast(array() as array<string>)"))
    found = evidence.register_evidence(lines.select(F.col("slice_id").alias("line_id"), refs.alias("refs"), "pieces", "length"), register(t))
    return found.select("line_id", "oid", F.col("value")[0].alias("forward"), F.col("value")[1].alias("backward"), r6("distance").alias("distance"))


#: Woods: rectangles of 300 by 160 m with a glade, and small ones of 70 by 70 m.
WOODS = """wood AS (SELECT s_suppkey AS area, ring, x0, y0, w, h FROM (SELECT s_suppkey, s_acctbal AS x0, s_suppkey * 19.5::DOUBLE AS y0 FROM supplier), (VALUES (0, 0.0, 0.0, 300.0, 160.0), (1, 60.0, 50.0, 180.0, 60.0)) r(ring, ox, oy, w0, h0),
  LATERAL (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 70.0 ELSE w0 END AS w, CASE WHEN s_suppkey % 4 = 0 THEN 70.0 ELSE h0 END AS h) WHERE s_suppkey % 4 > 0 OR ring = 0),
edge AS (SELECT area, ring, unnest([{'ax': x0 + o, 'ay': y0 + p, 'bx': x0 + o + w, 'b_y': y0 + p}, {'ax': x0 + o + w, 'ay': y0 + p, 'bx': x0 + o + w, 'b_y': y0 + p + h}, {'ax': x0 + o + w, 'ay': y0 + p + h, 'bx': x0 + o, 'b_y': y0 + p + h}, {'ax': x0 + o, 'ay': y0 + p + h, 'bx': x0 + o, 'b_y': y0 + p}]) AS s FROM wood, LATERAL (SELECT ring * 60.0 AS o, ring * 50.0 AS p) WHERE area % 4 > 0)"""


@query(f"""WITH {NET}, {WOODS},
probe AS MATERIALIZED (SELECT slice_id AS edge_id, seq, x, y FROM r WHERE seq IN (1, 2, 3)),
near AS (SELECT DISTINCT edge_id, seq FROM (SELECT *, pow(x - s.ax - t * (s.bx - s.ax), 2) + pow(y - s.ay - t * (s.b_y - s.ay), 2) AS d2 FROM (SELECT *, greatest(0, least(1, ((x - s.ax) * (s.bx - s.ax) + (y - s.ay) * (s.b_y - s.ay)) / (pow(s.bx - s.ax, 2) + pow(s.b_y - s.ay, 2)))) AS t FROM probe JOIN edge ON x BETWEEN least(s.ax, s.bx) - 40 AND greatest(s.ax, s.bx) + 40 AND y BETWEEN least(s.ay, s.b_y) - 40 AND greatest(s.ay, s.b_y) + 40)) WHERE d2 <= 1600),
inside AS (SELECT edge_id, seq FROM probe JOIN edge ON (s.ay > y) <> (s.b_y > y) AND x < (s.bx - s.ax) * (y - s.ay) / (s.b_y - s.ay) + s.ax GROUP BY edge_id, seq, area HAVING count(*) % 2 = 1),
hit AS (SELECT edge_id, seq FROM near UNION SELECT edge_id, seq FROM inside)
SELECT c_custkey AS edge_id, round(count(seq) / 3.0, 6) AS share FROM customer LEFT JOIN hit ON edge_id = c_custkey GROUP BY c_custkey""")
def roads_in_scenery(t: Tables) -> DataFrame:
    """The share of each road's three probes in or beside woods with glades; small woods do not count."""
    _, lines = roads(t)
    ends = F.transform("pieces", lambda g: F.struct(g["ax"].alias("x"), g["ay"].alias("y")))
    last = F.element_at("pieces", -1)
    edges = lines.select(F.col("slice_id").alias("edge_id"), F.concat(ends, F.array(F.struct(last["bx"].alias("x"), last["by"].alias("y")))).alias("vertices"))
    small = F.col("s_suppkey") % 4 == 0
    rings = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x0"), (F.col("s_suppkey") * 19.5).alias("y0"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ring")).where(~small | (F.col("ring") == 0))
    w, h = F.when(small, 70.0).when(F.col("ring") == 0, 300.0).otherwise(180.0), F.when(small, 70.0).when(F.col("ring") == 0, 160.0).otherwise(60.0)
    rings = rings.withColumns({"x0": F.col("x0") + 60 * F.col("ring"), "y0": F.col("y0") + 50 * F.col("ring"), "w": w, "h": h})
    corners = F.array(*[F.struct((F.col("x0") + i * F.col("w")).alias("x"), (F.col("y0") + j * F.col("h")).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    points = rings.select(F.struct(F.col("s_suppkey").alias("area"), "ring").alias("key"), F.posexplode(corners).alias("seq", "_p")).select("key", "seq", "_p.x", "_p.y")
    return evidence.scenery_share(edges, linear.lines_of(points, "key").select("key.area", "key.ring", "pieces")).select("edge_id", r6("share").alias("share"))
