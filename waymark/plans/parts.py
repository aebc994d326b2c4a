"""Queries on parts of routes and on the catalogue: orders are routes, their lines the steps, customers and suppliers places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import browse
from ..operators import route_parts
from .base import Tables, query, r6
from .space import PLACES, customers, suppliers

STEPS = """steps AS (SELECT l_orderkey AS route, l_linenumber AS seq, l_suppkey AS edge_id, CASE WHEN l_suppkey % 7 > 0 THEN 'road ' || l_partkey % 4 END AS name, round(l_discount * 100)::DOUBLE / 8 AS fun,
  CAST(l_quantity AS DOUBLE) * 10 AS length_m, CAST(round(l_tax * 100) AS BIGINT) AS n FROM lineitem)"""


def steps(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("edge_id"), F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("road "), (F.col("l_partkey") % 4).cast("string"))).alias("name"),
        (F.round(F.col("l_discount") * 100).cast("double") / 8).alias("fun"), (F.col("l_quantity").cast("double") * 10).alias("length_m"), F.round(F.col("l_tax") * 100).cast("long").alias("n"),
    )


@query(f"""WITH {STEPS}, g AS (SELECT route, name, sum(fun * length_m) AS f, sum(length_m) AS m FROM steps WHERE name IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY f DESC, name) AS place FROM g)
SELECT route, CAST(place AS INT) AS place, name, round(m / 1000, 1) AS km, CAST(round(100 * f / greatest(m, 1e-9)) AS INT) AS fun FROM r WHERE place <= 3""")
def route_road_names(t: Tables) -> DataFrame:
    """The three named roads with most fun on each route."""
    return route_parts.route_roads(steps(t))


@query(f"""WITH {STEPS} SELECT route, CAST(sum(n % 3) AS BIGINT) AS tight, CAST(sum(n) AS BIGINT) AS sweet, CAST(sum(n // 2) AS BIGINT) AS flowing FROM steps GROUP BY route""")
def corner_counts(t: Tables) -> DataFrame:
    """Corners of three kinds on each route."""
    return route_parts.corner_totals(steps(t).selectExpr("route", "n % 3 as n_hairpin", "n as n_sweet", "n div 2 as n_flowing"))


@query(f"""WITH {STEPS}, m AS (SELECT route, seq, edge_id, 'camera' AS kind FROM steps WHERE edge_id % 3 = 0 UNION ALL SELECT route, seq, edge_id, 'bump' FROM steps WHERE n >= 2
  UNION ALL SELECT route, seq, edge_id, 'cyclists' FROM steps WHERE fun > 0.65),
w AS (SELECT *, row_number() OVER (PARTITION BY route, kind ORDER BY seq, edge_id) AS nth, count(*) OVER (PARTITION BY route, kind) AS total FROM m)
SELECT route, kind, CAST(nth AS INT) AS nth, edge_id FROM w WHERE CASE WHEN kind = 'cyclists' THEN nth = total // 2 + 1 ELSE nth <= 4 END""")
def warnings_on_routes(t: Tables) -> DataFrame:
    """First cameras and bumps and the middle busy edge of each route."""
    marked = steps(t).select("route", "seq", "edge_id", (F.col("edge_id") % 3 == 0).cast("int").alias("cameras"), F.col("n").alias("bumps"), F.col("fun").alias("cyclists"))
    return route_parts.route_warnings(marked)


@query("""SELECT l_orderkey AS route, l_returnflag AS note, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def notes_by_text(t: Tables) -> DataFrame:
    """Notes of each route by text: how many, and where the first stands."""
    return route_parts.grouped_notes(t.lineitem.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("note")))


@query("""WITH n AS (SELECT l_orderkey AS route, l_linenumber AS pos, p_type AS name, lower(trim(p_type)) AS key FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT key, arg_min(name, route * 1000 + pos) AS label, count(DISTINCT route) AS count FROM n GROUP BY key""")
def road_search_index(t: Tables) -> DataFrame:
    """Names on routes by their key, as first seen, with the number of routes."""
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return route_parts.road_index(named.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos"), F.col("p_type").alias("name")))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AS out_and_back, CAST(round(o_totalprice / 1000) AS BIGINT) AS fun_km, CAST(o_orderpriority[1:1] AS INT) AS score, o_custkey % 25 AS area, o_custkey % 2 = 0 AS variant, [o_custkey, o_orderkey] AS edges FROM orders),
r AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY out_and_back, fun_km DESC, score DESC, area, variant, edges) AS INT) AS place FROM c) SELECT * FROM r WHERE place <= 12""")
def ranked_circuits(t: Tables) -> DataFrame:
    """The twelve best orders by the order of circuits, whose last key is a list."""
    rows = t.orders.selectExpr("o_orderkey", "o_orderstatus = 'F' as out_and_back", "cast(round(o_totalprice / 1000) as bigint) as fun_km", "cast(substring(o_orderpriority, 1, 1) as int) as score", "o_custkey % 25 as area", "o_custkey % 2 = 0 as variant", "array(o_custkey, o_orderkey) as edges")
    return route_parts.rank_circuits(rows).select("o_orderkey", "place")


@query(f"""WITH {PLACES} SELECT c_custkey, rank FROM (SELECT c_custkey, -x AS rank, x AS west, y AS south, x + 50 AS east, y + 20 AS north FROM c) WHERE west <= 4000 AND 1000 <= east AND south <= 600 AND 200 <= north ORDER BY rank, c_custkey LIMIT 250""")
def lines_in_view(t: Tables) -> DataFrame:
    """The best customers whose box meets a view, at most 250."""
    rows = customers(t).select(F.col("c_custkey").alias("key"), (-F.col("x")).alias("rank"), F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + 50).alias("east"), (F.col("y") + 20).alias("north"))
    return route_parts.in_view(rows, (1000.0, 200.0, 4000.0, 600.0)).select(F.col("key").alias("c_custkey"), "rank")


@query("""WITH k AS (SELECT n_nationkey AS list, i AS pos, (n_nationkey * 31 + i * 17) % 400 AS key FROM nation, range(0, 40) r(i))
SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY pos) AS INT) AS place, c_custkey FROM k JOIN customer ON c_custkey = key AND c_acctbal > 0""")
def collection_members(t: Tables) -> DataFrame:
    """Members of lists of keys that exist, in the lists' order."""
    lists = t.nation.select(F.col("n_nationkey").alias("list"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (F.col("n_nationkey") * 31 + i * 17) % 400).alias("keys"))
    found = route_parts.ordered_members(lists, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key")))
    return found.select("list", "place", F.col("key").alias("c_custkey"))


@query("""WITH p AS (SELECT o_custkey AS line, row_number() OVER w AS seq, count(*) OVER (PARTITION BY o_custkey) AS n, 4 + (o_orderkey % 97) / 100.0::DOUBLE AS lon, 52 + (o_orderkey % 89) / 100.0::DOUBLE AS lat FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY line ORDER BY seq)),
s AS (SELECT *, CASE WHEN lat0 IS NULL THEN 0 ELSE 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) END AS step FROM l),
c AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY seq) AS km, sum(step) OVER (PARTITION BY line) * 0.4 AS target FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY seq) AS pick FROM c WHERE n = 1 OR (seq > 1 AND (km >= target OR seq = n)))
SELECT line, round(CASE WHEN n = 1 THEN lon ELSE lon0 + (lon - lon0) * (target - (km - step)) / CASE WHEN step = 0 THEN 1 ELSE step END END, 6) AS lon,
  round(CASE WHEN n = 1 THEN lat ELSE lat0 + (lat - lat0) * (target - (km - step)) / CASE WHEN step = 0 THEN 1 ELSE step END END, 6) AS lat FROM k WHERE pick = 1""")
def cursor_points(t: Tables) -> DataFrame:
    """The place at two fifths of each customer's line of orders."""
    rows = t.orders.select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("seq"), (4 + F.col("o_orderkey") % 97 / 100.0).alias("lon"), (52 + F.col("o_orderkey") % 89 / 100.0).alias("lat"))
    return route_parts.point_at_fraction(rows, 0.4).select("line", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query(f"""WITH {STEPS} SELECT route, min(length_m) AS low, max(length_m) AS high, max(fun) AS peak, arg_max(seq, fun * 1000000 - seq) AS peak_km FROM steps GROUP BY route""")
def profile_summaries(t: Tables) -> DataFrame:
    """Range of each route's lengths and the first place of its greatest fun."""
    return route_parts.profile_summary(steps(t).select("route", F.col("seq").alias("km"), F.col("length_m").alias("elevation"), F.col("fun").alias("curvature")))


GRID = """e AS (SELECT min(x) - {r} AS x0, min(y) - {r} AS y0, floor((max(x) - (min(x) - {r})) / {r}) + 2 AS nx, floor((max(y) - (min(y) - {r})) / {r}) + 2 AS ny FROM {p})"""


@query(f"""WITH {PLACES}, p AS (SELECT x, y FROM s WHERE s_nationkey IN (1, 3, 5, 7, 11)), {GRID.format(r=150, p='p')},
g AS (SELECT floor((x - x0) / 150) AS cx, floor((y - y0) / 150) AS cy, count(*) AS n FROM p, e GROUP BY ALL),
q AS (SELECT c_custkey, greatest(0, least(floor((x - x0) / 150), nx)) AS cx, greatest(0, least(floor((y - y0) / 150), ny)) AS cy FROM c, e)
SELECT c_custkey, CAST(coalesce(sum(n), 0) AS BIGINT) AS density FROM q LEFT JOIN g ON abs(g.cx - q.cx) <= 1 AND abs(g.cy - q.cy) <= 1 GROUP BY c_custkey""")
def density_of_kinds(t: Tables) -> DataFrame:
    """Suppliers of five nations around each customer, on a grid that starts at them."""
    found = route_parts.kind_density(suppliers(t).withColumnRenamed("s_nationkey", "kind"), customers(t), [1, 3, 5, 7, 11], 150.0)
    return found.select("c_custkey", F.col("density").cast("long").alias("density"))


@query(f"""WITH {PLACES}, b AS (SELECT s_suppkey, s_suppkey % 10 = 0 AS on_route, x, y, x + 5 AS mx, y + 2.5 AS my FROM s), p AS (SELECT mx AS x, my AS y FROM b WHERE on_route), {GRID.format(r=40, p='p')},
g AS (SELECT DISTINCT floor((x - x0) / 40) AS cx, floor((y - y0) / 40) AS cy FROM p, e),
q AS (SELECT s_suppkey, on_route, greatest(0, least(floor((x - x0) / 40), nx)) AS cx, greatest(0, least(floor((y - y0) / 40), ny)) AS cy FROM b, e)
SELECT s_suppkey, CASE WHEN bool_or(on_route) THEN 1.0 WHEN count(g.cx) > 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS bicycles FROM q LEFT JOIN g ON abs(g.cx - q.cx) <= 1 AND abs(g.cy - q.cy) <= 1 GROUP BY s_suppkey""")
def bicycles_near(t: Tables) -> DataFrame:
    """Which suppliers lie on a cycle route, and which beside one."""
    edges = suppliers(t).select("s_suppkey", (F.col("s_suppkey") % 10 == 0).cast("int").alias("on_route"), "x", "y", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 10).alias("bx"), (F.col("y") + 5).alias("by"))
    return route_parts.bicycle_proximity(edges).select("s_suppkey", "bicycles")


@query("""WITH e AS (SELECT o_orderkey AS edge_id, o_custkey AS slice_id, o_orderkey % 2 = 1 AS rev, 1000.0::DOUBLE AS length_m FROM orders),
c AS (SELECT c_custkey AS slice_id, c_custkey % 2 = 0 AS rev, i * 70.0 + c_custkey % 60 AS s, CASE WHEN (c_custkey + i) % 2 = 0 THEN 1 ELSE -1 END AS sign, 30 + i AS radius FROM customer, range(0, 3) r(i)),
j AS (SELECT edge_id, CASE WHEN e.rev = c.rev THEN s ELSE length_m - s END AS s, CASE WHEN e.rev = c.rev THEN sign ELSE -sign END AS sign, radius FROM e JOIN c USING (slice_id))
SELECT edge_id, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY s) AS INT) AS nth, CAST(s AS DOUBLE) AS s, CAST(sign AS INT) AS sign, CAST(radius AS BIGINT) AS radius FROM j""")
def corners_both_ways(t: Tables) -> DataFrame:
    """Corners of both directions of a slice from those of the measured one."""
    edges = t.orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("slice_id"), (F.col("o_orderkey") % 2 == 1).alias("rev"), F.lit(1000.0).alias("length_m"))
    corners = t.customer.select(F.col("c_custkey").alias("slice_id"), (F.col("c_custkey") % 2 == 0).alias("rev"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    corners = corners.select("slice_id", "rev", (F.col("i") * 70.0 + F.col("slice_id") % 60).alias("s"), F.when((F.col("slice_id") + F.col("i")) % 2 == 0, 1).otherwise(-1).alias("sign"), (F.col("i") + 30).cast("long").alias("radius"), F.lit(90.0).alias("heading"))
    return route_parts.mirrored_corners(edges, corners).select("edge_id", "nth", "s", "sign", "radius")


@query(f"""WITH {PLACES}, p(place, px, py) AS (VALUES (1, 100.0, 100.0), (2, 5000.0, 500.0), (3, 9000.0, 10.0))
SELECT place, arg_min(c_custkey, pow(x - px, 2) + pow(y - py, 2)) AS node FROM c, p GROUP BY place""")
def nearest_nodes(t: Tables) -> DataFrame:
    """The customer next to each of three places."""
    places = t.spark.createDataFrame([(1, 100.0, 100.0), (2, 5000.0, 500.0), (3, 9000.0, 10.0)], "place int, px double, py double")
    return route_parts.nearest_node(customers(t).withColumnRenamed("c_custkey", "node"), places)


SIGNS = """signs AS (SELECT l_suppkey AS edge_id, CASE l_linenumber % 5 WHEN 0 THEN 'bend' WHEN 1 THEN 'series' WHEN 2 THEN 'advisory' WHEN 3 THEN 'limit' ELSE 'builtup' END AS kind,
  CAST(l_quantity AS INT) // 10 * 10 AS value, l_orderkey % 2 = 0 AS zone_entry, l_orderkey % 50 = 0 AS camera FROM lineitem)"""


@query(f"""WITH {SIGNS}, g AS (SELECT edge_id, CAST(least(count(*) FILTER (kind IN ('bend', 'series')), 255) AS INT) AS bend_signs, CAST(least(count(*) FILTER (camera), 255) AS INT) AS cameras,
  CAST(coalesce(min(value) FILTER (kind = 'advisory' AND value > 0), 0) AS INT) AS advisory, CAST(coalesce(min(value) FILTER (kind = 'limit' AND value > 0), 0) AS INT) AS posted,
  bool_or(kind = 'limit' AND zone_entry AND value = 30) AS zone30, bool_or(kind = 'limit' AND zone_entry AND value = 60) AS zone60, bool_or(kind = 'builtup') AS builtup,
  max(CASE kind WHEN 'series' THEN 0.8 WHEN 'bend' THEN 0.5 ELSE 0 END)::DOUBLE AS severity FROM signs GROUP BY edge_id)
SELECT edge_id, bend_signs, cameras, advisory, posted, zone30, zone60, builtup, round(least(severity + CASE WHEN severity > 0 AND advisory > 0 THEN 0.2 ELSE 0 END, 1), 3)::DOUBLE AS severity FROM g""")
def signs_on_edges(t: Tables) -> DataFrame:
    """Signs of each edge: counts, least posted speeds, zones and the severity of bends."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("bend", "series", "advisory", "limit", "builtup")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    signs = t.lineitem.select(F.col("l_suppkey").alias("edge_id"), kind.alias("kind"), (F.floor(F.col("l_quantity").cast("int") / 10) * 10).alias("value"), (F.col("l_orderkey") % 2 == 0).alias("zone_entry"), (F.col("l_orderkey") % 50 == 0).alias("camera"))
    return route_parts.sign_reductions(signs)


BUSY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in browse.CLASS_BUSY.items())


@query(f"""WITH h AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'residential' ELSE 'track' END AS highway, o_custkey % 4 * 10 AS a, o_custkey % 3 * 20 AS b, o_custkey % 2 * 30 AS c FROM orders)
SELECT o_orderkey, CASE highway {BUSY} ELSE 0.3 END::DOUBLE AS busy, CAST(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS INT) AS advisory,
  CASE WHEN a > 0 THEN 'register' WHEN b > 0 THEN 'sign' WHEN c > 0 THEN 'map' ELSE 'none' END AS source FROM h""")
def advisory_precedence(t: Tables) -> DataFrame:
    """Advisory speeds by their sources' precedence, and how busy a class is."""
    highway = F.element_at(F.array(*[F.lit(k) for k in ("motorway", "primary", "tertiary", "residential", "track")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    speed, source = browse.advisory_speed(F.col("o_custkey") % 4 * 10, F.col("o_custkey") % 3 * 20, F.col("o_custkey") % 2 * 30)
    return t.orders.select("o_orderkey", browse.class_busyness(highway).alias("busy"), speed.alias("advisory"), source.alias("source"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'out_and_back' END, CASE WHEN NOT c_acctbal / 100 BETWEEN 40 AND 80 THEN 'length_outside_ideal' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'home_unreachable' WHEN c_nationkey * 5 > 60 THEN 'far_from_home' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'ee:' END || 'sprint:' || c_custkey AS key, CAST(floor(c_nationkey / 24.0 * 100 + 0.5) AS BIGINT) || '%' AS share,
  c_nationkey || ' ' || CASE WHEN c_nationkey = 1 THEN 'route' ELSE 'routes' END AS routes FROM customer""")
def route_labels(t: Tables) -> DataFrame:
    """Flags, keys and shown numbers of customers taken as routes."""
    flags = browse.route_flags(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") / 100, F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey") * 5), 40, 80, 60)
    key = browse.route_key(F.when(F.col("c_nationkey") % 2 == 0, "nl").otherwise("ee"), F.lit("sprint"), F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", F.array_join(flags, ",").alias("flags"), key.alias("key"), browse.shown_share(F.col("c_nationkey") / 24.0).alias("share"), browse.shown_count(F.col("c_nationkey"), "route").alias("routes"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN 'x' END AS plate, CAST(l_quantity AS DOUBLE) * 3 AS a, CAST(l_quantity AS DOUBLE) * CASE WHEN l_suppkey % 4 = 0 THEN 2.5 ELSE 2 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN plate IS NULL AND a = floor(a) AND a BETWEEN 1 AND 130 AND b = floor(b) AND b BETWEEN 1 AND 130 THEN CAST(a AS INT) END AS forward,
  CASE WHEN plate IS NULL AND a = floor(a) AND a BETWEEN 1 AND 130 AND b = floor(b) AND b BETWEEN 1 AND 130 THEN CAST(b AS INT) END AS backward FROM r""")
def register_speed_pairs(t: Tables) -> DataFrame:
    """Limits of both directions of register rows without restricting plates."""
    q = F.col("l_quantity").cast("double")
    both = browse.register_speeds(q * 3, q * F.when(F.col("l_suppkey") % 4 == 0, 2.5).otherwise(2.0), [F.when(F.col("l_suppkey") % 9 == 0, "x")])
    return t.lineitem.select("l_orderkey", "l_linenumber", both["forward"].alias("forward"), both["backward"].alias("backward"))
