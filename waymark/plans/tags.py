"""Queries of rules on tags, names and lines: customers are ways whose tags follow from their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import browse, places, roads
from ..operators import routes
from .base import Tables, query, r6, scaled6
from .matching import NET, _vertices

#: Values of each tag, taken in turn by the key; None: the way has no such tag.
TAGS = {
    "highway": ("tertiary", "motorway", "primary_link", "residential", "footway", "living_street", None),
    "bridge": (None, "yes", "no", "viaduct", None),
    "tunnel": (None, None, "yes", "no"),
    "junction": (None, None, "roundabout", None, "circular", None, "jughandle", None, None),
    "oneway": (None, "yes", "no", "-1", None, None, "1", "reverse"),
    "motor_vehicle": (None, None, None, "no", "yes", None, "destination", None, None, None, None),
    "motor_vehicle:backward": (None, None, None, None, None, "no", None, None, None, None, None, None, None),
    "access": (None, None, "private", None, "yes", None, None, None, None, "customers"),
    "surface": ("asphalt", "gravel", None, "sett", "paving_stones", None, "sand", "concrete", None, None, None, None),
    "smoothness": (None, "good", None, "bad", "horrible", None, None),
    "area": (None,) * 14 + ("yes",),
    "maxspeed": (None, "50", "130", "131", "EE:rural", "fast", "90", None),
    "maxspeed:type": (None, "EE:urban", None, "EE:rural", ""),
    "maxspeed:forward": (None, None, None, "70", None, "x"),
    "width": (None, "3.5", "4 m", "wide", "2.75"),
    "lanes": (None, "2", "300", "two", "1"),
}
CODES = ("10", "31", "99", " 16", "23", "", None, "61", "27")


def _turn(values: tuple, key: str = "c_custkey") -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values)).cast("int"))


def _sql(values: tuple) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"]::VARCHAR[])[c_custkey % {len(values)} + 1]"


def _listed(names: tuple | list) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _case(value: str, table: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


LOOSE = [k for k, v in roads.SURFACES.items() if v == 6]


def _speed(value: str) -> str:
    return f"CASE WHEN regexp_full_match({value}, '[0-9]{{1,3}}') AND TRY_CAST({value} AS INT) BETWEEN 1 AND 130 THEN CAST({value} AS INT) WHEN {value} = 'EE:rural' THEN 90 WHEN {value} = 'EE:urban' THEN 50 ELSE 0 END"


@query(f"""WITH t AS (SELECT c_custkey AS id, {', '.join(f'{_sql(v)} AS "{k}"' for k, v in TAGS.items())}, {_sql(CODES)} AS code, {_sql(('H', 'T', 'B', None))} AS richt, {_sql(('100%', '50%', '', 'x', None, '7 %'))} AS rel FROM customer),
w AS (SELECT *, coalesce(junction IN ('roundabout', 'circular'), false) OR coalesce(highway IN ('motorway', 'motorway_link'), false) AS round FROM t),
o AS (SELECT *, coalesce(oneway, CASE WHEN round THEN 'yes' ELSE '' END) AS way, coalesce("motor_vehicle:backward" = 'no', false) AS no_back, coalesce(motor_vehicle, '') AS vehicle FROM w),
d AS (SELECT *, way IN ('-1', 'reverse') OR NOT (way IN ('yes', 'true', '1') OR no_back) AS backward, way NOT IN ('-1', 'reverse') AS forward, CASE WHEN maxspeed IS NOT NULL THEN {_speed('maxspeed')} ELSE {_speed('''coalesce(nullif("maxspeed:type", ''), '')''')} END AS base FROM o),
e AS (SELECT *, CASE WHEN coalesce("maxspeed:forward", '') <> '' THEN {_speed('"maxspeed:forward"')} ELSE base END AS ahead FROM d)
SELECT id, coalesce((bridge <> 'no')::INT, 0) * 1 + coalesce((tunnel <> 'no')::INT, 0) * 2 + coalesce((highway IN ('motorway', 'trunk', 'motorway_link', 'trunk_link'))::INT, 0) * 4 + coalesce((highway LIKE '%_link')::INT, 0) * 8 + coalesce((junction IN ('roundabout', 'circular'))::INT, 0) * 16 AS flags,
  CAST(coalesce(TRY_CAST(split_part(trim(width), ' ', 1) AS DOUBLE), 0) AS DOUBLE) AS width, least(coalesce(TRY_CAST(lanes AS INT), 0), 255) AS lanes, {_case('surface', roads.SURFACES)} AS surface, {_case('smoothness', roads.SMOOTHNESS)} AS smoothness,
  coalesce(highway IN {_listed(roads.HIGHWAYS)}, false) AND coalesce(area, '') <> 'yes' AND vehicle NOT IN {_listed(roads.CLOSED)} AND NOT (coalesce(access, '') IN {_listed((*roads.CLOSED, 'customers'))} AND vehicle NOT IN ('yes', 'permissive', 'designated'))
    AND coalesce(surface, '') NOT IN {_listed(LOOSE)} AND coalesce(smoothness, '') NOT IN ('very_bad', 'horrible', 'very_horrible', 'impassable') AND id % 17 > 0 AS drivable,
  forward, backward, CASE WHEN forward THEN ahead ELSE base END AS ahead, CASE WHEN backward THEN base ELSE ahead END AS back,
  CASE WHEN trim(code) IN {_listed(roads.REGISTER_PAVED)} THEN 'paved' WHEN trim(code) IN {_listed(roads.REGISTER_UNPAVED)} THEN 'unpaved' ELSE 'unknown' END AS register,
  CASE richt WHEN 'H' THEN 1 WHEN 'T' THEN -1 ELSE 0 END AS direction, (CASE WHEN TRY_CAST(rtrim(trim(rel), '%') AS DOUBLE) IS NULL THEN 0.75 ELSE least(1, greatest(0, TRY_CAST(rtrim(trim(rel), '%') AS DOUBLE) / 100)) END)::DOUBLE AS reliability FROM e""")
def road_tags(t: Tables) -> DataFrame:
    """What the rules make of a way's tags: flags, width, lanes, surface, access, directions and speeds."""
    pairs = [F.when(_turn(v).isNotNull(), F.struct(F.lit(k).alias("key"), _turn(v).alias("value"))) for k, v in TAGS.items()]
    ways = t.customer.select("c_custkey", F.map_from_entries(F.array_compact(F.array(*pairs))).alias("tags"))
    tags, highway = F.col("tags"), F.coalesce(F.col("tags")["highway"], F.lit(""))
    way = roads.oneway_directions(tags, highway)
    ahead, back = browse.mapped_speeds(tags, way["forward"], way["backward"])
    return ways.select(
        F.col("c_custkey").alias("id"), roads.flag_bits(tags, highway).alias("flags"), roads.width_m(tags["width"]).alias("width"), roads.lane_count(tags["lanes"]).alias("lanes"),
        roads.lookup(tags["surface"], roads.SURFACES).alias("surface"), roads.lookup(tags["smoothness"], roads.SMOOTHNESS).alias("smoothness"), roads.is_drivable(tags, F.col("c_custkey") % 17).alias("drivable"),
        way["forward"].alias("forward"), way["backward"].alias("backward"), ahead.alias("ahead"), back.alias("back"), roads.register_surface(_turn(CODES)).alias("register"),
        roads.direction_code(_turn(("H", "T", "B", None))).alias("direction"), roads.reliability(_turn(("100%", "50%", "", "x", None, "7 %"))).alias("reliability"),
    )


URLS = ("https://www.google.com/maps/dir/?api=1", "http://www.google.com/maps/dir/", "https://maps.google.com/maps", "https://google.com/search", "https://www.google.com.evil.org/maps", "nothing", None)


@query(f"""WITH named AS (SELECT o_custkey, list(CAST(o_orderkey AS BIGINT) ORDER BY o_orderkey) AS ids, list(o_orderpriority ORDER BY o_orderkey) AS names FROM orders GROUP BY o_custkey)
SELECT o_custkey AS ride, array_to_string(list_filter(names, lambda n, i: i = 1 OR n <> names[greatest(i - 1, 1)]), ' → ') || CASE WHEN o_custkey % 2 = 0 THEN ' Loop' ELSE ' Ride' END AS name,
  substr(sha256(unhex(array_to_string(list_transform(ids, lambda x: array_to_string(list_transform(range(8), lambda b: printf('%02x', (x >> (8 * b)) & 255)), '')), ''))), 1, 16) AS ident,
  coalesce(({_sql(URLS).replace('c_custkey', 'o_custkey')}) IN ('https://www.google.com/maps/dir/?api=1', 'https://maps.google.com/maps'), false) AS allowed,
  round(sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2)), 6) AS off_km
FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, (qx * dx + qy * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM (SELECT *, (0.1 + o_custkey % 5 * 0.02) * k AS dx, 0.05 * 111.195 AS dy, o_custkey % 7 * 0.01 * k AS qx, o_custkey % 3 * 0.04 * 111.195 AS qy FROM (SELECT *, cos(radians((52::DOUBLE + 52.05) / 2)) * 111.195 AS k FROM named)))""")
def ride_labels(t: Tables) -> DataFrame:
    """Names and content ids of rides, allowed links, and how far a place is from a chord."""
    rides = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("long").alias("id"), "o_orderpriority"))).alias("o"))
    key = F.col("o_custkey")
    off = roads.chord_deviation_km(4 + key % 7 * 0.01, 52 + key % 3 * 0.04, F.lit(4.0), F.lit(52.0), 4.1 + key % 5 * 0.02, F.lit(52.05))
    return rides.select(
        key.alias("ride"), roads.ride_name(F.col("o.o_orderpriority"), key % 2 == 0).alias("name"), roads.content_id(F.col("o.id")).alias("ident"),
        roads.allowed_map_url(_turn(URLS, "o_custkey")).alias("allowed"), r6(off).alias("off_km"),
    )


def _lines(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("route"), "c_acctbal")
    return _vertices(rows, "route", F.col("c_acctbal"), F.col("route") * 1.3, 30.0, 5, 23)


TRACE = f"""{NET}, tr AS MATERIALIZED (SELECT line AS route, k * 20 + 10.0::DOUBLE AS t, ax + sh * (bx - ax) AS x, ay + sh * (b_y - ay) AS y, (bx - ax) / (m1 - m0) AS hx, (b_y - ay) / (m1 - m0) AS hy
  FROM (SELECT *, (k * 20 + 10 - m0) / (m1 - m0) AS sh FROM seg, range(40) g(k) WHERE kind = 'r' AND k * 20 + 10 >= m0 AND k * 20 + 10 < m1))"""


@query(f"WITH {TRACE} SELECT route, t, round(x, 6) AS x, round(y, 6) AS y, round(hx, 6) AS hx, round(hy, 6) AS hy FROM tr")
def traced_routes(t: Tables) -> DataFrame:
    """Places every 20 m along each road, with the heading."""
    return routes.trace(_lines(t)).select("route", "t", *[scaled6(c).alias(c) for c in ("x", "y", "hx", "hy")])


@query(f"""WITH {TRACE}, hit AS (SELECT DISTINCT a.route, b.route AS other, a.t FROM tr a JOIN tr b ON b.x BETWEEN a.x - 25 AND a.x + 25 AND b.y BETWEEN a.y - 25 AND a.y + 25 AND a.route <> b.route AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 625)
SELECT route, other, round(count(*) / any_value(n), 6) AS share FROM hit JOIN (SELECT route, count(*) AS n FROM tr GROUP BY route) USING (route) GROUP BY route, other""")
def roads_side_by_side(t: Tables) -> DataFrame:
    """How much of each road lies within 25 m of each other road."""
    return routes.near_share(routes.trace(_lines(t))).select("route", "other", r6("share").alias("share"))


#: Tags of nodes and areas in turn, as TAGS.
PLACE_TAGS = {
    "highway": (None, "stop", None, "hump", "speed_camera", None, None, "bus_stop"),
    "traffic_calming": (None,) * 9 + ("no", "table"),
    "enforcement": (None,) * 12 + ("maxspeed",),
    "railway": (None, None, "level_crossing", None, "rail"),
    "amenity": (None, "cafe", "fuel", None, "pub", "bank", None),
    "tourism": (None, "viewpoint", None, "hotel", "museum", None),
    "natural": (None, None, "peak", "wood", None, "water", "sand", None, None),
    "place": ("village", None, "town", "farm"),
    "name": ("Dam", None, "", "Berg", "Veen"),
    "landuse": (None, "forest", None, "meadow", "farmland"),
    "leisure": (None, None, "park", None, "pitch", None, None),
    "water": (None, None, None, "lake", "pond"),
    "waterway": (None, "canal", "ditch"),
}


def _scenic() -> str:
    parts = [f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END" for key, values in places.SCENERY.items()]
    return "coalesce(" + ", ".join(p.replace("CASE water", "CASE coalesce(nullif(water, ''), waterway)") for p in parts) + ")"


@query(f"""WITH t AS (SELECT c_custkey AS id, {', '.join(f'{_sql(v)} AS "{k}"' for k, v in PLACE_TAGS.items())} FROM customer),
k AS (SELECT *, nullif(name, '') AS nm, CASE WHEN highway IN {_listed(places.CALMING)} OR coalesce(traffic_calming, 'no') <> 'no' THEN 1 WHEN highway IN {_listed(places.CONTROLS)} THEN 2 WHEN highway = 'speed_camera' OR enforcement = 'maxspeed' THEN 8 WHEN railway = 'level_crossing' THEN 3
  WHEN amenity IN {_listed(places.COFFEE_STOPS)} THEN 4 WHEN amenity = 'fuel' THEN 5 WHEN tourism IN {_listed(places.VIEWS)} OR "natural" = 'peak' THEN 6 WHEN place IN {_listed(places.SETTLEMENTS)} AND nullif(name, '') IS NOT NULL THEN 7 END AS kind, {_scenic().replace('CASE natural', 'CASE "natural"')} AS scenic FROM t)
SELECT id, kind, CASE kind WHEN 4 THEN coalesce(nm, amenity) WHEN 6 THEN coalesce(nm, tourism) ELSE nm END AS name, scenic, CASE WHEN scenic IS NULL THEN CASE WHEN amenity IN {_listed(places.COFFEE_STOPS)} THEN 4 WHEN tourism IN {_listed(places.VIEWS)} THEN 6 END END AS stop, coalesce(nm, amenity, tourism) AS stop_name FROM k""")
def tagged_places(t: Tables) -> DataFrame:
    """What nodes and areas with a customer's tags stand for."""
    pairs = [F.when(_turn(v).isNotNull(), F.struct(F.lit(k).alias("key"), _turn(v).alias("value"))) for k, v in PLACE_TAGS.items()]
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.map_from_entries(F.array_compact(F.array(*pairs))).alias("tags"))
    tags = F.col("tags")
    point, stop = places.point_kind(tags), places.area_point(tags)
    return rows.select("id", point["kind"].alias("kind"), point["name"].alias("name"), places.scenic_kind(tags).alias("scenic"), stop["kind"].alias("stop"), stop["name"].alias("stop_name"))
