"""Queries that score rows by the rubric and aggregate the scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..country import NL
from ..functions import roads
from ..operators import profiles
from ..rubric import RUBRIC
from .base import Tables, query, r6


def case(points: list, v: str) -> str:
    """The SQL of a piecewise scale."""
    parts = [f"WHEN {v} <= {points[0][0]} THEN {float(points[0][1])}"]
    parts += [f"WHEN {v} <= {x1} THEN {float(y0)} + ({v} - {x0}) * ({float(y1 - y0)!r} / ({x1 - x0}))" for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False)]
    return f"(CASE {' '.join(parts)} ELSE {float(points[-1][1])} END)"


A = RUBRIC["anchors"]
STRAIGHT = "(CASE WHEN sh < 0.15 THEN 0.3 + 0.7 * sh / 0.15 WHEN sh > 0.5 THEN 1.0 - 0.7 * least(1.0, (sh - 0.5) / 0.5) ELSE 1.0 END)"
SURFACE = "greatest(0.0, least(1.0, (CASE sf WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.9 WHEN 4 THEN 0.45 WHEN 5 THEN 0.15 WHEN 6 THEN 0.0 ELSE 0.6 END) * (CASE WHEN sm = 3 THEN 0.85 WHEN sm >= 4 THEN 0.6 ELSE 1.0 END) * pow(0.92, least(bumps, 12)) * (CASE WHEN calm THEN 0.95 ELSE 1.0 END) * (CASE WHEN w > 0 AND w < 3 THEN 0.6 WHEN w >= 3 AND w < 4 THEN 0.8 ELSE 1.0 END) * pow(0.97, least(cams, 6))))"
# an order line as an edge: quantities and prices stand for what a road's features would be
EDGE = """e AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS len, l_extendedprice / 250 AS head, l_discount * 60 AS eng, l_tax * 10 AS ess, l_quantity / 60 AS sh, CAST(l_quantity AS INT) % 7 AS sf, CAST(l_quantity AS INT) % 5 AS sm,
  l_linenumber % 4 AS bumps, l_linenumber % 3 = 0 AS calm, l_quantity / 10 AS w, l_linenumber % 2 AS cams, l_discount * 8 AS busy, CAST(20 + l_quantity * 2 AS INT) AS legal, l_extendedprice / 3000 AS relief, l_tax * 100 AS grade, l_discount * 9 AS scen, l_linenumber % 2 AS stops FROM lineitem)"""
KM = "greatest(len / 1000, 1e-4)"
PARTS = {
    "corners": f"(0.55 * {case(A['curviness'], 'head')} + 0.45 * {case(A['corners'], 'eng')})",
    "flow": f"(0.45 * {case(A['flow'], f'(stops / {KM})')} + 0.35 * {case(A['esses'], 'ess')} + 0.2 * {STRAIGHT})",
    "quiet": case(A["quiet"], "busy"), "speed": case(A["speed"], "legal"),
    "elevation": f"greatest({case(A['elevation'], 'relief')}, {case(A['grade'], 'grade')})", "surface": SURFACE, "scenery": case(A["scenery"], "scen"),
}
TOTAL = " + ".join(f"{w} * {PARTS[k]}" for k, w in RUBRIC["weights"].items())
EXCLUDED = f"(sf = 6 OR sf = 5 OR bumps / {KM} > 3 OR legal <= 30)"


def edges(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    whole = q.cast("int")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", (q * 20).alias("len"), (F.col("l_extendedprice") / 250).alias("head"), (F.col("l_discount") * 60).alias("eng"),
        (F.col("l_tax") * 10).alias("ess"), (q / 60).alias("sh"), (whole % 7).alias("sf"), (whole % 5).alias("sm"), (F.col("l_linenumber") % 4).alias("bumps"),
        (F.col("l_linenumber") % 3 == 0).alias("calm"), (q / 10).alias("w"), (F.col("l_linenumber") % 2).alias("cams"), (F.col("l_discount") * 8).alias("busy"),
        (20 + q * 2).cast("int").alias("legal"), (F.col("l_extendedprice") / 3000).alias("relief"), (F.col("l_tax") * 100).alias("grade"),
        (F.col("l_discount") * 9).alias("scen"), (F.col("l_linenumber") % 2).alias("stops"),
    )


def score_parts() -> dict[str, Column]:
    c, scale = F.col, lambda name, v: roads.piecewise(A[name], v)
    km = F.greatest(c("len") / 1000, F.lit(1e-4))
    blend = RUBRIC["corner_blend"]
    return {
        "corners": blend["curviness"] * scale("curviness", c("head")) + blend["engaged"] * scale("corners", c("eng")),
        "flow": 0.45 * scale("flow", c("stops") / km) + 0.35 * scale("esses", c("ess")) + 0.2 * roads.straight_score(A["straights"], c("sh")),
        "quiet": scale("quiet", c("busy")), "speed": scale("speed", c("legal")), "elevation": F.greatest(scale("elevation", c("relief")), scale("grade", c("grade"))),
        "surface": roads.surface_score(RUBRIC, c("sf"), c("sm"), c("bumps"), c("calm"), c("w"), c("cams")), "scenery": scale("scenery", c("scen")),
    }


def fun(parts: dict[str, Column]) -> Column:
    weights = RUBRIC["weights"]
    return reduce(lambda a, b: a + b, [F.lit(w) * parts[k] for k, w in weights.items()]) / sum(weights.values())


def reasons() -> Column:
    c = F.col
    return roads.exclusion_reasons(c("sf"), F.lit(0), c("bumps"), c("len"), F.lit("road"), c("busy"), c("legal"))


@query(f"WITH {EDGE} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({sql} + 1e-9, 8) AS score_{k}" for k, sql in PARTS.items()) + f", CASE WHEN {EXCLUDED} THEN 0.0 ELSE round(({TOTAL}) / {sum(RUBRIC['weights'].values())!r} + 1e-9, 8) END AS fun, {EXCLUDED} AS excluded FROM e")
def weighted_rubric(t: Tables) -> DataFrame:
    """All seven parts of the score, the total and the exclusion of every order line.

    The prices make many exact halves in the last digit; a billionth more keeps their rounding the same everywhere.
    """
    parts = score_parts()
    excluded = F.size(reasons()) > 0
    return edges(t).select("l_orderkey", "l_linenumber", *[F.round(v + 1e-9, 8).alias(f"score_{k}") for k, v in parts.items()], F.when(excluded, 0.0).otherwise(F.round(fun(parts) + 1e-9, 8)).alias("fun"), excluded.alias("excluded"))


@query(f"WITH {EDGE}, r AS (SELECT *, CASE WHEN sf = 6 THEN 'loose' WHEN sf = 5 THEN 'sett' WHEN bumps / {KM} > 3 THEN 'bumps' WHEN legal <= 30 THEN 'slow' ELSE 'kept' END AS reason FROM e) SELECT reason, count(*) AS edges, round(sum(len) / 1000, 4) AS km FROM r GROUP BY reason")
def first_match_reason_counts(t: Tables) -> DataFrame:
    """Edges and kilometres by their first failing reason."""
    first = F.coalesce(F.get(reasons(), F.lit(0)), F.lit("kept"))
    return edges(t).groupBy(first.alias("reason")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("len") / 1000, 4).alias("km"))


@query(f"""WITH {EDGE}, f AS (SELECT l_orderkey, len, ({TOTAL}) / {sum(RUBRIC['weights'].values())!r} AS fun, legal, 1 << (l_linenumber % 8) AS bit FROM e)
SELECT l_orderkey, round_even(sum(len) / 1000, 3) AS km, round(sum(fun * len) / 1000, 4) AS fun_km, round(sum(len / greatest(legal / 3.6 * 0.85, 2.0)), 4) AS seconds,
  round(sum(CASE WHEN fun < 0.35 THEN len ELSE 0 END) / greatest(sum(len), 1), 5) AS connector_share, median(CAST(legal AS DOUBLE)) AS median_legal FROM f GROUP BY l_orderkey""")
def weighted_route_stats(t: Tables) -> DataFrame:
    """Orders as routes: length, fun-kilometres, driving time, connector share, median limit."""
    e = edges(t).withColumn("fun", fun(score_parts()))
    return e.groupBy("l_orderkey").agg(
        F.bround(F.sum("len") / 1000, 3).alias("km"), F.round(F.sum(F.col("fun") * F.col("len")) / 1000, 4).alias("fun_km"),
        F.round(F.sum(roads.travel_seconds(F.col("len"), F.col("legal"))), 4).alias("seconds"),
        F.round(F.sum(F.when(F.col("fun") < 0.35, F.col("len")).otherwise(0.0)) / F.greatest(F.sum("len"), F.lit(1.0)), 5).alias("connector_share"),
        F.median(F.col("legal").cast("double")).alias("median_legal"),
    )


@query(f"""WITH {EDGE} SELECT CAST(sf AS INT) AS sf, round(quantile_cont(head, 0.2), 6) AS p20, round(median(head), 6) AS p50, round(quantile_cont(head, 0.9), 6) AS p90, round(quantile_cont(head, 0.99), 6) AS p99 FROM e GROUP BY sf""")
def percentiles(t: Tables) -> DataFrame:
    """Exact percentiles of turning by surface."""
    found = profiles.exact_percentiles(edges(t), ["sf"], "head", {"p20": 0.2, "p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("sf", *[r6(p).alias(p) for p in ("p20", "p50", "p90", "p99")])


@query("""SELECT l_orderkey, CAST(bit_and(255 - (1 << (l_linenumber % 8))) AS INT) AS mask FROM lineitem GROUP BY l_orderkey""")
def access_mask(t: Tables) -> DataFrame:
    """Windows open along the whole of a route: the bits that all its edges have."""
    bit = F.lit(255) - F.expr("shiftleft(1, l_linenumber % 8)")
    return t.lineitem.groupBy("l_orderkey").agg(F.bit_and(bit).cast("int").alias("mask"))


@query("""WITH s AS (SELECT d.doc_id, d.n_chars AS len, coalesce(l.quality, 0) AS pos, (d.n_chars * 7919 + d.doc_id * 104729) % 10007 AS score FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, sum(len) OVER (ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), k AS (SELECT unnest([1000.0, 20000.0, 100000.0, 1000000.0]) AS k)
SELECT k, round(sum(CASE WHEN pos = 1 THEN greatest(0, least(len, k - coalesce(before, 0))) ELSE 0 END) / k, 6) AS precision_at_k FROM r, k GROUP BY k""")
def precision_at_k(t: Tables) -> DataFrame:
    """Length-weighted precision of the best-scored K characters, the last document in part."""
    score = (F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % 10007
    rows = t.documents.select("doc_id", F.col("n_chars").alias("len"), score.alias("score")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    rows = rows.withColumn("pos", F.coalesce("quality", F.lit(0)))
    # ties of a score stand together: sums by score first, then a running total over the few scores, then inside a score
    sums = rows.groupBy("score").agg(F.sum("len").alias("_len"))
    sums = sums.withColumn("_over", F.coalesce(F.sum("_len").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("score").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums.select("score", "_over"), "score").withColumn("before", F.col("_over") + F.coalesce(F.sum("len").over(inside), F.lit(0)))
    ks = [1000.0, 20000.0, 100000.0, 1000000.0]
    cut = placed.select("pos", "len", "before", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit = F.when(F.col("pos") == 1, F.greatest(F.lit(0.0), F.least(F.col("len").cast("double"), F.col("k") - F.col("before")))).otherwise(0.0)
    return cut.groupBy("k").agg(F.sum(hit).alias("_hit")).select("k", r6(F.col("_hit") / F.col("k")).alias("precision_at_k"))


@query("""SELECT p_partkey, CAST(coalesce(TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT), 0) AS INT) AS number, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS name_key,
  round(sqrt(greatest(0.45 * 9.80665 * p_size, 0)) * 3.6, 5) AS corner_kmh, round(abs((p_retailprice + 180) - floor((p_retailprice + 180) / 360) * 360 - 180), 5) AS wrapped FROM part""")
def text_to_number(t: Tables) -> DataFrame:
    """Numbers and keys out of names, corner speeds, wrapped angles."""
    return t.part.select(
        "p_partkey", F.coalesce(F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("int"), F.lit(0)).alias("number"), roads.normalise_name(F.col("p_name")).alias("name_key"),
        F.round(roads.corner_speed(F.col("p_size")), 5).alias("corner_kmh"), F.round(roads.wrap180(F.col("p_retailprice")), 5).alias("wrapped"),
    )


SPEED_TEXT = "CASE p_size % 8 WHEN 0 THEN 'walk' WHEN 1 THEN 'NL:rural' WHEN 2 THEN 'NL:zone' || p_size WHEN 3 THEN p_size || ' mph' WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN ' ' || p_size * 4 || 'mph' WHEN 6 THEN 'none' ELSE NULL END"


@query("""WITH s AS (SELECT p_partkey, CAST(p_size AS INT) AS n, CAST(p_size % 8 AS INT) AS k FROM part), m AS (SELECT *, CAST(round_even(n * 1.60934, 0) AS INT) AS mph, CAST(round_even(n * 4 * 1.60934, 0) AS INT) AS mph4 FROM s)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN 15 WHEN 1 THEN 80 WHEN 2 THEN n WHEN 3 THEN CASE WHEN mph BETWEEN 1 AND 140 THEN mph ELSE 0 END WHEN 4 THEN n WHEN 5 THEN CASE WHEN mph4 BETWEEN 1 AND 140 THEN mph4 ELSE 0 END ELSE 0 END AS INT) AS kmh FROM m""")
def speed_text(t: Tables) -> DataFrame:
    """Speed texts of every form to km/h."""
    return t.part.select("p_partkey", roads.parse_speed(F.expr(SPEED_TEXT.replace("VARCHAR", "STRING"))).alias("kmh"))


@query("""WITH h AS (SELECT event_id, CAST(extract(hour FROM ts) AS INT) AS hour, CAST(user_id % 24 AS INT) AS b, CAST((user_id * 7 + 5) % 24 AS INT) AS e, CAST(event_id % 5 AS INT) AS k FROM events)
SELECT event_id, CAST(CASE WHEN k = 0 OR b = e OR (CASE WHEN b < e THEN hour >= b AND hour < e ELSE hour >= b OR hour < e END) THEN 60 ELSE 30 + k * 10 END AS INT) AS limit_kmh FROM h""")
def time_window_limit(t: Tables) -> DataFrame:
    """The limit in force at each event's hour, with windows past midnight and missing alternatives."""
    other = F.when(F.col("event_id") % 5 != 0, (30 + F.col("event_id") % 5 * 10).cast("int"))
    return t.events.select("event_id", roads.time_window_limit(F.lit(" 60"), (F.col("user_id") % 24).cast("int"), ((F.col("user_id") * 7 + 5) % 24).cast("int"), other, F.hour("ts")).cast("int").alias("limit_kmh"))


@query("""WITH x AS (SELECT c_custkey, greatest(c_acctbal, 0) AS p, CAST(c_custkey % 10 AS DOUBLE) / 10 AS a, CAST(c_nationkey AS DOUBLE) / 25 AS b FROM customer)
SELECT c_custkey, round(greatest(0.0, least(1.0, 0.4 * greatest(0.0, least(1.0, (log10(greatest(p, 1.0)) - log10(50.0)) / (log10(30000.0) - log10(50.0)))) + 0.35 * a + 0.25 * b)), 6) AS busyness FROM x""")
def busyness_composite(t: Tables) -> DataFrame:
    """Log-scaled population, density and class as one index."""
    parts = {"population": roads.population_score(F.greatest("c_acctbal", F.lit(0.0))), "density": (F.col("c_custkey") % 10).cast("double") / 10, "class": F.col("c_nationkey").cast("double") / 25}
    return t.customer.select("c_custkey", r6(roads.busyness(parts, {"population": 0.4, "density": 0.35, "class": 0.25}, NL)).alias("busyness"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY ALL""")
def conditional_totals(t: Tables) -> DataFrame:
    """Counts and sums by status, partial sums first."""
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n_lines"), r6(F.avg("l_discount")).alias("mean_discount"),
    )


@query("""WITH s AS (SELECT o_orderkey, CAST(o_totalprice / 1000 AS INT) % 3 * 40 AS official, CAST(o_totalprice / 500 AS INT) % 2 * 60 AS tagged, CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'tertiary' WHEN '3-MEDIUM' THEN 'residential' ELSE 'other' END AS h FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderpriority FROM orders))
SELECT o_orderkey, CAST(CASE WHEN official > 0 THEN official WHEN tagged > 0 THEN tagged ELSE CASE h WHEN 'motorway' THEN 100 WHEN 'tertiary' THEN 60 WHEN 'residential' THEN 30 ELSE 50 END END AS INT) AS legal_speed, CAST(CASE WHEN official > 0 THEN 2 WHEN tagged > 0 THEN 1 ELSE 3 END AS INT) AS speed_source FROM s""".replace("CAST(o_totalprice / 1000 AS INT)", "CAST(o_totalprice AS BIGINT)").replace("CAST(o_totalprice / 500 AS INT)", "CAST(o_totalprice AS BIGINT)"))
def legal_speed_precedence(t: Tables) -> DataFrame:
    """Official before tagged before the class's default, with the source."""
    whole = F.floor("o_totalprice").cast("long")
    kind = roads.lookup(F.col("o_orderpriority"), {"1-URGENT": "motorway", "2-HIGH": "tertiary", "3-MEDIUM": "residential"}, "other")
    picked = roads.legal_speed((whole % 3 * 40).cast("int"), (whole % 2 * 60).cast("int"), kind)
    return t.orders.select("o_orderkey", picked.alias("_s")).select("o_orderkey", "_s.legal_speed", "_s.speed_source")
