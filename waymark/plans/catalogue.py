"""Queries of the catalogue layer: filters, facets, search, sets, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roads
from ..operators import catalogue
from .base import Tables, query, r6

CUSTOMER_REASONS = "list_filter([CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'type' END, CASE WHEN d IS NULL THEN 'distance unknown' END, CASE WHEN d > 6000 THEN 'too far' END, CASE WHEN c_acctbal < 500 THEN 'low score' END], lambda x: x IS NOT NULL)"


def customers(t: Tables) -> DataFrame:
    return t.customer.withColumn("d", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


def customer_reasons(kind: bool = True):
    named = {"type": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")} if kind else {}
    return catalogue.reasons(named | {"distance unknown": F.col("d").isNull(), "too far": F.col("d") > 6000, "low score": F.col("c_acctbal") < 500})


@query(f"WITH c AS (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS d FROM customer) SELECT c_custkey, array_to_string({CUSTOMER_REASONS}, '; ') AS reasons FROM c")
def exclusion_reasons(t: Tables) -> DataFrame:
    """Why each customer is not among the results; empty where it is."""
    return customers(t).select("c_custkey", F.array_join(customer_reasons(), "; ").alias("reasons"))


@query("""WITH c AS (SELECT c_mktsegment AS kind FROM (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS d FROM customer) WHERE d IS NOT NULL AND d <= 6000 AND c_acctbal >= 500)
SELECT coalesce(kind, 'all') AS c_mktsegment, count(*) AS matches FROM c GROUP BY GROUPING SETS ((kind), ())""")
def facet_counts(t: Tables) -> DataFrame:
    """Matches by segment and in all, whatever segment is selected."""
    return catalogue.facets(customers(t), "c_mktsegment", customer_reasons(kind=False))


@query("""SELECT c_nationkey, c_custkey, round(c_acctbal, 4) AS c_acctbal, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3""")
def top_k_per_group(t: Tables) -> DataFrame:
    """The three largest balances of each nation."""
    return catalogue.top_per_group(t.customer, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "place")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS one FROM customer WHERE c_acctbal >= 100)
SELECT c_mktsegment, c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM b WHERE one = 1) WHERE place <= 12""")
def one_per_area_then_topn(t: Tables) -> DataFrame:
    """The best customer of each segment and nation, then the best twelve of each segment."""
    order = [F.desc("c_acctbal"), F.col("c_custkey")]
    one = t.customer.where("c_acctbal >= 100").withColumn("_one", F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(*order))).where("_one = 1")
    return catalogue.top_per_group(one, "c_mktsegment", order, 12).select("c_mktsegment", "c_nationkey", "c_custkey", "place")


@query("""WITH s AS (SELECT l_orderkey, string_agg(k, ',' ORDER BY k) AS sig FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey % 4 AS VARCHAR) AS k FROM lineitem) GROUP BY l_orderkey)
SELECT sig AS signature, min(l_orderkey) AS kept, count(*) AS copies FROM s GROUP BY sig""")
def dedupe_set_signature(t: Tables) -> DataFrame:
    """Orders with the same set of supplier classes, the first of each kept."""
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 4).cast("string")).alias("_s"))
    return sets.groupBy(catalogue.set_signature(F.col("_s")).alias("signature")).agg(F.min("l_orderkey").alias("kept"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT c_custkey, 'live' AS state FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') UNION ALL
SELECT c_custkey, 'stale' AS state FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def semi_anti_favourites(t: Tables) -> DataFrame:
    """Customers with an open order, and those without."""
    wanted = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    keys = t.customer.select("c_custkey")
    live = keys.join(wanted, "c_custkey", "left_semi").withColumn("state", F.lit("live"))
    return live.unionByName(keys.join(wanted, "c_custkey", "left_anti").withColumn("state", F.lit("stale")))


@query("""WITH e AS (SELECT n_name AS label, 'area' AS kind, count(*) AS count FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT p_name, 'road', count(*) FROM part GROUP BY p_name),
r AS (SELECT *, lower(trim(label)) AS key FROM e), k AS (SELECT *, CASE WHEN key = 're' THEN 0 WHEN starts_with(key, 're') THEN 1 WHEN len(list_filter(regexp_split_to_array(key, '[\\s-]+'), lambda w: starts_with(w, 're'))) > 0 THEN 2 WHEN contains(key, 're') THEN 3 END AS rank FROM r)
SELECT label, kind, count, CAST(rank AS INT) AS rank, row_number() OVER (ORDER BY rank, CASE WHEN kind = 'area' THEN 0 ELSE 1 END, count DESC, label) AS place FROM k WHERE rank IS NOT NULL QUALIFY place <= 8""")
def prefix_search_rank(t: Tables) -> DataFrame:
    """Nations and part names found by a text, the best eight."""
    areas = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("label")).agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("area"))
    names = t.part.groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("count")).withColumn("kind", F.lit("road"))
    return catalogue.search(areas.unionByName(names), "RE ").select("label", "kind", "count", "rank", "place")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, starts_with(url, 'https://') AS secure FROM pages""")
def url_validation(t: Tables) -> DataFrame:
    """Hosts of the pages, and whether the link is a secure one."""
    return t.pages.select("page_id", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.coalesce(F.parse_url("url", F.lit("PROTOCOL")) == "https", F.lit(False)).alias("secure"))


@query("""WITH j AS (SELECT event_type, TRY_CAST(json_extract_string(TRY_CAST(props AS JSON), '$.k') AS INT) AS k FROM events)
SELECT event_type, count(*) AS n_rows, count(k) AS valid, count(*) - count(k) AS quarantined, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM j GROUP BY event_type""")
def json_validate_quarantine(t: Tables) -> DataFrame:
    """Records whose number can be read and those set aside, by kind."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count(k).alias("valid"), (F.count(F.lit(1)) - F.count(k)).alias("quarantined"), F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("total"))


@query("""SELECT o_orderstatus, o_orderpriority, CASE WHEN place = 1 THEN 'first' WHEN place = n THEN 'last' ELSE 'middle' END AS which, o_orderkey FROM (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey)) WHERE place = 1 OR place = n OR place = (n + 1) // 2""")
def first_middle_last(t: Tables) -> DataFrame:
    """The first, middle and last order of each group."""
    keys = ["o_orderstatus", "o_orderpriority"]
    rows = t.orders.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("o_orderdate", "o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    which = F.when(F.col("place") == 1, "first").when(F.col("place") == F.col("n"), "last").otherwise("middle")
    return rows.where("place = 1 or place = n or place = (n + 1) div 2").select(*keys, which.alias("which"), "o_orderkey")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS c_custkey, a.n AS open_orders, b.n AS filled_orders FROM a FULL OUTER JOIN b ON a.k = b.k""")
def merge_profiles(t: Tables) -> DataFrame:
    """Two profiles on one axis, keeping what either has."""
    of = lambda status, name: t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias(name))
    return of("O", "open_orders").join(of("F", "filled_orders"), "c_custkey", "full")


@query("""WITH e AS (SELECT DISTINCT o_orderpriority, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey) SELECT o_orderpriority, string_agg(n_name, ', ' ORDER BY n_name) AS names, count(*) AS n_names FROM e JOIN nation ON n_nationkey = c_nationkey GROUP BY o_orderpriority""")
def inverted_index(t: Tables) -> DataFrame:
    """For each priority the nations that have such orders."""
    seen = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderpriority", "c_nationkey").distinct()
    named = seen.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    return named.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("names"), F.count(F.lit(1)).alias("n_names"))


@query("""SELECT doc_id, sha256(text) AS sha256, length(text) AS chars, strlen(text) AS bytes FROM documents""")
def content_hash(t: Tables) -> DataFrame:
    """Content hashes, as the manifest of inputs keeps them."""
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


@query("""WITH p AS (SELECT p_partkey, p_size AS z FROM part), w AS (SELECT *, list_filter([CASE WHEN z >= 6 THEN z || ' sweet-spot corners (30-150 m radius)' END, CASE WHEN z * 4 >= 120 THEN 'Properly twisty: ' || z * 4 || ' deg of turning per km' END,
  CASE WHEN z * 2 >= 70 THEN 'Modelled as usually quiet (static estimate, not live traffic)' END, CASE WHEN z * 5 >= 150 THEN '+' || z * 5 || ' m of modelled climbing' END,
  CASE WHEN z >= 70 THEN 'Forest, heath or dune scenery most of the way' END], lambda x: x IS NOT NULL) AS said FROM p)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN z * 3 >= 70 AND z / 50 >= 0.5 THEN 'flowing' END, CASE WHEN z / 20 >= 1.5 THEN 'technical' END, CASE WHEN z / 50 >= 0.7 THEN 'scenic' END,
  CASE WHEN z / 40 >= 0.7 THEN 'quiet' END, CASE WHEN z / 30 >= 0.8 THEN 'smooth' END], lambda x: x IS NOT NULL), ',') AS traits,
  CASE WHEN len(said) = 0 THEN 'A spirited circuit with a good rhythm' ELSE array_to_string(said[1:3], '; ') END AS why FROM w""")
def collections(t: Tables) -> DataFrame:
    """Traits and reasons of parts as routes."""
    size = F.col("p_size")
    made = t.part.select("p_partkey", roads.traits(size * 3, size / 50, size / 20, size / 50, size / 40, size / 30).alias("traits"), roads.why(size, size * 4, size * 2, size * 5, size * 1).alias("why"))
    return made.select("p_partkey", F.array_join("traits", ",").alias("traits"), F.array_join("why", "; ").alias("why"))


@query("""WITH m AS (SELECT p_type, count(*) AS n, avg(p_retailprice) AS a, max(p_retailprice) - min(p_retailprice) AS gap FROM part GROUP BY p_type) SELECT p_type, n, round(a, 4) AS mean_price, round(gap, 4) AS gap, place FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, p_type) AS place FROM m) WHERE place <= 12""")
def worst_gaps(t: Tables) -> DataFrame:
    """The twelve types whose prices differ most."""
    price = F.col("p_retailprice")
    by = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("a"), (F.max(price) - F.min(price)).alias("g"))
    top = by.orderBy(F.desc("g"), "p_type").limit(12).withColumn("place", F.row_number().over(Window.orderBy(F.desc("g"), "p_type")).cast("long"))
    return top.select("p_type", "n", F.round("a", 4).alias("mean_price"), F.round("g", 4).alias("gap"), "place")


@query("""SELECT o_orderkey, dayname(o_orderdate)[1:3] || ' ' || strftime(o_orderdate, '%d %b %H:%M') AS label, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def window_labels(t: Tables) -> DataFrame:
    """Times as labels, without any shift of zone."""
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "EEE dd MMM HH:mm").alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""WITH p AS (SELECT user_id, min(value) AS w, max(value) AS e, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, round(w, 6) AS west, round(e, 6) AS east, round((w + e) / 2, 6) AS centre, w <= 50 AND e >= 20 AS meets FROM p""")
def line_boxes(t: Tables) -> DataFrame:
    """Boxes and centres of lines, and whether they meet a view."""
    box = t.events.groupBy("user_id").agg(F.min("value").alias("w"), F.max("value").alias("e"))
    meets = roads.boxes_meet((F.col("w"), F.lit(0), F.col("e"), F.lit(1)), (F.lit(20), F.lit(0), F.lit(50), F.lit(1)))
    return box.select("user_id", r6("w").alias("west"), r6("e").alias("east"), r6((F.col("w") + F.col("e")) / 2).alias("centre"), meets.alias("meets"))
