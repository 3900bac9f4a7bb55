"""Filters, projections, joins, sorts and set operations on the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.operators import filters, joins
from veldgraph.plans import Plans, Tables

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: A stand-in for birth years.
BIRTH_YEAR = "(1940 + c_custkey % 60)"


# Filters and projections


@P.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000")
def flt_dynamic_and(t: Tables) -> DataFrame:
    wanted = {"status": "O", "priority": None, "least": 200_000}
    keep = filters.all_of(
        F.col("o_orderstatus") == wanted["status"] if wanted["status"] else None,
        F.col("o_orderpriority") == wanted["priority"] if wanted["priority"] else None,
        F.col("o_totalprice") >= wanted["least"] if wanted["least"] is not None else None,
    )
    return t.orders.filter(keep).select("o_orderkey", "o_totalprice")


@P.add("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%0_12%' OR c_mktsegment ILIKE '%0_12%'")
def flt_ilike(t: Tables) -> DataFrame:
    return t.customer.filter(filters.ilike_any("0_12", "c_name", "c_mktsegment")).select("c_custkey", "c_name", "c_mktsegment")


@P.add("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def flt_lower_like(t: Tables) -> DataFrame:
    return t.part.filter(filters.lower_like_any("RING", "p_name", "p_type")).select("p_partkey", "p_name")


@P.add("""
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(p_brand), 'brand#1') AND contains(lower(p_name), 'ring') AND p_retailprice BETWEEN 950 AND 1050""")
def flt_substring_py(t: Tables) -> DataFrame:
    keep = filters.all_of(filters.contains_any("Brand#1", "p_brand"), filters.contains_any("Ring", "p_name"), filters.within(F.col("p_retailprice"), 950, 1050))
    return t.part.filter(keep).select("p_partkey", "p_name", "p_brand")


@P.add(f"SELECT c_custkey, {BIRTH_YEAR}::BIGINT AS birth_year, (2024 - {BIRTH_YEAR})::BIGINT AS age FROM customer WHERE {BIRTH_YEAR} <= 2024 - 30 AND {BIRTH_YEAR} >= 2024 - 50")
def flt_age_range(t: Tables) -> DataFrame:
    born = t.customer.withColumn("birth_year", F.expr(BIRTH_YEAR))
    return born.filter(filters.age_between("birth_year", 2024, 30, 50)).select("c_custkey", "birth_year", (2024 - F.col("birth_year")).alias("age"))


@P.add("SELECT o_orderkey, o_custkey FROM orders WHERE month(o_orderdate) = 5")
def flt_month(t: Tables) -> DataFrame:
    return t.orders.filter(F.month("o_orderdate") == 5).select("o_orderkey", "o_custkey")


@P.add("SELECT p_partkey, p_type, p_brand FROM part WHERE list_has_any([p_type, p_brand], ['PROMO', 'Brand#3'])")
def flt_array_overlap(t: Tables) -> DataFrame:
    tags = F.array("p_type", "p_brand")
    return t.part.filter(F.arrays_overlap(tags, F.array(F.lit("PROMO"), F.lit("Brand#3")))).select("p_partkey", "p_type", "p_brand")


@P.add("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT BETWEEN 20 AND 40")
def flt_json_exists(t: Tables) -> DataFrame:
    """A bound on a value within the JSON of each row."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.filter(filters.within(k, 20, 40)).select("event_id", k.alias("k"))


@P.add("SELECT l_orderkey, count(*) AS n_amounts FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_extendedprice BETWEEN 90000 AND 999999999) > 0")
def flt_json_exists_amounts(t: Tables) -> DataFrame:
    """Some amount of a group lies between the bounds, counted without gathering the group."""
    amounts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_amounts"), F.count_if(F.col("l_extendedprice").between(90_000, 999_999_999)).alias("within"))
    return amounts.filter("within > 0").select("l_orderkey", "n_amounts")


@P.add("""
SELECT p_partkey, round(1.0 * len(list_filter(string_split(lower(p_name), ' '), lambda x: x IN ('red', 'promo')))
  + 0.4 * len(list_filter([lower(p_type)], lambda x: x IN ('red', 'promo'))), 6)::DOUBLE AS rank
FROM part WHERE list_contains(string_split(lower(p_name || ' ' || p_type), ' '), 'red') AND list_contains(string_split(lower(p_name || ' ' || p_type), ' '), 'promo')""")
def flt_fulltext(t: Tables) -> DataFrame:
    return filters.full_text(t.part, "red promo", {"p_name": 1.0, "p_type": 0.4}).select("p_partkey", "rank")


@P.add("SELECT DISTINCT conv_id, turn, 1.0::DOUBLE AS score FROM conversations WHERE regexp_matches(text, '(?i)^[^\\n]*(?:est l|and t)[^\\n]*$')")
def flt_regex_any_ci(t: Tables) -> DataFrame:
    found = t.conversations.filter(filters.matches_keywords(["est l", "and t"], "text"))
    return found.select("conv_id", "turn", F.lit(1.0).alias("score")).distinct()


@P.add("""
SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE contains(c_name, '0012')""")
def flt_contains(t: Tables) -> DataFrame:
    found = t.customer.filter(F.contains("c_name", F.lit("0012")))
    above = found.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return above.select("c_custkey", "c_name", "n_name", "r_name")


@P.add("""
SELECT p_partkey, p_retailprice, count(DISTINCT l_suppkey) AS n_products FROM part JOIN lineitem ON l_partkey = p_partkey
WHERE p_retailprice >= 950 GROUP BY p_partkey, p_retailprice""")
def flt_range_node(t: Tables) -> DataFrame:
    amounts = t.part.filter(filters.within(F.col("p_retailprice"), 950, None)).select("p_partkey", "p_retailprice")
    mentions = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    return amounts.join(mentions, "p_partkey").groupBy("p_partkey", "p_retailprice").agg(F.count("l_suppkey").alias("n_products"))


@P.add("SELECT p_partkey, count(DISTINCT l_orderkey) AS n_articles FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 15 GROUP BY p_partkey")
def flt_eq_node(t: Tables) -> DataFrame:
    periods = t.part.filter(F.col("p_size") == 15).select("p_partkey")
    return t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").join(periods, "p_partkey").groupBy("p_partkey").agg(F.countDistinct("l_orderkey").alias("n_articles"))


@P.add("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'supplier#00000002') OR contains(lower(coalesce(NULL, '')), 'supplier#00000002') ORDER BY s_suppkey LIMIT 20")
def flt_ci_contains_node(t: Tables) -> DataFrame:
    return t.supplier.filter(filters.contains_any("SUPPLIER#00000002", "s_name")).orderBy("s_suppkey").limit(20).select("s_suppkey", "s_name")


@P.add("""
SELECT p_partkey, p_name, max(l_orderkey) AS article FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45
WHERE p_type = 'PROMO' AND (contains(p_name, 'red') OR contains(p_brand, 'red')) GROUP BY p_partkey, p_name""")
def flt_entity_search(t: Tables) -> DataFrame:
    found = t.part.filter((F.col("p_type") == "PROMO") & (F.contains("p_name", F.lit("red")) | F.contains("p_brand", F.lit("red")))).select("p_partkey", "p_name")
    articles = t.lineitem.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("article"))
    return found.join(articles, "p_partkey", "left")


@P.add("SELECT doc_id, left(text, 200) AS preview, left(text, 50) AS short FROM documents")
def prj_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.left("text", F.lit(200)).alias("preview"), F.left("text", F.lit(50)).alias("short"))


@P.add("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_size > 10 THEN p_type END, p_brand) AS label FROM part")
def prj_coalesce(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_brand")).alias("label"))


@P.add("""
SELECT c_custkey, max(o_orderkey) IS NOT NULL AS has_order, CASE WHEN c_acctbal < 0 THEN 'incoming' ELSE 'outgoing' END AS direction
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey, c_acctbal""")
def prj_case(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("large")).distinct()
    return t.customer.join(large, "c_custkey", "left").select("c_custkey", F.col("large").isNotNull().alias("has_order"), F.when(F.col("c_acctbal") < 0, "incoming").otherwise("outgoing").alias("direction"))


@P.add("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), nullif(p_type, '')) AS text, 0.8::DOUBLE AS score FROM part")
def prj_first_text(t: Tables) -> DataFrame:
    rows = t.part.withColumn("clause_text", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")))
    return rows.select("p_partkey", filters.first_text("clause_text", "p_type").alias("text"), F.lit(0.8).alias("score"))


# Joins


@P.add("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def jn_inner_equi(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@P.add("SELECT c_custkey, count(o_orderkey) AS policy_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jn_left_group(t: Tables) -> DataFrame:
    return joins.with_child_count(t.customer, t.orders, "c_custkey", "o_custkey", "policy_count").select("c_custkey", "policy_count")


@P.add("SELECT c_custkey, count(o_orderkey) AS active FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def jn_left_on_pred(t: Tables) -> DataFrame:
    return joins.with_child_count(t.customer, t.orders, "c_custkey", "o_custkey", "active", F.col("o_orderstatus") == "O").select("c_custkey", "active")


FANOUT = """
SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS policies, count(DISTINCT event_id) AS queries, round(avg(value), 6) AS avg_value
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey GROUP BY n_nationkey"""


def _fanout(t: Tables, users: DataFrame) -> DataFrame:
    """The average is over the fanned-out rows. Counting per customer first keeps the fan-out out of the join: each event then weighs as often as its customer has orders."""
    users = users.select("c_custkey", "c_nationkey")
    policies = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    queries = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("s"), F.count("value").alias("k"))
    per = users.join(policies, "c_custkey", "left").join(queries, "c_custkey", "left").withColumn("fan", F.greatest(F.coalesce("n_orders", F.lit(0)), F.lit(1)))
    out = per.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("n_orders"), F.lit(0)).alias("policies"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("queries"), (F.sum(F.col("s") * F.col("fan")) / F.sum(F.col("k") * F.col("fan"))).alias("avg_value")
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "policies", "queries")]
    return t.nation.select("n_nationkey").join(out, "n_nationkey", "left").select("n_nationkey", *filled, F.round("avg_value", 6).alias("avg_value"))


@P.add(FANOUT)
def jn_fanout3(t: Tables) -> DataFrame:
    return _fanout(t, t.customer)


@P.add("""
SELECT l_orderkey, l_linenumber, o_orderstatus, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 40
WHERE l_quantity >= 49""")
def jn_left_chain(t: Tables) -> DataFrame:
    lines = t.lineitem.filter("l_quantity >= 49").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(t.part.filter("p_size > 40"), F.col("p_partkey") == F.col("l_partkey"), "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "p_name")


@P.add("""
WITH recent AS (SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM recent""")
def jn_scalar_sub(t: Tables) -> DataFrame:
    recent = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_name")
    few = t.orders.join(F.broadcast(recent.select(F.col("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi")  # ten rows
    return joins.with_child_count(recent, few, "c_custkey", "o_custkey", "n")


@P.add("""
SELECT a.l_orderkey, a.l_linenumber AS l_linenumber_1, b.l_linenumber AS l_linenumber_2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
WHERE a.l_quantity > 30 AND b.l_quantity > 30""")
def jn_self_triangle(t: Tables) -> DataFrame:
    return joins.pairs(t.lineitem.filter("l_quantity > 30").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


def _edges(t: Tables) -> DataFrame:
    """Suppliers as sources, parts as targets, an edge for each line of 40 and more pieces."""
    return t.lineitem.filter("l_quantity >= 40").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type")).distinct()


def _candidates(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_discount >= 0.09").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type")).distinct()


_CANDIDATES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel_type FROM lineitem WHERE l_discount >= 0.09"
_EDGES = "SELECT 1 FROM lineitem e WHERE e.l_quantity >= 40"


@P.add(f"SELECT DISTINCT src, dst FROM ({_CANDIDATES}) c WHERE NOT EXISTS ({_EDGES} AND e.l_suppkey = src AND e.l_partkey = dst)")
def jn_anti_directed(t: Tables) -> DataFrame:
    return joins.without_edge(_candidates(t).select("src", "dst").distinct(), _edges(t))


@P.add(f"SELECT DISTINCT src, dst FROM ({_CANDIDATES}) c WHERE NOT EXISTS ({_EDGES} AND (e.l_suppkey = src AND e.l_partkey = dst OR e.l_suppkey = dst AND e.l_partkey = src))")
def jn_anti_bidir(t: Tables) -> DataFrame:
    return joins.without_edge(_candidates(t).select("src", "dst").distinct(), _edges(t), directed=False)


@P.add(f"SELECT src, dst, rel_type FROM ({_CANDIDATES}) c WHERE NOT EXISTS ({_EDGES} AND e.l_suppkey = src AND e.l_partkey = dst AND e.l_returnflag = rel_type)")
def jn_anti_typed(t: Tables) -> DataFrame:
    return joins.without_edge(_candidates(t), _edges(t), typed=True)


@P.add("""
SELECT a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2, a.p_brand FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey
WHERE length(a.p_name) > 3 AND contains(lower(b.p_name || ' extra'), lower(a.p_name))""")
def jn_theta_contains(t: Tables) -> DataFrame:
    """Names within others among all parts of one brand and size, which stand for an insurer; equal names are within each other."""
    return joins.containing_rows(t.part, "p_name", "p_partkey", ("p_brand", "p_size"), tail=" extra").select("p_partkey_1", "p_partkey_2", "p_brand")


@P.add("""
WITH l AS (SELECT n_name AS label, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT p_name, 'p' || p_partkey FROM part UNION ALL SELECT p_type, 't' || p_partkey FROM part UNION ALL SELECT s_name, 's' || s_suppkey FROM supplier UNION ALL SELECT event_type, 'e' || event_id FROM events
UNION ALL SELECT unnest(string_split(text, ' ')), 'w' || conv_id || '_' || turn FROM conversations),
d AS (SELECT lower(label) AS name, min(id) AS id FROM l WHERE length(label) > 3 GROUP BY 1)
SELECT a.name AS inner, a.id AS inner_id, b.name AS outer, b.id AS outer_id FROM d a JOIN d b ON a.name <> b.name AND contains(b.name, a.name)""")
def jn_contained_labels(t: Tables) -> DataFrame:
    """The same over all labels of several tables and the words of all turns."""
    key = lambda p, *c: F.concat(F.lit(p), F.concat_ws("_", *c))
    words = t.conversations.select(F.explode(F.split("text", " ")).alias("label"), key("w", "conv_id", "turn").alias("id"))
    named = [df.select(F.col(c).alias("label"), key(p, k).alias("id")) for df, c, p, k in ((t.nation, "n_name", "n", "n_nationkey"), (t.part, "p_name", "p", "p_partkey"), (t.part, "p_type", "t", "p_partkey"), (t.supplier, "s_name", "s", "s_suppkey"), (t.events, "event_type", "e", "event_id"))]
    return joins.contained(joins.union_all([*named, words]), "label")


@P.add("""
SELECT a.p_partkey AS p_partkey_1, b.p_partkey AS p_partkey_2 FROM part a JOIN part b
ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_size <> b.p_size""")
def jn_multi_equi_ne(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    return joins.pairs(parts, ["p_brand", "p_type", "p_name"], "p_partkey", F.col("p_size_1") != F.col("p_size_2")).select("p_partkey_1", "p_partkey_2")


@P.add("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def jn_cross_filtered(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@P.add("""
SELECT a.s_suppkey AS s_suppkey_1, b.s_suppkey AS s_suppkey_2, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
ORDER BY 1, 2 LIMIT 2000""")
def jn_type_cluster(t: Tables) -> DataFrame:
    return joins.first_pairs(t.supplier.select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey", 2000).select("s_suppkey_1", "s_suppkey_2", "s_nationkey")


@P.add("""
SELECT conv_id, a.turn AS turn_1, b.turn AS turn_2, 'follows' AS rel_type, b.turn = a.turn + 1 AS adjacent
FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn < b.turn""")
def jn_sequential(t: Tables) -> DataFrame:
    """All ordered pairs, as asked; ``adjacent`` marks those that a ``lead`` would give."""
    after = joins.pairs(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn")
    return after.select("conv_id", "turn_1", "turn_2", F.lit("follows").alias("rel_type"), (F.col("turn_2") == F.col("turn_1") + 1).alias("adjacent"))


@P.add("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def jn_adjacent(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@P.add("""
SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.event_id - b.event_id) <= 100""")
def jn_band(t: Tables) -> DataFrame:
    of = lambda kind, name: t.events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return joins.band(of("click", "a_id"), of("purchase", "b_id"), ["user_id"], "a_id", "b_id", 100).select("a_id", "b_id")


@P.add("""
WITH rules(kind, other, rel) AS (VALUES ('view', 'click', 'HAS_CONDITION'), ('view', 'purchase', 'PROVIDES'), ('view', 'error', 'EXCLUDES'))
SELECT a.event_id AS src, b.event_id AS dst, rel AS rel_type FROM events a JOIN rules ON a.event_type = kind JOIN events b ON b.event_type = other AND a.user_id = b.user_id AND a.ts::DATE = b.ts::DATE""")
def jn_within_group(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("view", "click", "HAS_CONDITION"), ("view", "purchase", "PROVIDES"), ("view", "error", "EXCLUDES")], "kind string, event_type string, rel_type string")
    rows = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    left = rows.select(F.col("event_id").alias("src"), "user_id", "day", F.col("event_type").alias("kind")).join(F.broadcast(rules), "kind")
    return left.join(rows.withColumnRenamed("event_id", "dst"), ["user_id", "day", "event_type"]).select("src", "dst", "rel_type")


@P.add("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def jn_semi_in(t: Tables) -> DataFrame:
    ends = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    sources, targets = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), t.part.filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return ends.join(targets, "l_partkey", "left_semi").join(sources, "l_suppkey", "left_semi").select("l_suppkey").distinct()


@P.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jn_semi_exists(t: Tables) -> DataFrame:
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(urgent, "c_custkey", "left_semi")


@P.add("""
SELECT o_orderkey, lag(o_orderkey) OVER w AS prior_o_orderkey, lag(o_totalprice) OVER w AS prior_o_totalprice FROM orders
WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def jn_latest_prior(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'")
    return joins.latest_prior(done, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"]).select("o_orderkey", "prior_o_orderkey", "prior_o_totalprice")


@P.add("""
WITH spine AS (SELECT (DATE '2001-08-01' - to_months(i))::DATE AS m FROM range(12) s(i)),
stats AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed FROM spine LEFT JOIN stats USING (m)""")
def jn_spine(t: Tables) -> DataFrame:
    stats = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))
    return joins.month_spine(stats, "month", "2001-08-01", 12, ["total", "completed"])


@P.add("""
WITH by_name AS (SELECT min(p_partkey) AS id, p_name FROM part WHERE p_size > 40 GROUP BY p_name), by_brand AS (SELECT min(p_partkey) AS id, p_brand FROM part GROUP BY p_brand)
SELECT p_partkey, coalesce(n.id, b.id) AS linked FROM part LEFT JOIN by_name n USING (p_name) LEFT JOIN by_brand b USING (p_brand)""")
def jn_dim_lookup(t: Tables) -> DataFrame:
    by_name = t.part.filter("p_size > 40").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    by_brand = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("id"))
    return joins.lookup_cascade(t.part.select("p_partkey", "p_name", "p_brand"), [(by_name, "p_name"), (by_brand, "p_brand")], "id", "linked").select("p_partkey", "linked")


# Sorts, limits and pages


@P.add("""
WITH x AS (SELECT c_custkey, max(o_orderdate) FILTER (o_totalprice > 490000) AS last_contact FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, last_contact, row_number() OVER (ORDER BY last_contact DESC NULLS LAST, c_custkey) AS place FROM x ORDER BY place LIMIT 50""")
def srt_multi_nulls(t: Tables) -> DataFrame:
    last = t.orders.filter("o_totalprice > 490000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_contact"))
    top = t.customer.select("c_custkey").join(last, "c_custkey", "left").orderBy(F.desc_nulls_last("last_contact"), "c_custkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_contact"), "c_custkey")).cast("long"))  # of 50 rows


@P.add("""
WITH x AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS size FROM part)
SELECT p_partkey, size FROM x ORDER BY size DESC NULLS FIRST, p_partkey LIMIT 30""")
def srt_default_nulls(t: Tables) -> DataFrame:
    """The default of the dashboards' store: nulls come first in descending order."""
    return t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")).orderBy(F.desc_nulls_first("size"), "p_partkey").limit(30)


@P.add("""
WITH n AS (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'), p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40)
SELECT o_orderkey, total, ceil(total / 20)::BIGINT AS total_pages, 3 < ceil(total / 20) AS has_next, true AS has_prev FROM p, n""")
def lim_offset(t: Tables) -> DataFrame:
    found = t.orders.filter("o_orderstatus = 'O'")
    rows = filters.page(found, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20).select("o_orderkey", F.lit(1).alias("one"))
    info = found.groupBy(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n")).select("one", *filters.page_info(F.col("n"), 3, 20))
    return rows.join(info, "one").drop("one")


@P.add("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def lim_no_order(t: Tables) -> DataFrame:
    """A limit always has a total order here."""
    return t.lineitem.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@P.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@P.add("SELECT p_partkey, p_name FROM part WHERE p_size > 30 AND p_name IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def top_citations(t: Tables) -> DataFrame:
    return t.part.filter("p_size > 30 and p_name is not null").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select("p_partkey", "p_name")


# Set operations


@P.add("""
WITH RECURSIVE b AS (SELECT date_trunc('month', min(o_orderdate))::DATE AS low, date_trunc('month', max(o_orderdate))::DATE AS high FROM orders),
m(d, high) AS (SELECT low, high FROM b UNION ALL SELECT (d + INTERVAL 1 MONTH)::DATE, high FROM m WHERE d < high) SELECT strftime(d, '%Y-%m') AS month FROM m""")
def set_union_all_rec(t: Tables) -> DataFrame:
    """All months from the first order to the last."""
    ends = t.orders.agg(F.trunc(F.min("o_orderdate"), "month").alias("low"), F.trunc(F.max("o_orderdate"), "month").alias("high"))
    return ends.select(F.explode(F.expr("sequence(low, high, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


@P.add("""
WITH g AS (SELECT p_name AS name, max(round(p_retailprice * 100)::BIGINT) FILTER (p_brand = 'Brand#1') AS a, max(round(p_retailprice * 100)::BIGINT) FILTER (p_brand = 'Brand#2') AS b FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY p_name)
SELECT name, CASE WHEN b IS NULL THEN 'only_1' WHEN a IS NULL THEN 'only_2' ELSE 'common' END AS side, CASE WHEN a <> b AND a <> 0 AND b <> 0 THEN abs(a - b) END AS difference FROM g""")
def set_diff_compare(t: Tables) -> DataFrame:
    """Names that one or both of two brands have, and how far the amounts of common ones differ; null if they don't or one is 0."""
    amount = lambda brand: F.max(F.when(F.col("p_brand") == brand, F.round(F.col("p_retailprice") * 100).cast("long")))
    g = t.part.filter("p_brand in ('Brand#1', 'Brand#2')").groupBy(F.col("p_name").alias("name")).agg(amount("Brand#1").alias("a"), amount("Brand#2").alias("b"))
    side = F.when(F.col("b").isNull(), "only_1").when(F.col("a").isNull(), "only_2").otherwise("common")
    return g.select("name", side.alias("side"), F.when(F.expr("a <> b and a <> 0 and b <> 0"), F.abs(F.col("a") - F.col("b"))).alias("difference"))


@P.add("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 EXCEPT SELECT p_partkey FROM part WHERE p_size <= 40")
def set_invalid_citations(t: Tables) -> DataFrame:
    cited, known = t.lineitem.filter("l_quantity = 50").select("l_partkey").distinct(), t.part.filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return cited.join(known, "l_partkey", "left_anti")


@P.add("""
SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')), lambda x: NOT contains(lower(p), x))), ',') AS unknown
FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS p FROM conversations) c""")
def set_fact_diff(t: Tables) -> DataFrame:
    """Long words of an answer that its source, the turn before, doesn't hold."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    facts = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))
    rows = t.conversations.withColumn("source", F.lower(before))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(F.filter(facts, lambda x: ~F.contains(F.col("source"), x))), ",").alias("unknown"))


@P.add("SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def set_node_union(t: Tables) -> DataFrame:
    return t.supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")).union(t.customer.filter("c_acctbal > 9900").select("c_nationkey")).distinct()


@P.add("""
SELECT conv_id, turn, array_to_string(list_filter(list_distinct_first, lambda x: true)[1:10], ',') AS keywords FROM (
  SELECT conv_id, turn, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'i': list_position(w, x), 'x': x})), lambda s: s.x) AS list_distinct_first
  FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 1) AS w FROM conversations))""")
def set_keyword_dedupe(t: Tables) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 1)
    return t.conversations.select("conv_id", "turn", F.array_join(F.slice(F.array_distinct(words), 1, 10), ",").alias("keywords"))
