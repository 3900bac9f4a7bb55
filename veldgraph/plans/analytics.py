"""Aggregates, rankings and dashboards. Orders stand for policies, customers and suppliers for customers and users, events for query and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.operators import aggregates, filters, joins
from veldgraph.plans import EVENTS_AS_OF, ORDERS_AS_OF, Plans, Tables

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


def _since(days: int) -> F.Column:
    return F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


# Aggregates


@P.add("""
SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS processing, count(*) FILTER (o_orderstatus = 'F') AS completed
FROM orders GROUP BY o_custkey""")
def agg_count_filter(t: Tables) -> DataFrame:
    of = lambda s: aggregates.count_where(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), of("O").alias("pending"), of("P").alias("processing"), of("F").alias("completed"))


@P.add("SELECT o_orderpriority, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_processed FROM orders GROUP BY o_orderpriority")
def agg_max_filter(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_processed"))


@P.add("SELECT c_nationkey, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS overdrawn, count(CASE WHEN c_acctbal >= 5000 THEN 1 END) AS rich FROM customer GROUP BY c_nationkey")
def agg_count_case(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(aggregates.count_where(F.col("c_acctbal") < 0).alias("overdrawn"), aggregates.count_where(F.col("c_acctbal") >= 5000).alias("rich"))


@P.add(f"""
SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY) AS today, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS week,
count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) AS month, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type""")
def agg_time_buckets(t: Tables) -> DataFrame:
    within = lambda days: aggregates.count_where(F.col("ts") >= _since(days))
    return t.events.groupBy("event_type").agg(within(1).alias("today"), within(7).alias("week"), within(30).alias("month"), F.round(F.avg("value"), 6).alias("avg_value"))


@P.add("""
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days, count(DISTINCT user_id) FILTER (value > 50) AS heavy_users FROM events GROUP BY event_type""")
def agg_distinct_multi(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("heavy_users"))


@P.add("SELECT c_custkey, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def agg_sum_coalesce(t: Tables) -> DataFrame:
    sums = t.orders.filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"))


@P.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@P.add("SELECT coalesce(CASE WHEN p_size > 5 THEN p_type END, '기타') AS kind, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def agg_group_sum(t: Tables) -> DataFrame:
    kind = F.coalesce(F.when(F.col("p_size") > 5, F.col("p_type")), F.lit("기타"))
    return t.part.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@P.add("SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 5")
def agg_topn_group(t: Tables) -> DataFrame:
    return aggregates.top_groups(t.part, "p_brand", 5)


@P.add("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def agg_month(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), aggregates.count_where(F.col("o_orderstatus") == "F").alias("done"))


@P.add("SELECT DISTINCT p_brand FROM part")
def agg_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand").distinct()


@P.add("""
SELECT p_brand, string_agg(p_partkey || ':' || p_type, ',' ORDER BY p_partkey) AS coverages FROM part WHERE p_size > 45 GROUP BY p_brand""")
def agg_collect_map(t: Tables) -> DataFrame:
    found = t.part.filter("p_size > 45").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("found"))
    return found.select("p_brand", F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["p_partkey"], x["p_type"])), ",").alias("coverages"))


@P.add("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS kinds FROM (SELECT p_brand, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part) GROUP BY p_brand")
def agg_collect_distinct(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("p_size") > 25, F.col("p_type")))), ",").alias("kinds"))


@P.add("SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ') || [p_type]) AS label FROM part) GROUP BY label")
def agg_label_unwind(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@P.add("""
SELECT 'supplier' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def agg_graph_totals(t: Tables) -> DataFrame:
    parts = {"supplier": t.supplier.select("s_suppkey"), "part": t.part.select("p_partkey"), "edge": t.lineitem.select("l_suppkey", "l_partkey").distinct()}
    return joins.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()])


@P.add("""
SELECT o_orderstatus, count(DISTINCT o_orderkey) AS articles, count(DISTINCT l_partkey) AS entities FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def agg_doc_graph_stats(t: Tables) -> DataFrame:
    both = t.orders.select("o_orderkey", "o_orderstatus").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey", "left")
    return both.groupBy("o_orderstatus").agg(F.countDistinct("o_orderkey").alias("articles"), F.countDistinct("l_partkey").alias("entities"))


@P.add("""
SELECT event_type, list_sort(list(value))[(len(list(value)) // 2)::INT + 1] AS p50, list_sort(list(value))[floor(len(list(value)) * 0.95)::INT + 1] AS p95,
list_sort(list(value))[floor(len(list(value)) * 0.99)::INT + 1] AS p99 FROM events GROUP BY event_type""")
def agg_percentile(t: Tables) -> DataFrame:
    return aggregates.index_percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@P.add("""
SELECT user_id, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (event_type = 'error') / count(*) ELSE 0 END, 6) AS error_rate, round(count(*) / (30 * 86400.0), 9)::DOUBLE AS rps
FROM events GROUP BY user_id""")
def agg_rate(t: Tables) -> DataFrame:
    errors = aggregates.count_where(F.col("event_type") == "error")
    return t.events.groupBy("user_id").agg(F.round(aggregates.rate(errors, F.count(F.lit(1))), 6).alias("error_rate"), F.round(F.count(F.lit(1)) / F.lit(30 * 86400.0), 9).alias("rps"))


@P.add("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1000 GROUP BY event_type""")
def agg_moving_cap(t: Tables) -> DataFrame:
    last = aggregates.last_n(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 1000)
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@P.add("""
WITH e AS (SELECT *, json_extract(props, '$.k')::INT % 4 AS kind FROM events WHERE event_type = 'error'),
last5 AS (SELECT kind, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS last_ids FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn <= 5 GROUP BY kind)
SELECT kind, count(*) AS n, any_value(last_ids) AS last_ids FROM e JOIN last5 USING (kind) GROUP BY kind""")
def agg_error_summary(t: Tables) -> DataFrame:
    errors = t.events.filter("event_type = 'error'").withColumn("kind", F.get_json_object("props", "$.k").cast("int") % 4)
    w = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id"))
    last = errors.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"]), ",").alias("last_ids"))
    return errors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(last, "kind")


@P.add("""
WITH top AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10)
SELECT (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events WHERE event_type IN ('signup', 'purchase')) AS account_events, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed,
(SELECT count(DISTINCT user_id) FROM events WHERE value > 90) AS pii_users, (SELECT string_agg(user_id || ':' || n, ',' ORDER BY n DESC, user_id) FROM top) AS top_users,
(SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20)) AS alerts""")
def agg_audit_report(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    totals = t.events.agg(F.count(F.lit(1)).alias("total"), aggregates.count_where(kind.isin("signup", "purchase")).alias("account_events"), aggregates.count_where(kind == "error").alias("failed"), F.countDistinct(F.when(F.col("value") > 90, F.col("user_id"))).alias("pii_users"))
    top = aggregates.top_groups(t.events, "user_id", 10).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "user_id"))).alias("x"))
    top = top.select(F.lit(1).alias("one"), F.array_join(F.transform("x", lambda u: F.concat_ws(":", u["user_id"], -u["n"])), ",").alias("top_users"))
    alerts = t.events.filter("event_type = 'error'").orderBy("ts", "event_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("alerts"))
    one = F.lit(1).alias("one")  # each side is a single row
    return totals.select(one, "*").join(top, "one").join(alerts.select(one, "alerts"), "one").drop("one")


@P.add("""
WITH g AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS expired,
 sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, sum(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(total, 2) AS total, active, expired, concat_ws(',', CASE WHEN urgent IS NULL THEN 'no urgent' END, CASE WHEN low IS NULL THEN 'no low' END, CASE WHEN total < 1000000 THEN 'total below 1000000' END) AS gaps FROM g""")
def agg_coverage_summary(t: Tables) -> DataFrame:
    has = lambda p: aggregates.count_where(F.col("o_orderpriority") == p) > 0
    g = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), aggregates.count_where(F.col("o_orderstatus") == "O").alias("active"), aggregates.count_where(F.col("o_orderstatus") == "F").alias("expired"), has("1-URGENT").alias("urgent"), has("5-LOW").alias("low"))
    gaps = F.array_compact(F.array(F.when(~F.col("urgent"), "no urgent"), F.when(~F.col("low"), "no low"), F.when(F.col("total") < 1_000_000, "total below 1000000")))
    return g.select("o_custkey", F.round("total", 2).alias("total"), "active", "expired", F.array_join(gaps, ",").alias("gaps"))


@P.add("SELECT status AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY status")
def agg_policy_stats(t: Tables) -> DataFrame:
    return aggregates.zero_filled(t.orders, "o_orderstatus", ["F", "O", "P", "X"])


@P.add("""
SELECT source, count(*) AS total, count(*) FILTER (contains(text, '|')) AS tables, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length, sum(length(text))::BIGINT AS sum_length
FROM documents GROUP BY source""")
def agg_chunk_stats(t: Tables) -> DataFrame:
    n = F.length("text").cast("long")
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("total"), aggregates.count_where(F.contains("text", F.lit("|"))).alias("tables"), F.round(F.avg(n), 6).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("sum_length"))


@P.add("""
WITH r AS (SELECT event_id, sum(round(value * 10000)::BIGINT) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, (200 * s::BIGINT + n) // (2 * nullif(n, 0)) / 1000000.0::DOUBLE AS running FROM r""")
def agg_running_avg(t: Tables) -> DataFrame:
    """Averages of exact sums, so that halves are rounded alike everywhere."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("value").over(w)
    twice = 200 * F.sum(F.round(F.col("value") * 10_000).cast("long")).over(w) + n
    return t.events.select("event_id", (F.call_function("div", twice, 2 * F.nullif(n, F.lit(0))) / 1_000_000.0).alias("running"))


@P.add("SELECT user_id, count(*) AS total, count(*) FILTER (value < 10) AS unread, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def agg_notif(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), aggregates.count_where(F.col("value") < 10).alias("unread"), F.countDistinct("event_type").alias("kinds"))


# Rankings


@P.add("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def win_rank_fused(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))


@P.add("""
SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def win_prev_version(t: Tables) -> DataFrame:
    return joins.latest_per_group(t.orders, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@P.add("""
SELECT doc_id, i - 1 AS chunk_index, len(parts) AS total_chunks, parts[i] AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(generate_series(1, len(parts))) s(i)""")
def win_chunk_index(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.split("text", "\n").alias("parts"))
    return parts.select("doc_id", F.size("parts").cast("long").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@P.add("SELECT conv_id, turn, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 100) AS overlap FROM conversations")
def win_prev_chunk(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.right(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(100)).alias("overlap"))


@P.add("SELECT conv_id, turn, lead(turn, 1, 99) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM conversations WHERE role = 'user'")
def win_segment_end(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.lead("turn", 1, 99).over(Window.partitionBy("conv_id").orderBy("turn")).alias("until"))


@P.add("SELECT user_id, day, max_by(event_id, (value, -event_id)) AS event_id FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY user_id, day")
def win_dedup_best(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@P.add("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left(text, 200) ORDER BY doc_id) AS rn FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 20)) WHERE rn = 1 ORDER BY doc_id LIMIT 10""")
def win_dedup_text(t: Tables) -> DataFrame:
    """The first sources by text among twenty, ten at most: the limits are part of what is asked."""
    few = t.documents.orderBy("doc_id").limit(20).withColumn("head", F.left("text", F.lit(200)))
    return joins.latest_per_group(few, ["head"], [F.asc("doc_id")]).orderBy("doc_id").limit(10).select("doc_id")


@P.add("SELECT p_partkey, p_name FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_size, p_type) AS n FROM part) WHERE n > 1")
def win_dup_nums(t: Tables) -> DataFrame:
    return t.part.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p_name", "p_size", "p_type"))).filter("n > 1").select("p_partkey", "p_name")


@P.add("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def win_lastn(t: Tables) -> DataFrame:
    return aggregates.last_n(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "event_type")


# Dashboards


@P.add(f"""
WITH c AS (SELECT count(*) AS customers FROM customer), o AS (SELECT count(*) AS policies, round(sum(o_totalprice), 2) AS coverage,
 count(DISTINCT o_custkey) FILTER (o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY) AS active,
 count(DISTINCT o_custkey) FILTER (o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 60 DAY AND o_orderdate < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY) AS before FROM orders)
SELECT customers, policies, coverage, active, before, round(CASE WHEN before > 0 THEN (active - before) * 100.0 / before ELSE 0 END, 1)::DOUBLE AS trend FROM c, o""")
def an_dashboard(t: Tables) -> DataFrame:
    since = lambda d: F.lit(ORDERS_AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {d} DAYS")
    day = F.col("o_orderdate")
    o = t.orders.agg(F.count(F.lit(1)).alias("policies"), F.round(F.sum("o_totalprice"), 2).alias("coverage"), F.countDistinct(F.when(day >= since(30), F.col("o_custkey"))).alias("active"), F.countDistinct(F.when((day >= since(60)) & (day < since(30)), F.col("o_custkey"))).alias("before"))
    c = t.customer.agg(F.count(F.lit(1)).alias("customers"))
    trend = F.round(aggregates.rate((F.col("active") - F.col("before")) * 100.0, F.col("before")), 1).alias("trend")
    one = F.lit(1).alias("one")  # single rows
    return c.select(one, "*").join(o.select(one, "*"), "one").select("customers", "policies", "coverage", "active", "before", trend)


@P.add("""
SELECT c_custkey, c_name, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def an_dashboard_recent(t: Tables) -> DataFrame:
    recent = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_name")
    own = t.orders.join(F.broadcast(recent.select(F.col("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi")  # ten rows
    sums = own.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return recent.join(sums, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


_TEAM = """
SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS policies, round(sum(o_totalprice), 2) AS premium, count(o_orderkey) FILTER (o_orderstatus = 'O') AS active
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey"""


def _team(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"), aggregates.count_where(F.col("o_orderstatus") == "O").alias("k"))
    by_nation = t.customer.join(per, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("policies"), F.round(F.sum("s"), 2).alias("premium"), F.coalesce(F.sum("k"), F.lit(0)).alias("active"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(by_nation, "n_nationkey", "left")
    return named.select("r_name", "n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "policies")], "premium", F.coalesce("active", F.lit(0)).alias("active"))


@P.add(f"SELECT * FROM ({_TEAM} GROUP BY r_name, n_name) ORDER BY premium DESC NULLS LAST, n_name LIMIT 10")
def an_team(t: Tables) -> DataFrame:
    return _team(t).orderBy(F.desc_nulls_last("premium"), "n_name").limit(10)


@P.add(f"{_TEAM} WHERE n_name = 'NATION_7' GROUP BY r_name, n_name")
def an_member(t: Tables) -> DataFrame:
    return _team(t).filter("n_name = 'NATION_7'")


@P.add(f"""
SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY) AS today, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS week, round(avg(value), 6) AS avg_confidence,
(SELECT string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5)) AS intents FROM events""")
def an_query_stats(t: Tables) -> DataFrame:
    within = lambda days: aggregates.count_where(F.col("ts") >= _since(days))
    totals = t.events.agg(F.count(F.lit(1)).alias("total"), within(1).alias("today"), within(7).alias("week"), F.round(F.avg("value"), 6).alias("avg_confidence"))
    top = aggregates.top_groups(t.events, "event_type", 5).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "event_type"))).alias("x"))
    one = F.lit(1).alias("one")
    return totals.select(one, "*").join(top.select(one, F.array_join(F.transform("x", lambda u: F.concat_ws(":", u["event_type"], -u["n"])), ",").alias("intents")), "one").drop("one")


@P.add("""
SELECT event_id, ts, left(props, 200) AS preview, c_name FROM events LEFT JOIN customer ON user_id = c_custkey
WHERE event_type ILIKE '%CLICK%' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC NULLS FIRST, event_id LIMIT 20 OFFSET 20""")
def an_query_list(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    found = t.events.filter(filters.ilike_any("CLICK", "event_type") & (F.col("ts") >= day("2024-01-10")) & (F.col("ts") < day("2024-01-20")))
    rows = filters.page(found, [F.desc_nulls_first("ts"), F.asc("event_id")], 2, 20)
    return rows.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "ts", F.left("props", F.lit(200)).alias("preview"), "c_name")


@P.add("""
SELECT c_custkey, c_name, count(o_orderkey) AS policy_count, max(o_orderdate) AS last_contact FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%00%' AND c_mktsegment = 'BUILDING'
GROUP BY c_custkey, c_name ORDER BY last_contact DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20""")
def an_customers(t: Tables) -> DataFrame:
    found = t.customer.filter(filters.ilike_any("00", "c_name") & (F.col("c_mktsegment") == "BUILDING"))
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_contact"))
    rows = found.join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("policy_count"), "last_contact")
    return filters.page(rows, [F.desc_nulls_last("last_contact"), F.asc("c_custkey")], 2, 20)


@P.add("""
SELECT c_custkey, count(DISTINCT o_orderkey) AS consultations, count(DISTINCT event_id) AS products, max(o_orderdate) AS last_consultation FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""")
def an_fp_customers(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("a"), F.max("o_orderdate").alias("last_consultation"))
    b = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("b"))
    return t.customer.select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", F.coalesce("a", F.lit(0)).alias("consultations"), F.coalesce("b", F.lit(0)).alias("products"), "last_consultation")


@P.add("""
WITH spine AS (SELECT (DATE '2001-08-01' - to_months(i))::DATE AS m FROM range(12) s(i)), stats AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS docs FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 480000 GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, coalesce(docs, 0) AS docs FROM spine LEFT JOIN stats USING (m)""")
def an_docs_monthly(t: Tables) -> DataFrame:
    rare = t.orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 480000")
    return joins.month_spine(rare.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("docs")), "month", "2001-08-01", 12, ["docs"])


@P.add("""
SELECT o_orderpriority, count(DISTINCT o_orderkey) AS documents, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS learned, count(l_linenumber) AS entities, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_processed
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def an_learning(t: Tables) -> DataFrame:
    sizes = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    done = F.col("o_orderstatus") == "F"
    return t.orders.join(sizes, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("documents"), aggregates.count_where(done).alias("learned"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.max(F.when(done, F.col("o_orderdate"))).alias("last_processed"))


@P.add("SELECT count(*) AS documents, count(*) FILTER (o_orderstatus <> 'O') AS processed, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders")
def an_relearn(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("documents"), aggregates.count_where(F.col("o_orderstatus") != "O").alias("processed"), aggregates.count_where(F.col("o_orderstatus") == "F").alias("completed"))


@P.add("""
WITH x AS (SELECT p_partkey, 1.0 * (list_contains(string_split(p_name, ' '), 'red'))::INT + 0.4 * (p_type = 'PROMO')::INT AS rank FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND p_size > 20)
SELECT p_partkey, round(rank, 6)::DOUBLE AS rank, count(*) OVER () AS total FROM x ORDER BY rank DESC, p_partkey LIMIT 20""")
def an_search_docs(t: Tables) -> DataFrame:
    found = filters.full_text(t.part.filter("p_size > 20").withColumn("promo", F.when(F.col("p_type") == "PROMO", "red")), "red", {"p_name": 1.0, "promo": 0.4})
    found = found.filter(F.array_contains(F.split("p_name", " "), "red"))
    total = found.agg(F.count(F.lit(1)).alias("total")).select(F.lit(1).alias("one"), "total")
    return found.orderBy(F.desc("rank"), "p_partkey").limit(20).select("p_partkey", "rank", F.lit(1).alias("one")).join(total, "one").drop("one")


@P.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def an_jobs(t: Tables) -> DataFrame:
    return filters.page(t.orders.filter("o_orderstatus = 'P'"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 20).select("o_orderkey", "o_orderstatus")


@P.add("""
SELECT n_name, s_name, count(*) AS documents, count(p_partkey) AS parsed FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25 GROUP BY n_name, s_name""")
def an_crawl_docs(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(t.part.filter("p_size > 25").select("p_partkey", F.lit(1).alias("parsed")), "p_partkey", "left")
    per = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("documents"), F.count("parsed").alias("parsed"))
    return per.join(t.supplier, "s_suppkey").join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_name", "documents", "parsed")


@P.add("SELECT event_id, event_type, value < 10 AS unread FROM events WHERE user_id = 7 AND event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 50")
def an_notifications(t: Tables) -> DataFrame:
    return t.events.filter("user_id = 7 and event_type <> 'view'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", (F.col("value") < 10).alias("unread"))


@P.add("""
WITH f AS (SELECT * FROM events WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND user_id < 100)
SELECT event_id, user_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50""")
def an_audit_logs(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    found = t.events.filter(filters.all_of(F.col("event_type").isin("error", "signup"), F.col("ts") >= day("2024-01-05"), F.col("ts") < day("2024-01-25"), F.col("user_id") < 100))
    one = F.lit(1).alias("one")
    rows = filters.page(found, [F.desc("ts"), F.asc("event_id")], 2, 50).select("event_id", "user_id", one)
    return rows.join(found.agg(F.count(F.lit(1)).alias("total")).select(one, "total"), "one").drop("one")


@P.add("SELECT event_id, ts FROM events WHERE user_id = 11 AND event_type = 'view' ORDER BY ts DESC, event_id LIMIT 100")
def an_access_logs(t: Tables) -> DataFrame:
    return t.events.filter("user_id = 11 and event_type = 'view'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@P.add("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders)
SELECT o_custkey AS job, count(*) AS stages, (count(*) FILTER (o_orderstatus = 'F') * 100 // count(*))::BIGINT AS progress, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS detail FROM s GROUP BY o_custkey""")
def r_job_status(t: Tables) -> DataFrame:
    stages = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    g = t.orders.groupBy(F.col("o_custkey").alias("job")).agg(F.count(F.lit(1)).alias("stages"), aggregates.count_where(F.col("o_orderstatus") == "F").alias("done"), stages.alias("x"))
    return g.select("job", "stages", F.expr("done * 100 div stages").alias("progress"), F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["o_orderkey"], s["o_orderstatus"])), ",").alias("detail"))


@P.add("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def r_job_list(t: Tables) -> DataFrame:
    return filters.page(t.orders.filter("o_orderstatus = 'F' and o_custkey % 3 = 0"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 1, 10).select("o_orderkey")


@P.add("""
SELECT o_custkey, min(o_orderdate) AS started_at, max(o_orderdate) AS updated_at, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def r_stage_upsert(t: Tables) -> DataFrame:
    """The first start stays, the last status wins."""
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("updated_at"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@P.add("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '(\\.pdf|/(terms|policy|en)/)') ")
def r_pdf_url(t: Tables) -> DataFrame:
    return t.pages.filter(F.lower("url").rlike(r"(\.pdf|/(terms|policy|en)/)")).select("page_id", "url")


@P.add("SELECT page_id, url FROM pages WHERE contains(url, 'example.org') AND page_id % 2 = 0")
def r_url_list(t: Tables) -> DataFrame:
    enabled = True
    return t.pages.filter(filters.all_of(F.contains("url", F.lit("example.org")), F.col("page_id") % 2 == 0 if enabled else None)).select("page_id", "url")


@P.add("SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars FROM documents")
def r_kstats(t: Tables) -> DataFrame:
    return t.documents.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@P.add("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, CASE WHEN count(*) FILTER (value > 95) / count(*) > 0.05 THEN 'unhealthy' ELSE 'healthy' END AS health FROM events GROUP BY event_type""")
def r_monitor(t: Tables) -> DataFrame:
    slow = aggregates.rate(aggregates.count_where(F.col("value") > 95), F.count(F.lit(1)))
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"), F.when(slow > 0.05, "unhealthy").otherwise("healthy").alias("health"))


@P.add("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents WHERE length(text) > 100 AND lang IS NOT NULL) WHERE rn <= 4")
def r_template_scan(t: Tables) -> DataFrame:
    long_enough = t.documents.filter((F.length("text") > 100) & F.col("lang").isNotNull()).select("source", "lang", "doc_id")
    return aggregates.last_n(long_enough, ["source", "lang"], [F.asc("doc_id")], 4)
