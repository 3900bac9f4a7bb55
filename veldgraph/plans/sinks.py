"""Sources, sinks and merges on the test tables, and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.functions import text
from veldgraph.operators import joins, sinks
from veldgraph.plans import Plans, Tables
from veldgraph.sources import configs, files
from veldgraph.storage import scratch_path

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


@P.add("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_sql(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name", "n_regionkey")


_SETTINGS = """CASE s_suppkey % 4 WHEN 0 THEN '{"insurer_code": "' || s_suppkey || '", "insurer_name": "' || s_name || '", "base_url": "https://' || s_suppkey || '"}'
WHEN 1 THEN '{"insurer_code": "' || s_suppkey || '", "insurer_name": "' || s_name || '", "base_url": "https://' || s_suppkey || '", "crawl_method": "dynamic_js", "has_pagination": true, "max_pages": ' || s_nationkey || ', "request_delay": 0.5}'
WHEN 2 THEN 'no settings ' || s_name ELSE '{"insurer_code": "' || s_suppkey || '"}' END"""


@P.add("""
SELECT s_suppkey::VARCHAR AS insurer_code, 'https://' || s_suppkey AS base_url, CASE s_suppkey % 4 WHEN 0 THEN 'static_html' ELSE 'dynamic_js' END AS crawl_method, s_suppkey % 4 = 1 AS has_pagination, CASE s_suppkey % 4 WHEN 0 THEN 100 ELSE s_nationkey END::INT AS max_pages,
 CASE s_suppkey % 4 WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS request_delay, 3 AS max_retries FROM supplier WHERE s_suppkey % 4 < 2""")
def src_yaml_crawler(t: Tables) -> DataFrame:
    """Settings of each insurer, suppliers here, with the defaults of what they leave out; what can't be read or lacks an address is left out."""
    return configs.settings(t.supplier.select(F.expr(_SETTINGS).alias("q")), "q")


@P.add("SELECT page_id, CASE WHEN strlen(html) < 10485760 THEN 'memory' ELSE 'stream' END AS route, CASE WHEN strlen(html) < 10485760 THEN 1 ELSE ceil(strlen(html) / 1048576)::BIGINT END AS pieces FROM pages")
def src_pdf_stream(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.read_route(F.octet_length("html")).alias("r")).select("page_id", "r.*")


@P.add("SELECT n_nationkey, n_name FROM nation")
def src_object_store(t: Tables) -> DataFrame:
    """A round trip through JSON, CSV, ORC and text files."""
    frames = [files.round_trip(t.nation.select("n_nationkey", "n_name"), kind) for kind in ("json", "csv", "orc", "parquet")]
    same = frames[0]
    for f in frames[1:]:
        same = same.join(f, ["n_nationkey", "n_name"], "left_semi")
    return same


@P.add("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def snk_insert(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "inserted")
    t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).write.parquet(path)
    t.region.select((F.col("r_regionkey") + 100).cast("int").alias("k"), F.col("r_name").alias("v")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@P.add("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def snk_upsert_update(t: Tables) -> DataFrame:
    old, new = t.orders.filter("o_orderkey < 100").select("o_custkey", "o_orderkey", "o_orderdate"), t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return sinks.upsert(old, new, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@P.add("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity >= 45")
def snk_upsert_ignore(t: Tables) -> DataFrame:
    edges = lambda q: t.lineitem.filter(q).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return sinks.insert_missing(edges("l_quantity >= 48").distinct(), edges("l_quantity >= 45"), ["src", "dst"])


_NODES = "SELECT coalesce(a.k, b.k) AS node_id, coalesce({first}) AS name, coalesce(b.code, a.code) AS code FROM (SELECT p_partkey AS k, p_name AS name, p_type AS code FROM part WHERE p_partkey < 1000) a FULL JOIN (SELECT p_partkey AS k, p_brand AS name, CASE WHEN p_size > 25 THEN p_brand END AS code FROM part WHERE p_partkey > 500) b ON a.k = b.k"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.part.filter("p_partkey < 1000").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("code"))
    new = t.part.filter("p_partkey > 500").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("code"))
    return old, new


@P.add(_NODES.format(first="b.name, a.name"))
def snk_merge_node(t: Tables) -> DataFrame:
    return sinks.merge_nodes(*_old_new(t), "node_id")


@P.add(_NODES.format(first="a.name, b.name"))
def snk_merge_on_create(t: Tables) -> DataFrame:
    return sinks.merge_nodes(*_old_new(t), "node_id", on_create=("name",))


@P.add("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel_type FROM lineitem WHERE l_quantity >= 45 AND (l_quantity >= 48 OR (l_suppkey % 2 = 0 AND l_partkey % 2 = 0))")
def snk_merge_edge(t: Tables) -> DataFrame:
    edges = lambda q: t.lineitem.filter(q).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type"))
    nodes = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node_id")).unionByName(t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node_id")))
    return sinks.merge_edges(edges("l_quantity >= 48").distinct(), edges("l_quantity >= 45"), nodes)


@P.add("SELECT p_type AS label, p_size // 10 AS batch, count(*) AS created, count(*) FILTER (p_size > 45) AS failed FROM part GROUP BY ALL")
def snk_batch(t: Tables) -> DataFrame:
    """Nodes written label by label and batch by batch; what is read back was created, rows that break the rule went to a table of their own."""
    path = scratch_path(t.spark, "batches")
    rows = t.part.select(F.col("p_type").alias("label"), F.floor(F.col("p_size") / 10).alias("batch"), "p_partkey", (F.col("p_size") > 45).alias("failed"))
    rows.write.partitionBy("label", "batch").parquet(path)
    found = t.spark.read.schema("p_partkey long, failed boolean, label string, batch long").parquet(path)
    return found.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("created"), F.count_if("failed").alias("failed"))


@P.add("SELECT p_partkey AS entity_id, p_type[1] || lower(p_type[2:]) AS label, p_name AS name FROM part")
def snk_sync_nodes(t: Tables) -> DataFrame:
    """The node half of a synchronisation."""
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.lower("p_type").alias("type"), F.col("p_name").alias("name"))
    nodes = sinks.synced(entities, t.lineitem.limit(0).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lower("l_returnflag").alias("type")))[0]
    return nodes


@P.add("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, 'RET_' || l_returnflag AS rel_type FROM lineitem WHERE l_quantity = 50")
def snk_sync(t: Tables) -> DataFrame:
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.lower("p_type").alias("type"), F.col("p_name").alias("name"))
    relations = t.lineitem.filter("l_quantity = 50").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.concat(F.lit("ret-"), F.lower("l_returnflag")).alias("type"))
    return sinks.synced(entities, relations)[1]


@P.add("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def snk_delete(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.deleted(t.orders, gone, "o_custkey").select("o_orderkey")


@P.add("""
SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS kind, NULL::VARCHAR AS target FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', NULL FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', NULL FROM supplier
UNION ALL SELECT 'n' || n_nationkey, NULL, 'edge', 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, NULL, 'edge', 'n' || s_nationkey FROM supplier""")
def snk_graph_json(t: Tables) -> DataFrame:
    """Nodes of all levels and the edges between them, written as JSON and read again."""
    level = lambda df, p, key, name, kind: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
    nodes = joins.union_all([level(t.region, "r", "r_regionkey", "r_name", "region"), level(t.nation, "n", "n_nationkey", "n_name", "nation"), level(t.supplier, "s", "s_suppkey", "s_name", "supplier")])
    link = lambda df, p, key, q, up: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("edge").alias("kind"), F.concat(F.lit(q), F.col(up).cast("string")).alias("target"))
    edges = link(t.nation, "n", "n_nationkey", "r", "n_regionkey").unionByName(link(t.supplier, "s", "s_suppkey", "n", "s_nationkey"))
    return files.round_trip(nodes.withColumn("target", F.lit(None).cast("string")).unionByName(edges), "json")


@P.add("""
WITH d AS (SELECT doc_id, source, lang, ((coalesce(length(text), 0) + 99) // 100)::BIGINT AS n, coalesce(length(text), 0)::BIGINT AS length FROM documents)
SELECT 'metadata' AS file, doc_id, source, lang, n, length FROM d UNION ALL SELECT 'chunks', doc_id, NULL, lang, n, length FROM d UNION ALL SELECT 'stats', NULL, NULL, lang, sum(n)::BIGINT, sum(length)::BIGINT FROM d GROUP BY lang""")
def snk_chunk_files(t: Tables) -> DataFrame:
    """All chunks of the whole texts, metadata of each document and statistics of each language, written as JSON; a reader of one language opens only its folder."""
    path = scratch_path(t.spark, "chunks")
    files.write_chunks(t.documents, path, "doc_id", "text", "lang", ["source"], 100)
    chunks, metadata, stats = (t.spark.read.schema(schema).json(f"{path}/{name}") for name, schema in files.CHUNK_FILES.items())
    counted = chunks.groupBy(F.col("id").alias("doc_id"), "lang").agg(F.count("chunk").alias("n"), F.coalesce(F.sum(F.length("chunk")), F.lit(0)).alias("length"))
    null = F.lit(None)
    shown = metadata.select(F.lit("metadata").alias("file"), F.col("id").alias("doc_id"), "source", "lang", F.col("chunks").alias("n"), F.col("chars").alias("length"))
    shown = shown.unionByName(counted.select(F.lit("chunks").alias("file"), "doc_id", null.cast("string").alias("source"), "lang", "n", "length"))
    return shown.unionByName(stats.select(F.lit("stats").alias("file"), null.cast("long").alias("doc_id"), null.cast("string").alias("source"), "lang", F.col("chunks").alias("n"), F.col("chars").alias("length")))


@P.add("SELECT 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def snk_prom(t: Tables) -> DataFrame:
    return sinks.exposition(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "requests_total", "n", "event_type")
