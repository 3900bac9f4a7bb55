"""Merges as writes of tables with snapshots, a cache of results by content, and deletes that cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.operators import cascade, joins, sinks
from veldgraph.plans import Plans, Tables
from veldgraph.plans.sinks import _NODES, _old_new
from veldgraph.sources.result_cache import TTL_SECONDS, cached
from veldgraph.sources.snapshots import SnapshotTable
from veldgraph.storage import scratch_path

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles


def _merged(t: Tables, *on_create: str) -> SnapshotTable:
    """Nodes in two merges."""
    old, new = _old_new(t)
    table = SnapshotTable(t.spark, scratch_path(t.spark, "nodes"), ["node_id"], buckets=8)
    table.merge(old, lambda _, rows: rows)
    table.merge(new, lambda rows, more: sinks.merge_nodes(rows, more, "node_id", on_create))
    return table


@P.add(_NODES.format(first="b.name, a.name"))
def snk_merge_node_table(t: Tables) -> DataFrame:
    return _merged(t).read()


@P.add(_NODES.format(first="a.name, b.name"))
def snk_merge_on_create_table(t: Tables) -> DataFrame:
    return _merged(t, "name").read()


@P.add("SELECT p_partkey AS node_id, p_name AS name, p_type AS code FROM part WHERE p_partkey < 1000")
def snk_merge_node_snapshot(t: Tables) -> DataFrame:
    """What a reader of the first version sees after the second merge."""
    return _merged(t).read(1)


@P.add("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel_type FROM lineitem WHERE l_quantity >= 45 AND (l_quantity >= 48 OR (l_suppkey % 2 = 0 AND l_partkey % 2 = 0))")
def snk_merge_edge_table(t: Tables) -> DataFrame:
    """Edges between known nodes, at most one of a type between two; a merge that is run again changes nothing."""
    edges = lambda q: t.lineitem.filter(q).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel_type"))
    nodes = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node_id")).unionByName(t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("node_id")))
    table = SnapshotTable(t.spark, scratch_path(t.spark, "edges"), ["src", "dst", "rel_type"], buckets=8)
    table.merge(edges("l_quantity >= 48").distinct(), lambda _, rows: rows)
    for _ in range(2):
        table.merge(edges("l_quantity >= 45"), lambda old, new: sinks.merge_edges(old, new, nodes), version=2)
    return table.read()


@P.add("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def snk_upsert_table(t: Tables) -> DataFrame:
    """Each customer's last order, merged year by year."""
    table = SnapshotTable(t.spark, scratch_path(t.spark, "orders"), ["o_custkey"], buckets=8)
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    for low, high in ((0, 1997), (1997, 2000), (2000, 9999)):
        year = F.year("o_orderdate")
        table.merge(rows.filter((year >= low) & (year < high)), lambda old, new: sinks.upsert(old, new, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]))
    return table.read().select("o_custkey", "o_orderkey")


_CACHED = """
WITH en AS (SELECT DISTINCT text FROM documents WHERE lang = 'en' AND text IS NOT NULL)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN length(text)::VARCHAR END AS result, text IS NOT NULL AND text IN (FROM en) AND {fresh} AS hit FROM documents"""


def _cached(t: Tables, later: int) -> DataFrame:
    """English documents first, then all documents some seconds later."""
    table = SnapshotTable(t.spark, scratch_path(t.spark, "cache"), ["content_hash"], buckets=8)
    lengths = lambda missing: missing.select("content_hash", F.length("text").cast("string").alias("result"))
    docs = t.documents.select("doc_id", "text", "lang")
    cached(docs.filter("lang = 'en'"), "text", lengths, table, 0)
    return cached(docs, "text", lengths, table, later).select("doc_id", "result", "hit")


@P.add(_CACHED.format(fresh="true"))
def src_cache_table(t: Tables) -> DataFrame:
    return _cached(t, TTL_SECONDS - 1)


@P.add(_CACHED.format(fresh="false"))
def src_cache_expired(t: Tables) -> DataFrame:
    """After thirty days every content is computed again."""
    return _cached(t, TTL_SECONDS)


_SHARED = """
e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'q' || l_partkey || '_' || l_suppkey FROM lineitem
UNION ALL SELECT 'q' || l_partkey || '_' || l_suppkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'q' || l_partkey || '_' || l_suppkey, 's' || l_suppkey FROM lineitem),
roots AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey < 4),
below(id) AS (SELECT id FROM roots UNION SELECT dst FROM below JOIN e ON src = id),
inner_ AS (SELECT id FROM below WHERE id NOT IN (FROM roots)),
held(id) AS (SELECT DISTINCT dst FROM e WHERE dst IN (FROM inner_) AND src NOT IN (SELECT id FROM below) UNION SELECT dst FROM held JOIN e ON src = held.id WHERE dst IN (FROM inner_))"""


def _shared_edges(t: Tables) -> DataFrame:
    key = lambda p, *c: F.concat(F.lit(p), F.concat_ws("_", *c))
    offer = key("q", "l_partkey", "l_suppkey")
    return joins.union_all([
        t.customer.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")),
        t.orders.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")),
        t.lineitem.select(key("o", "l_orderkey").alias("src"), offer.alias("dst")),
        t.lineitem.select(offer.alias("src"), key("p", "l_partkey").alias("dst")),
        t.lineitem.select(offer.alias("src"), key("s", "l_suppkey").alias("dst")),
    ])


def _roots(t: Tables) -> DataFrame:
    return t.nation.filter("n_regionkey < 4").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"))


@P.add(f"WITH RECURSIVE {_SHARED} SELECT id AS node_id FROM below WHERE id NOT IN (SELECT id FROM held)")
def snk_delete_cascade(t: Tables) -> DataFrame:
    """The nations of four regions go with their customers, orders and offers; an offer, part or supplier that another order still names stays."""
    return cascade.doomed(_shared_edges(t), _roots(t))


@P.add(f"WITH RECURSIVE {_SHARED}, gone AS (SELECT id FROM below WHERE id NOT IN (SELECT id FROM held)) SELECT src[1] AS kind, count(*) AS n FROM e WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) GROUP BY 1")
def snk_delete_detach(t: Tables) -> DataFrame:
    """The edges that stay, by kind of their source."""
    edges = _shared_edges(t)
    nodes = edges.select(F.col("src").alias("node_id"))
    return cascade.deleted(nodes, edges, _roots(t))[1].groupBy(F.substring("src", 1, 1).alias("kind")).agg(F.count("*").alias("n"))
