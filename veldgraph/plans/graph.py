"""Graph queries. Suppliers stand for products, parts for coverages, brands for diseases and sizes for waiting periods; regions, nations, customers and orders are the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.operators import extractions, graph, joins
from veldgraph.plans import Plans, Tables
from veldgraph.storage import stored

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

GRAPH = """
nodes AS (SELECT 's' || s_suppkey AS node_id, 'Product' AS label, s_name AS name, NULL AS code, NULL::BIGINT AS amount FROM supplier
 UNION ALL SELECT 'p' || p_partkey, 'Coverage', p_name || ' ' || p_partkey, p_type, round(p_retailprice * 100)::BIGINT FROM part
 UNION ALL SELECT DISTINCT 'd' || p_brand, 'Disease', p_brand, 'C' || substr(p_brand, 7), NULL::BIGINT FROM part
 UNION ALL SELECT DISTINCT 'w' || p_size, 'Condition', 'waiting_period', NULL, p_size::BIGINT FROM part),
edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'HAS_COVERAGE' AS rel_type FROM lineitem WHERE l_quantity >= 49
 UNION ALL SELECT 'p' || p_partkey, 'd' || p_brand, 'COVERS' FROM part WHERE p_size <= 45 AND p_brand <> 'Brand#9'
 UNION ALL SELECT 'p' || p_partkey, 'd' || p_brand, 'EXCLUDES' FROM part WHERE p_size > 45
 UNION ALL SELECT 'p' || p_partkey, 'w' || p_size, 'HAS_CONDITION' FROM part WHERE p_size % 2 = 0)"""

TREE = """
tree AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 'HAS_PARAGRAPH' AS rel_type FROM region JOIN nation ON n_regionkey = r_regionkey
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HAS_SUBCLAUSE' FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'HAS_SUBCLAUSE' FROM orders)"""


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes_of(t: Tables) -> DataFrame:
    def nodes(df: DataFrame, node_id: F.Column, label: str, name: F.Column, code: F.Column = F.lit(None), amount: F.Column = F.lit(None)) -> DataFrame:
        return df.select(node_id.alias("node_id"), F.lit(label).alias("label"), name.alias("name"), code.cast("string").alias("code"), amount.cast("long").alias("amount"))

    part = t.part
    return joins.union_all([
        nodes(t.supplier, _key("s", "s_suppkey"), "Product", F.col("s_name")),
        nodes(part, _key("p", "p_partkey"), "Coverage", F.concat_ws(" ", "p_name", "p_partkey"), F.col("p_type"), F.round(F.col("p_retailprice") * 100)),
        nodes(part.select("p_brand").distinct(), _key("d", "p_brand"), "Disease", F.col("p_brand"), F.concat(F.lit("C"), F.substring("p_brand", 7, 9))),
        nodes(part.select("p_size").distinct(), _key("w", "p_size"), "Condition", F.lit("waiting_period"), amount=F.col("p_size")),
    ])


def edges_of(t: Tables) -> DataFrame:
    def edges(df: DataFrame, src: F.Column, dst: F.Column, rel_type: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel_type).alias("rel_type"))

    part, coverage, disease = t.part, _key("p", "p_partkey"), _key("d", "p_brand")
    return joins.union_all([
        edges(t.lineitem.filter("l_quantity >= 49").select("l_suppkey", "l_partkey").distinct(), _key("s", "l_suppkey"), _key("p", "l_partkey"), "HAS_COVERAGE"),
        edges(part.filter("p_size <= 45 and p_brand <> 'Brand#9'"), coverage, disease, "COVERS"),
        edges(part.filter("p_size > 45"), coverage, disease, "EXCLUDES"),
        edges(part.filter("p_size % 2 = 0"), coverage, _key("w", "p_size"), "HAS_CONDITION"),
    ])


def tree_of(t: Tables) -> DataFrame:
    """The hierarchy of all regions, nations, customers and orders."""

    def edges(df: DataFrame, src: F.Column, dst: F.Column, rel_type: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel_type).alias("rel_type"))

    return joins.union_all([
        edges(t.nation, _key("r", "n_regionkey"), _key("n", "n_nationkey"), "HAS_PARAGRAPH"),
        edges(t.customer, _key("n", "c_nationkey"), _key("c", "c_custkey"), "HAS_SUBCLAUSE"),
        edges(t.orders, _key("c", "o_custkey"), _key("o", "o_orderkey"), "HAS_SUBCLAUSE"),
    ])


def _start(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "start string")


# Sources and patterns


@P.add(f"WITH {GRAPH} SELECT node_id, name FROM nodes WHERE label = 'Product' AND node_id = 's7'")
def src_graph(t: Tables) -> DataFrame:
    return nodes_of(t).filter("label = 'Product' and node_id = 's7'").select("node_id", "name")


@P.add(f"""
WITH {GRAPH} SELECT dst AS other, rel_type, 'outgoing' AS direction FROM edges WHERE src = 'p100' UNION ALL SELECT src, rel_type, 'incoming' FROM edges WHERE dst = 'p100'""")
def src_graph_rels(t: Tables) -> DataFrame:
    e = edges_of(t)
    out = e.filter("src = 'p100'").select(F.col("dst").alias("other"), "rel_type", F.lit("outgoing").alias("direction"))
    return out.unionByName(e.filter("dst = 'p100'").select(F.col("src").alias("other"), "rel_type", F.lit("incoming").alias("direction")))


@P.add(f"WITH {GRAPH} SELECT d.name AS disease, c.name AS coverage, c.amount FROM edges e JOIN nodes d ON e.dst = d.node_id JOIN nodes c ON e.src = c.node_id WHERE rel_type = 'COVERS' AND d.name = 'Brand#3'")
def g_coverage_amount(t: Tables) -> DataFrame:
    return graph.coverage_amounts(nodes_of(t), edges_of(t), "Brand#3").orderBy(F.desc("amount"), "coverage")


@P.add(f"WITH {GRAPH} SELECT c.node_id AS coverage, d.node_id AS disease FROM edges e JOIN nodes c ON e.src = c.node_id JOIN nodes d ON e.dst = d.node_id WHERE rel_type = 'COVERS'")
def jn_pattern(t: Tables) -> DataFrame:
    return graph.related(nodes_of(t), edges_of(t), "COVERS", "Coverage", "Disease", "c", "d").select(F.col("c_id").alias("coverage"), F.col("d_id").alias("disease"))


@P.add(f"""
WITH {GRAPH} SELECT d.node_id AS disease, c.node_id AS coverage FROM nodes d LEFT JOIN (SELECT e.dst, n.node_id FROM edges e JOIN nodes n ON n.node_id = e.src WHERE rel_type = 'COVERS') c ON c.dst = d.node_id WHERE d.label = 'Disease'""")
def jn_optional(t: Tables) -> DataFrame:
    return graph.related(nodes_of(t), edges_of(t), "COVERS", "Disease", "Coverage", "d", "c", optional=True).select(F.col("d_id").alias("disease"), F.col("c_id").alias("coverage"))


@P.add(f"""
WITH {GRAPH} SELECT d.name AS disease, count(c.node_id) > 0 AS is_covered, count(c.node_id) AS n_coverages, coalesce(string_agg(c.node_id || ':' || c.amount, ',' ORDER BY c.node_id), '') AS coverages
FROM nodes d LEFT JOIN edges e ON e.dst = d.node_id AND rel_type = 'COVERS' LEFT JOIN nodes c ON c.node_id = e.src WHERE d.label = 'Disease' GROUP BY d.node_id, d.name""")
def g_coverage_check(t: Tables) -> DataFrame:
    return graph.coverage_check(nodes_of(t), edges_of(t))


def _comparison_sql(side: str, other: str, first: str, second: str) -> str:
    """Compares sets of ids on the other side of COVERS edges."""
    one = lambda n: f"SELECT DISTINCT e.{other} AS id FROM edges e JOIN nodes n ON n.node_id = e.{side} WHERE rel_type = 'COVERS' AND n.name = '{n}'"
    show = lambda q: f"coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM ({q})), '')"
    return f"""WITH {GRAPH}, a AS ({one(first)}), b AS ({one(second)}) SELECT '{first}' AS first, '{second}' AS second, {show("SELECT id FROM a EXCEPT SELECT id FROM b")} AS only_first,
{show("SELECT id FROM b EXCEPT SELECT id FROM a")} AS only_second, {show("SELECT id FROM a INTERSECT SELECT id FROM b")} AS common WHERE EXISTS (FROM a) AND EXISTS (FROM b)"""


@P.add(_comparison_sql("dst", "src", "Brand#1", "Brand#2"))
def g_disease_comparison(t: Tables) -> DataFrame:
    return graph.comparison(nodes_of(t), edges_of(t), "Disease", "Coverage", "Brand#1", "Brand#2")


@P.add(_comparison_sql("dst", "src", "Brand#1", "Brand#3"))
def jn_cartesian_match(t: Tables) -> DataFrame:
    return graph.comparison(nodes_of(t), edges_of(t), "Disease", "Coverage", "Brand#1", "Brand#3")


@P.add(_comparison_sql("src", "dst", "red widget 1", "small ring 0"))
def g_coverage_comparison(t: Tables) -> DataFrame:
    return graph.comparison(nodes_of(t), edges_of(t), "Coverage", "Disease", "red widget 1", "small ring 0")


@P.add(f"WITH {GRAPH} SELECT c.name AS coverage, d.name AS disease FROM edges e JOIN nodes c ON e.src = c.node_id JOIN nodes d ON e.dst = d.node_id WHERE rel_type = 'EXCLUDES'")
def g_exclusions(t: Tables) -> DataFrame:
    return graph.related(nodes_of(t), edges_of(t), "EXCLUDES", "Coverage", "Disease", "c", "d").select(F.col("c_name").alias("coverage"), F.col("d_name").alias("disease")).orderBy("coverage", "disease")


_WAITING = f"""
WITH {GRAPH} SELECT c.node_id AS coverage, w.amount AS days, coalesce(string_agg(DISTINCT d.name, ',' ORDER BY d.name), '') AS diseases
FROM edges e JOIN nodes c ON c.node_id = e.src JOIN nodes w ON w.node_id = e.dst LEFT JOIN edges f ON f.src = c.node_id AND f.rel_type = 'COVERS'
LEFT JOIN nodes d ON d.node_id = f.dst {{on}} WHERE e.rel_type = 'HAS_CONDITION' GROUP BY c.node_id, w.amount"""


def _waiting(t: Tables, disease: str | None) -> DataFrame:
    n, e = nodes_of(t), edges_of(t)
    known = n if disease is None else n.filter((F.col("label") != "Disease") | (F.col("name") == disease))
    waits = graph.related(n, e, "HAS_CONDITION", "Coverage", "Condition", "c", "w").select("c_id", F.col("w_amount").alias("days"))
    names = graph.related(known, e, "COVERS", "Coverage", "Disease", "c", "d").select("c_id", "d_name")
    found = waits.join(names, "c_id", "left").groupBy("c_id", "days").agg(F.array_sort(F.collect_set("d_name")).alias("x"))
    return found.select(F.col("c_id").alias("coverage"), "days", F.array_join("x", ",").alias("diseases"))


@P.add(_WAITING.format(on=""))
def g_waiting_period(t: Tables) -> DataFrame:
    return _waiting(t, None)


@P.add(_WAITING.format(on="AND d.name = 'Brand#4'"))
def flt_optional_param(t: Tables) -> DataFrame:
    """The filter narrows what is joined, not what is kept."""
    return _waiting(t, "Brand#4")


@P.add(f"""
WITH {GRAPH} SELECT c.node_id AS coverage, min(w.amount) AS min_age, max(w.amount) AS max_age FROM edges e JOIN nodes c ON c.node_id = e.src JOIN nodes w ON w.node_id = e.dst WHERE rel_type = 'HAS_CONDITION' GROUP BY c.node_id""")
def g_age_limit(t: Tables) -> DataFrame:
    found = graph.related(nodes_of(t), edges_of(t), "HAS_CONDITION", "Coverage", "Condition", "c", "w")
    return found.groupBy(F.col("c_id").alias("coverage")).agg(F.min("w_amount").alias("min_age"), F.max("w_amount").alias("max_age"))


@P.add(f"""
WITH {GRAPH} SELECT c.node_id AS coverage, c.amount, coalesce(string_agg(DISTINCT d.name, ',' ORDER BY d.name), '') AS diseases FROM nodes c LEFT JOIN edges e ON e.src = c.node_id AND rel_type = 'COVERS' LEFT JOIN nodes d ON d.node_id = e.dst
WHERE c.label = 'Coverage' GROUP BY c.node_id, c.amount ORDER BY c.amount DESC, c.node_id LIMIT 20""")
def g_all_coverages(t: Tables) -> DataFrame:
    """The dearest twenty are chosen before their diseases are looked up."""
    n, e = nodes_of(t), edges_of(t)
    top = n.filter("label = 'Coverage'").orderBy(F.desc("amount"), "node_id").limit(20)
    found = graph.related(top.unionByName(n.filter("label = 'Disease'")), e, "COVERS", "Coverage", "Disease", "c", "d", optional=True)
    return found.groupBy(F.col("c_id").alias("coverage"), F.col("c_amount").alias("amount")).agg(F.array_join(F.array_sort(F.collect_set("d_name")), ",").alias("diseases"))


@P.add(f"""
WITH {GRAPH} SELECT d.name AS disease, d.code, c.node_id AS coverage FROM nodes d LEFT JOIN edges e ON e.dst = d.node_id AND rel_type = 'COVERS' LEFT JOIN nodes c ON c.node_id = e.src WHERE d.label = 'Disease' AND d.code = 'C7'""")
def g_disease_by_kcd(t: Tables) -> DataFrame:
    n = nodes_of(t)
    found = graph.related(n.filter("label <> 'Disease' or code = 'C7'"), edges_of(t), "COVERS", "Disease", "Coverage", "d", "c", optional=True)
    return found.select(F.col("d_name").alias("disease"), F.col("d_code").alias("code"), F.col("c_id").alias("coverage"))


@P.add(f"""
WITH {GRAPH} SELECT s.name AS product, count(e.dst) AS n_coverages, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS coverages FROM (SELECT * FROM nodes WHERE label = 'Product' ORDER BY node_id LIMIT 1) s
LEFT JOIN edges e ON e.src = s.node_id AND rel_type = 'HAS_COVERAGE' GROUP BY s.name""")
def g_product_summary(t: Tables) -> DataFrame:
    first = nodes_of(t).filter("label = 'Product'").orderBy("node_id").limit(1).select(F.col("node_id").alias("src"), F.col("name").alias("product"))
    found = first.join(edges_of(t).filter("rel_type = 'HAS_COVERAGE'").select("src", "dst"), "src", "left")
    return found.groupBy("product").agg(F.count("dst").alias("n_coverages"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("coverages"))


@P.add(f"WITH {GRAPH} SELECT d.name AS disease, c.name AS coverage, c.amount FROM edges e JOIN nodes d ON e.dst = d.node_id JOIN nodes c ON e.src = c.node_id WHERE rel_type = 'COVERS' AND d.name = 'Brand#5'")
def g_dispatch(t: Tables) -> DataFrame:
    """An analysed question goes to the query of its intent."""
    from veldgraph.functions.nlq import dispatch

    return dispatch({"intent": "coverage_amount", "disease": "Brand#5"}, nodes_of(t), edges_of(t))


@P.add(f"WITH {GRAPH} SELECT rel_type, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY rel_type HAVING count(*) > 10")
def g_custom(t: Tables) -> DataFrame:
    """A question of one's own is Spark SQL over the node and edge tables."""
    return t.spark.sql("SELECT rel_type, count(*) AS n, count(DISTINCT src) AS sources FROM {edges} GROUP BY rel_type HAVING count(*) > 10", edges=edges_of(t))


@P.add(f"""
WITH {GRAPH} SELECT DISTINCT p.node_id AS product, c.node_id AS coverage, d.name AS disease, w.amount AS days FROM edges a JOIN nodes p ON p.node_id = a.src AND p.label = 'Product' JOIN nodes c ON c.node_id = a.dst AND c.label = 'Coverage'
JOIN edges b ON b.src = c.node_id AND b.rel_type = 'COVERS' JOIN nodes d ON d.node_id = b.dst AND d.label = 'Disease' JOIN edges h ON h.src = c.node_id AND h.rel_type = 'HAS_CONDITION' JOIN nodes w ON w.node_id = h.dst AND w.label = 'Condition'
WHERE a.rel_type = 'HAS_COVERAGE' AND w.amount < 20""")
def g_custom_pattern(t: Tables) -> DataFrame:
    """A pattern of four nodes as a chain: from a disease through its coverage to the product, and on to the coverage's condition."""
    nodes, edges = nodes_of(t), edges_of(t)
    found = graph.pattern(nodes, edges, ("d", "Disease"), ("COVERS", "in"), ("c", "Coverage"), ("HAS_COVERAGE", "any"), ("p", "Product"))
    limits = graph.pattern(nodes, edges, ("c", "Coverage"), ("HAS_CONDITION", "out"), ("w", "Condition")).filter("w_amount < 20")
    both = found.join(limits.select("c_id", "w_amount"), "c_id")
    return both.select(F.col("p_id").alias("product"), F.col("c_id").alias("coverage"), F.col("d_name").alias("disease"), F.col("w_amount").alias("days")).distinct()


# Traversal


def _walk_sql(edges: str, starts: str, depth: int, ways: str, least: int = 1) -> str:
    """Paths from starts as a recursive CTE, no edge used twice."""
    link = f"SELECT src, dst, rel_type, least(src, dst) || '|' || greatest(src, dst) || '|' || rel_type AS edge FROM {edges}"
    if ways != "down":
        back = f"SELECT dst, src, rel_type, least(src, dst) || '|' || greatest(src, dst) || '|' || rel_type FROM {edges}"
        link = back if ways == "up" else f"{link} UNION ALL {back}"
    return f"""links(src, dst, rel_type, edge) AS ({link}),
walk(start, last, nodes, used, depth) AS (SELECT id, id, [id], []::VARCHAR[], 0 FROM ({starts}) UNION ALL
 SELECT start, l.dst, list_append(nodes, l.dst), list_append(used, l.edge), depth + 1 FROM walk JOIN links l ON l.src = walk.last WHERE depth < {depth} AND NOT list_contains(used, l.edge)),
found AS (SELECT start, last AS "end", array_to_string(nodes, '>') AS path, len(nodes)::BIGINT AS path_length, round(1.0 / (len(nodes) + 1), 6)::DOUBLE AS relevance FROM walk WHERE depth >= {least})"""


@P.add(f"WITH RECURSIVE {TREE}, {_walk_sql('tree', 'SELECT unnest([$$r1$$]) AS id', 5, 'down')} SELECT * FROM found")
def g_traverse_down(t: Tables) -> DataFrame:
    return graph.scored(graph.paths(tree_of(t), _start(t, "r1"), 5))


@P.add(f"WITH RECURSIVE {TREE}, {_walk_sql('tree', 'SELECT DISTINCT dst AS id FROM tree WHERE dst[1] = $$c$$', 3, 'up')} SELECT * FROM found")
def g_traverse_up(t: Tables) -> DataFrame:
    tree = tree_of(t)
    back = tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")
    starts = tree.filter(F.col("dst").startswith("c")).select(F.col("dst").alias("start")).distinct()
    return graph.scored(graph.paths(back, starts, 3))


@P.add(f"WITH RECURSIVE {GRAPH}, {_walk_sql('edges', 'SELECT node_id AS id FROM nodes WHERE label = $$Condition$$ AND amount = 30', 2, 'up')} SELECT * FROM found WHERE \"end\"[1] = 's'")
def g_traverse_entity(t: Tables) -> DataFrame:
    """From a value back along edges of any type to products."""
    back = edges_of(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")
    starts = nodes_of(t).filter("label = 'Condition' and amount = 30").select(F.col("node_id").alias("start"))
    return graph.scored(graph.paths(back, starts, 2).filter(F.col("end").startswith("s")))


@P.add(f"WITH RECURSIVE {TREE}, {_walk_sql('tree', 'SELECT unnest([$$c10$$, $$c20$$]) AS id', 3, 'both')} SELECT * FROM found WHERE \"end\"[1] = 'c' AND \"end\" <> start ORDER BY path_length, path LIMIT 50")
def g_related(t: Tables) -> DataFrame:
    found = graph.paths(graph.both_ways(tree_of(t)), _start(t, "c10", "c20"), 3).filter(F.col("end").startswith("c") & (F.col("end") != F.col("start")))
    return graph.scored(found).orderBy("path_length", "path").limit(50)


@P.add("""
WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (10, 20, 30, 40))
SELECT 'c' || a.c_custkey AS start, 'c' || b.c_custkey AS goal, CASE WHEN a.c_custkey = b.c_custkey THEN 'c' || a.c_custkey WHEN a.c_nationkey = b.c_nationkey THEN concat_ws('>', 'c' || a.c_custkey, 'n' || a.c_nationkey, 'c' || b.c_custkey)
 ELSE concat_ws('>', 'c' || a.c_custkey, 'n' || a.c_nationkey, 'r' || a.n_regionkey, 'n' || b.c_nationkey, 'c' || b.c_custkey) END AS path FROM c a, c b WHERE a.n_regionkey = b.n_regionkey""")
def g_shortest(t: Tables) -> DataFrame:
    ids = t.customer.filter("c_custkey in (10, 20, 30, 40)").select(_key("c", "c_custkey").alias("start"))
    every = [f"c{i}" for i in (10, 20, 30, 40)]
    pairs = ids.withColumn("goal", F.explode(F.array(*[F.lit(i) for i in every])))
    return graph.shortest_paths(tree_of(t), pairs, 4).select("start", "goal", F.array_join("nodes", ">").alias("path"))


@P.add("SELECT n AS path_length, round(1.0 / (n + 1), 6)::DOUBLE AS relevance FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)")
def g_path_score(t: Tables) -> DataFrame:
    some = t.part.select(F.col("p_size").alias("n")).distinct().withColumn("nodes", F.sequence(F.lit(1), F.col("n")))
    return graph.scored(some.select(F.lit("a").alias("start"), F.lit("b").alias("end"), F.col("nodes").cast("array<string>").alias("nodes"))).select("path_length", "relevance")


@P.add(f"""
WITH {TREE} SELECT n.id AS node, (SELECT coalesce(string_agg(src, ',' ORDER BY src), '') FROM tree WHERE dst = n.id) AS parents, (SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM tree WHERE src = n.id) AS children
FROM (SELECT DISTINCT src AS id FROM tree WHERE src[1] = 'n') n""")
def g_context(t: Tables) -> DataFrame:
    tree = tree_of(t)
    around = lambda key, other, name: tree.groupBy(F.col(key).alias("node")).agg(F.array_join(F.array_sort(F.collect_set(other)), ",").alias(name))
    centres = tree.filter(F.col("src").startswith("n")).select(F.col("src").alias("node")).distinct()
    found = centres.join(around("dst", "src", "parents"), "node", "left").join(around("src", "dst", "children"), "node", "left")
    return found.select("node", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("children", F.lit("")).alias("children"))


@P.add(f"""
WITH {TREE}, e AS (SELECT src, dst FROM tree UNION ALL SELECT dst, src FROM tree), one AS (SELECT dst AS id FROM e WHERE src = 'n3'), two AS (SELECT id FROM one UNION SELECT dst FROM e JOIN one ON e.src = one.id UNION SELECT 'n3')
SELECT src, dst, rel_type FROM tree WHERE src IN (FROM two) AND dst IN (FROM two)""")
def g_neighborhood(t: Tables) -> DataFrame:
    tree = tree_of(t)
    near = graph.reachable(graph.both_ways(tree), _start(t, "n3"), 2).select(F.col("end").alias("node_id"))
    return graph.induced(tree, near)


@P.add(f"""
WITH {GRAPH}, x AS (SELECT dst AS other, rel_type, 'outgoing' AS direction FROM edges WHERE src = 'dBrand#3' UNION ALL SELECT src, rel_type, 'incoming' FROM edges WHERE dst = 'dBrand#3')
SELECT other, label, rel_type, direction FROM x JOIN nodes ON node_id = other ORDER BY other, rel_type LIMIT 50""")
def g_node_detail(t: Tables) -> DataFrame:
    e = edges_of(t)
    out = e.filter("src = 'dBrand#3'").select(F.col("dst").alias("other"), "rel_type", F.lit("outgoing").alias("direction"))
    near = out.unionByName(e.filter("dst = 'dBrand#3'").select(F.col("src").alias("other"), "rel_type", F.lit("incoming").alias("direction")))
    return near.join(nodes_of(t), F.col("node_id") == F.col("other")).orderBy("other", "rel_type").limit(50).select("other", "label", "rel_type", "direction")


_SUBGRAPH = f"""
WITH {GRAPH}, chosen AS (SELECT node_id FROM nodes n WHERE {{keep}} AND EXISTS (SELECT 1 FROM edges WHERE src = n.node_id OR dst = n.node_id) ORDER BY node_id LIMIT {{limit}})
SELECT src, dst, rel_type FROM edges WHERE src IN (FROM chosen) AND dst IN (FROM chosen)"""


@P.add(_SUBGRAPH.format(keep="label IN ('Coverage', 'Disease')", limit=500))
def g_subgraph(t: Tables) -> DataFrame:
    return graph.filtered_subgraph(nodes_of(t), edges_of(t), F.col("label").isin("Coverage", "Disease"), 500)[1]


@P.add(_SUBGRAPH.format(keep="(label IN ('Condition', 'Product') OR code = 'PROMO')", limit=1000))
def g_subgraph_v2(t: Tables) -> DataFrame:
    return graph.filtered_subgraph(nodes_of(t), edges_of(t), F.col("label").isin("Condition", "Product") | F.coalesce(F.col("code") == "PROMO", F.lit(False)), 1000)[1]


@P.add(f"WITH RECURSIVE {TREE}, {_walk_sql('tree', 'SELECT DISTINCT dst AS id FROM tree WHERE dst[1] = $$o$$', 2, 'up', 0)} SELECT start AS node, \"end\" AS ancestor FROM found WHERE \"end\"[1] = 'n'")
def g_hier_expand(t: Tables) -> DataFrame:
    """The owner of a node at most two steps above it."""
    tree = tree_of(t)
    back = tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")
    starts = tree.filter(F.col("dst").startswith("o")).select(F.col("dst").alias("start")).distinct()
    return graph.paths(back, starts, 2, least=0).filter(F.col("end").startswith("n")).select(F.col("start").alias("node"), F.col("end").alias("ancestor"))


@P.add(f"WITH {GRAPH} SELECT node_id, label FROM nodes n WHERE label <> 'Product' AND NOT EXISTS (SELECT 1 FROM edges WHERE src = n.node_id OR dst = n.node_id)")
def g_orphans(t: Tables) -> DataFrame:
    return graph.orphans(nodes_of(t), edges_of(t), "Product").select("node_id", "label")


@P.add(f"""
WITH {GRAPH}, wrong AS (SELECT src, dst FROM edges WHERE rel_type = 'COVERS' UNION ALL SELECT 's' || s_suppkey, 'p' || s_suppkey FROM supplier WHERE s_acctbal < 0)
SELECT w.src, w.dst FROM wrong w LEFT JOIN nodes a ON a.node_id = w.src LEFT JOIN nodes b ON b.node_id = w.dst WHERE NOT coalesce(a.label = 'Coverage' AND b.label = 'Disease', false)""")
def g_bad_edges(t: Tables) -> DataFrame:
    """COVERS edges of overdrawn suppliers are added to have some that are wrong."""
    added = t.supplier.filter("s_acctbal < 0").select(_key("s", "s_suppkey").alias("src"), _key("p", "s_suppkey").alias("dst"), F.lit("COVERS").alias("rel_type"))
    return graph.mislabelled(nodes_of(t), edges_of(t).unionByName(added), "COVERS", "Coverage", "Disease").select("src", "dst")


@P.add(f"WITH RECURSIVE {TREE}, up(node, ancestor, depth) AS (SELECT dst, src, 1 FROM tree UNION ALL SELECT node, t.src, depth + 1 FROM up JOIN tree t ON t.dst = up.ancestor) SELECT node, ancestor, depth::INT AS depth FROM up")
def g_subtype(t: Tables) -> DataFrame:
    tree = tree_of(t)
    return graph.closure(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type"), 3)


@P.add("""
SELECT 'doc' || conv_id AS policy, 'doc' || conv_id || '_article_' || turn AS node_id, 'Article' AS label FROM conversations
UNION ALL SELECT 'doc' || conv_id, 'doc' || conv_id || '_article_' || turn || '_para_' || i, 'Paragraph' FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM conversations)""")
def g_build_hierarchy(t: Tables) -> DataFrame:
    """Articles are turns, paragraphs their lines; ids tell the place."""
    article = F.concat(F.lit("doc"), F.col("conv_id").cast("string"), F.lit("_article_"), F.col("turn").cast("string"))
    rows = t.conversations.select(F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("policy"), article.alias("node_id"), "text")
    lines = rows.select("policy", F.posexplode(F.split("text", "\n")).alias("i", "line"), "node_id")
    return rows.select("policy", "node_id", F.lit("Article").alias("label")).unionByName(lines.select("policy", F.concat_ws("_para_", "node_id", (F.col("i") + 1).cast("string")).alias("node_id"), F.lit("Paragraph").alias("label")))


@P.add("""
WITH r AS (SELECT l_orderkey, l_linenumber, p_name AS subject, CASE l_returnflag WHEN 'R' THEN 'EXCLUDES' WHEN 'A' THEN 'COVERS' ELSE 'NOTES' END AS action, CASE WHEN s_acctbal > 0 THEN s_name END AS object, l_linestatus AS condition FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
e AS (SELECT DISTINCT 'product' AS a, 'HAS_COVERAGE' AS rel_type, subject AS b FROM r UNION ALL SELECT DISTINCT subject, action, object FROM r WHERE action <> 'NOTES' AND object IS NOT NULL
UNION ALL SELECT * FROM (SELECT subject, 'REQUIRES', condition FROM r QUALIFY row_number() OVER (PARTITION BY condition ORDER BY l_orderkey, l_linenumber, subject) = 1))
SELECT substr(md5(a), 1, 16) AS src, rel_type, substr(md5(b), 1, 16) AS dst FROM e""")
def g_build_domain(t: Tables) -> DataFrame:
    """The graph of a product from relations of parts (coverages) and suppliers (diseases, of which some cannot be linked)."""
    action = F.when(F.col("l_returnflag") == "R", "EXCLUDES").when(F.col("l_returnflag") == "A", "COVERS").otherwise("NOTES")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("subject"))
    known = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("object"))
    found = t.lineitem.join(parts, "l_partkey").join(known, "l_suppkey").select("l_orderkey", "l_linenumber", "subject", action.alias("action"), "object", F.col("l_linestatus").alias("condition"))
    return extractions.domain_graph(found, "product", ["l_orderkey", "l_linenumber"])


@P.add("""
SELECT 'o' || l_orderkey AS src, 'a' || l_orderkey || '_' || l_linenumber AS dst, 'HAS_ARTICLE' AS rel_type FROM lineitem
UNION SELECT 'p' || l_partkey, 'a' || l_orderkey || '_' || l_linenumber, 'EXTRACTED_FROM' FROM lineitem""")
def g_build_doc(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", F.concat(F.lit("a"), F.concat_ws("_", "l_orderkey", "l_linenumber")).alias("dst"))
    owned = lines.select(_key("o", "l_orderkey").alias("src"), "dst", F.lit("HAS_ARTICLE").alias("rel_type"))
    return owned.unionByName(lines.select(_key("p", "l_partkey").alias("src"), "dst", F.lit("EXTRACTED_FROM").alias("rel_type"))).distinct()


_RULES = [("view", "click", "leads_to"), ("click", "purchase", "leads_to"), ("view", "purchase", "precedes"), ("signup", "purchase", "precedes"), ("view", "click", "precedes"), ("click", "purchase", "precedes")]
_ENHANCED = """
WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80), r(a, b, rel_type, rank) AS (VALUES ('view', 'click', 'leads_to', 1), ('click', 'purchase', 'leads_to', 2), ('view', 'purchase', 'precedes', 3), ('signup', 'purchase', 'precedes', 4), ('view', 'click', 'precedes', 5), ('click', 'purchase', 'precedes', 6))
SELECT x.user_id || x.event_type AS src, y.user_id || y.event_type AS dst, r.rel_type FROM e x JOIN r ON x.event_type = r.a JOIN e y ON y.event_type = r.b AND y.user_id = x.user_id QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY rank) = 1"""


@P.add(_ENHANCED)
def g_enhance(t: Tables) -> DataFrame:
    """Rules in order, each without the edges between nodes that an earlier one joined."""
    e = t.events.filter("value > 80").select("user_id", "event_type").distinct().withColumn("id", F.concat("user_id", "event_type"))
    made: DataFrame | None = None
    for a, b, rel in _RULES:
        found = e.filter(F.col("event_type") == a).select("user_id", F.col("id").alias("src")).join(e.filter(F.col("event_type") == b).select("user_id", F.col("id").alias("dst")), "user_id")
        new = found.select("src", "dst", F.lit(rel).alias("rel_type"))
        made = new if made is None else made.unionByName(joins.without_edge(new, made))
    return made


@P.add("""
WITH e AS (SELECT p_partkey AS id, p_name AS label, p_type AS type, p_brand AS doc FROM part),
f AS (SELECT label, type, min(id) AS a, arg_min(doc, id) AS own FROM e GROUP BY label, type), c AS (SELECT label, type, min(id) AS c FROM e JOIN f USING (label, type) WHERE doc <> own GROUP BY label, type),
r AS (SELECT CASE WHEN doc <> own THEN a ELSE c END AS x, id AS y, 'similar_across_documents' AS rel_type, 1 AS rule FROM e JOIN f USING (label, type) JOIN c USING (label, type) WHERE id <> a
UNION ALL SELECT min(id) OVER (PARTITION BY type), id, 'type_cluster', 2 FROM e
UNION ALL SELECT min(id) OVER (PARTITION BY lower(label)), id, 'semantically_related', 3 FROM e WHERE length(label) > 3
UNION ALL SELECT m.id, n.id, 'semantically_related', 3 FROM (SELECT lower(label) AS l, min(id) AS id FROM e WHERE length(label) > 3 GROUP BY 1) m JOIN (SELECT lower(label) AS l, min(id) AS id FROM e WHERE length(label) > 3 GROUP BY 1) n ON contains(m.l, n.l)
UNION ALL SELECT min(id) OVER (PARTITION BY doc), id, 'in_same_document', 4 FROM e)
SELECT least(x, y) AS src, greatest(x, y) AS dst, arg_min(rel_type, rule) AS rel_type FROM r WHERE x <> y GROUP BY 1, 2""")
def g_enhance_all(t: Tables) -> DataFrame:
    """Four rules in order, each between what no earlier one joined; groups are joined by stars, brands stand for documents."""
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"), F.col("p_brand").alias("doc"))
    named = e.filter(F.length("label") > 3).withColumn("low", F.lower("label"))
    rules = [
        ("similar_across_documents", joins.stars_across(e, ["label", "type"], "doc")), ("type_cluster", joins.stars(e, ["type"])),
        ("semantically_related", joins.stars(named, ["low"]).unionByName(joins.containing(e, "label")).distinct()), ("in_same_document", joins.stars(e, ["doc"])),
    ]
    made: DataFrame | None = None
    for rel, found in rules:
        found = found.withColumn("rel_type", F.lit(rel))
        made = stored(found if made is None else made.unionByName(joins.without_edge(found, made)), "enhanced")
    return made
