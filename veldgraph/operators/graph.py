"""A property graph as two tables and what is asked of it.

``nodes``: node_id, label, name, code, amount. ``edges``: src, dst, rel_type. Patterns
are joins; traversals are a join for each step, with bounded depth. Each step is
written to the shared folder, so nothing is collected, lineage stays short and the
size of a plan grows with the depth only. Edges are not repeated within a path; nodes
may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldgraph.operators.joins import union_all
from veldgraph.storage import stored

NODE = ("node_id", "label", "name", "code", "amount")


def of_label(nodes: DataFrame, label: str, prefix: str) -> DataFrame:
    """The nodes of one label with prefixed columns."""
    return nodes.filter(F.col("label") == label).select(*[F.col(c).alias(f"{prefix}_{c.removeprefix('node_')}") for c in NODE if c != "label"])


def ends(edges: DataFrame, rel_type: str, src: str, dst: str) -> DataFrame:
    """The distinct ends of the edges of one type."""
    return edges.filter(F.col("rel_type") == rel_type).select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def related(nodes: DataFrame, edges: DataFrame, rel_type: str, left: str, right: str, a: str, b: str, optional: bool = False) -> DataFrame:
    """Nodes of label ``left`` with those of label ``right`` that an edge of the type joins, whichever way it runs. With ``optional`` all of the left stay."""
    links = both_ways(edges.filter(F.col("rel_type") == rel_type)).select(F.col("src").alias(f"{a}_id"), F.col("dst").alias(f"{b}_id")).distinct()
    return of_label(nodes, left, a).join(links.join(of_label(nodes, right, b), f"{b}_id"), f"{a}_id", "left" if optional else "inner")


def pattern(nodes: DataFrame, edges: DataFrame, *chain: tuple[str, str]) -> DataFrame:
    """Matches of a chain of nodes (alias, label) and, between two of them, edges (type, ``out``, ``in`` or ``any``): the columns of each node with its alias as prefix.

    Each edge is one join with the node behind it; an edge that stands several times matches once.
    """
    found = of_label(nodes, chain[0][1], chain[0][0])
    for k in range(1, len(chain), 2):
        (rel_type, way), (alias, label), here = chain[k], chain[k + 1], f"{chain[k - 1][0]}_id"
        out = ends(edges, rel_type, here, f"{alias}_id")
        links = {"out": out, "in": ends(edges, rel_type, f"{alias}_id", here).select(here, f"{alias}_id"), "any": None}[way]
        if links is None:
            links = out.unionByName(ends(edges, rel_type, f"{alias}_id", here)).distinct()
        found = found.join(links, here).join(of_label(nodes, label, alias), f"{alias}_id")
    return found


def coverage_amounts(nodes: DataFrame, edges: DataFrame, disease: str) -> DataFrame:
    found = related(nodes.filter((F.col("label") != "Disease") | (F.col("name") == disease)), edges, "COVERS", "Disease", "Coverage", "d", "c")
    return found.select(F.col("d_name").alias("disease"), F.col("c_name").alias("coverage"), F.col("c_amount").alias("amount"))


def coverage_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each disease, whether a coverage covers it, and which; those stand in order of their ids."""
    found = related(nodes, edges, "COVERS", "Disease", "Coverage", "d", "c", optional=True)
    rows = found.groupBy("d_id", "d_name").agg(F.count("c_id").alias("n_coverages"), F.array_sort(F.collect_list(F.when(F.col("c_id").isNotNull(), F.struct("c_id", "c_amount")))).alias("x"))
    return rows.select(F.col("d_name").alias("disease"), (F.col("n_coverages") > 0).alias("is_covered"), "n_coverages", F.array_join(F.transform("x", lambda c: F.concat_ws(":", c["c_id"], c["c_amount"])), ",").alias("coverages"))


def comparison(nodes: DataFrame, edges: DataFrame, label: str, other: str, first: str, second: str) -> DataFrame:
    """One row with what two nodes of a label are related to; none if either is related to nothing."""
    found = related(nodes.filter((F.col("label") != label) | F.col("name").isin(first, second)), edges, "COVERS", label, other, "a", "b")
    sets = found.groupBy("a_name").agg(F.array_sort(F.collect_set("b_id")).alias("x"))
    side = lambda name: F.max(F.when(F.col("a_name") == name, F.col("x")))
    row = sets.groupBy().agg(side(first).alias("x"), side(second).alias("y")).filter("x is not null and y is not null")
    show = lambda x: F.array_join(x, ",")
    return row.select(
        F.lit(first).alias("first"), F.lit(second).alias("second"), show(F.array_except("x", "y")).alias("only_first"), show(F.array_except("y", "x")).alias("only_second"), show(F.array_intersect("x", "y")).alias("common")
    )


def step(paths: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """Paths one edge longer, no edge used twice."""
    out = edges.select(F.col("src").alias("end"), F.col("dst").alias("next_"), F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst"), "rel_type").alias("edge_"))
    longer = paths.join(out, "end").filter(~F.array_contains("used", F.col("edge_")))
    return longer.select("start", F.col("next_").alias("end"), F.array_append("nodes", F.col("next_")).alias("nodes"), F.array_append("used", F.col("edge_")).alias("used"), F.lit(level).alias("depth"))


def paths(edges: DataFrame, starts: DataFrame, depth: int, least: int = 1) -> DataFrame:
    """All paths of ``least`` to ``depth`` edges from ``starts`` (column start) along the edges' direction: start, end, nodes, used, depth.

    The last step is not written, so a filter on its ends is one on the edges that it joins.
    """
    now = starts.select("start", F.col("start").alias("end"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("used"), F.lit(0).alias("depth"))
    found = [now] if least == 0 else []
    for level in range(1, depth + 1):
        now = step(now, edges, level)
        if level < depth:
            now = stored(now, "walk")
        if level >= least:
            found.append(now)
    return union_all(found)


def scored(found: DataFrame) -> DataFrame:
    """Paths as text with their length in nodes and relevance 1 / (nodes + 1)."""
    n = F.size("nodes")
    return found.select("start", "end", F.array_join("nodes", ">").alias("path"), n.cast("long").alias("path_length"), F.round(1.0 / (n + 1), 6).alias("relevance"))


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, end, depth) of the nodes within ``depth`` steps, each at its least depth. Sets, not paths, are carried from step to step; each step is written once, so plans grow by a line and not by a factor."""
    seen = starts.select("start", F.col("start").alias("end"), F.lit(0).alias("depth")).distinct()
    front = seen
    for level in range(1, depth + 1):
        found = front.select("start", "end").join(edges.select(F.col("src").alias("end"), F.col("dst").alias("next_")), "end").select("start", F.col("next_").alias("end")).distinct()
        front = stored(found.join(seen.select("start", "end"), ["start", "end"], "left_anti").withColumn("depth", F.lit(level)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """For each pair (start, goal) its shortest path of at most ``depth`` edges, any way along them; of several the least as a list of ids. Pairs without one are left out.

    Breadth first: a node is carried on at its least depth only, with its least path.
    """
    links = both_ways(edges).select(F.col("src").alias("end"), F.col("dst").alias("next_")).distinct()
    goals = pairs.select("start", "goal").distinct()
    seen = goals.select("start", F.col("start").alias("end"), F.array("start").alias("nodes")).distinct()
    front = seen
    for _ in range(depth):
        grown = front.join(links, "end").select("start", F.col("next_").alias("end"), F.array_append("nodes", F.col("next_")).alias("nodes"))
        least = grown.groupBy("start", "end").agg(F.min("nodes").alias("nodes"))
        front = stored(least.join(seen.select("start", "end"), ["start", "end"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return goals.join(seen, "start").filter("end = goal").select("start", "goal", "nodes")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members`` (column node_id)."""
    ids = members.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame, besides: str) -> DataFrame:
    """Nodes without an edge, but for one label."""
    touched = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return nodes.filter(F.col("label") != besides).join(touched, "node_id", "left_anti")


def mislabelled(nodes: DataFrame, edges: DataFrame, rel_type: str, src_label: str, dst_label: str) -> DataFrame:
    """Edges of a type whose ends have other labels."""
    label = lambda end: nodes.select(F.col("node_id").alias(end), F.col("label").alias(f"{end}_label"))
    marked = edges.filter(F.col("rel_type") == rel_type).join(label("src"), "src", "left").join(label("dst"), "dst", "left")
    right = (F.col("src_label") == src_label) & (F.col("dst_label") == dst_label)
    return marked.filter(~F.coalesce(right, F.lit(False)))


def filtered_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """At most ``limit`` nodes that have an edge, by id, and the edges among them."""
    touched = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    chosen = nodes.filter(keep).join(touched, "node_id", "left_semi").orderBy("node_id").limit(limit)
    return chosen, induced(edges, chosen)


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, depth) over SUBTYPE_OF-like edges src -> dst."""
    starts = edges.select(F.col("src").alias("start")).distinct()
    return reachable(edges, starts, depth).filter("depth > 0").select(F.col("start").alias("node"), F.col("end").alias("ancestor"), "depth")


# Labels and relations that a graph must have, and how bad it is if not.
NEEDED_LABELS = {"Product": "error", "Clause": "error", "Coverage": "warning", "Disease": "warning"}
NEEDED_RELATIONS = {"COVERS": "warning", "HAS_COVERAGE": "warning"}


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, severity, n) of a graph: nothing in it, labels and relations that are missing, several products, nodes without an edge, coverage edges between wrong labels. Each check is one row of an aggregate."""
    none = lambda df, condition: df.agg((F.count_if(condition) == 0).cast("long").alias("n"))
    found = [("no nodes", "critical", none(nodes, F.lit(True))), ("no edges", "warning", none(edges, F.lit(True)))]
    found += [(f"no {k}", s, none(nodes, F.col("label") == k)) for k, s in NEEDED_LABELS.items()]
    found += [(f"no {k}", s, none(edges, F.col("rel_type") == k)) for k, s in NEEDED_RELATIONS.items()]
    products = F.count_if(F.col("label") == "Product")
    found.append(("several Product", "warning", nodes.agg(F.when(products > 1, products).otherwise(0).alias("n"))))
    found.append(("orphans", "warning", orphans(nodes, edges, "").agg(F.count("*").alias("n"))))
    found.append(("invalid COVERS", "error", mislabelled(nodes, edges, "COVERS", "Coverage", "Disease").agg(F.count("*").alias("n"))))
    return union_all([df.select(F.lit(k).alias("issue"), F.lit(s).alias("severity"), "n") for k, s, df in found]).filter("n > 0")
