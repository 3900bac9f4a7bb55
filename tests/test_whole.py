"""Queries that take whole tables, against plain versions on small ones."""

from __future__ import annotations

import re

import duckdb
import pytest

from tests.compare import difference
from veldgraph import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def business(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    """Customers with keys on both sides of 150 and orders of all prices; customer 7 has events and no order."""
    sf = str(tmp_path_factory.mktemp("business"))
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R0"), (1, "R1")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 1), (2, "N2", 1), (3, "N3", 0)]),
        "customer": ("c_custkey long, c_nationkey int", [(7, 0), (10, 0), (20, 1), (149, 1), (150, 1), (200, 2)]),
        "orders": ("o_orderkey long, o_custkey long, o_totalprice double", [(1, 10, 5.0), (2, 10, 400000.0), (3, 150, 1.0), (4, 150, 2.0), (5, 150, 3.0), (6, 200, 350000.0), (7, 20, 9.0)]),
        "events": ("event_id long, user_id long, value double", [(1, 7, 1.0), (2, 150, 4.0), (3, 150, 5.0), (4, 149, 30.0), (5, 200, None), (6, 10, 2.0)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    return sf, {name: rows for name, (_, rows) in tables.items()}


def test_fanout_of_all_customers(spark, business):
    sf, rows = business
    want = {}
    for nation, _, _ in rows["nation"]:
        users = [c for c, n in rows["customer"] if n == nation]
        orders, events = [o for o in rows["orders"] if o[1] in users], [e for e in rows["events"] if e[1] in users]
        fanned = [v for c in users for _ in range(max(1, sum(o[1] == c for o in orders))) for _, u, v in events if u == c and v is not None]
        want[nation] = (len(users), len(orders), len(events), round(sum(fanned) / len(fanned), 6) if fanned else None)
    got = {r["n_nationkey"]: (r["customers"], r["policies"], r["queries"], r["avg_value"]) for r in QUERIES["jn_fanout3"](spark, sf).collect()}
    assert got == want


def test_tree_holds_all_customers_and_orders(spark, business):
    sf, rows = business
    up = {f"n{n}": f"r{r}" for n, _, r in rows["nation"]} | {f"c{c}": f"n{n}" for c, n in rows["customer"]} | {f"o{o}": f"c{c}" for o, c, _ in rows["orders"]}
    want = set()
    for node in up:
        at, depth = node, 0
        while at in up:
            at, depth = up[at], depth + 1
            want.add((node, at, depth))
    assert {(r["node"], r["ancestor"], r["depth"]) for r in QUERIES["g_subtype"](spark, sf).collect()} == want
    owners = {(o, up[c]) for o, c in up.items() if o.startswith("o")}
    assert {(r["node"], r["ancestor"]) for r in QUERIES["g_hier_expand"](spark, sf).collect()} == owners
    children = {r["node"]: r["children"] for r in QUERIES["g_context"](spark, sf).collect()}
    assert children == {n: ",".join(sorted(x for x in up if up[x] == n)) for n in {v for v in up.values() if v.startswith("n")}}


def test_templates_and_chunks_of_all_documents(spark, tmp_path):
    long = " ".join(f"word{i % 7}x{i}" for i in range(60))
    rows = [
        (5, "Signed within 90일 by\n the owner", "en", "a"), (30, "Signed within 30일 by the owner", "en", "a"), (40, "nothing of it", "de", "a"), (41, None, "de", "a"),
        (50, long, "en", "b"), (51, long[:250], "en", "b"), (52, "é" * 100 + "\n" + long, None, "b"), (53, "", "en", "c"), (54, "alone", "en", None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def score(template: str, body: str) -> float:
        kept, plain = re.sub(r"\{[^}]+\}|\s+", "", template), re.sub(r"\s+", "", body)
        blocks = [kept[i : i + 100] for i in range(0, len(kept), 100)]
        return sum(len(b) for b in blocks if b in plain) / len(kept) if kept else 0

    templates = {"a": "Signed within {days} by\n the owner", "b": long, "c": "", None: "alone"}
    got = {r["doc_id"]: r["share"] for r in QUERIES["s_template_match"](spark, str(tmp_path)).collect()}
    assert got == {i: score(templates[source], body or "") for i, body, _, source in rows}
    assert got[50] == got[52] == got[54] == 1 and 0 < got[51] < 1
    written = QUERIES["snk_chunk_files"](spark, str(tmp_path)).collect()
    for file in ("chunks", "metadata"):
        assert {r["doc_id"]: (r["n"], r["length"]) for r in written if r["file"] == file} == {i: (-(-len(body or "") // 100), len(body or "")) for i, body, _, _ in rows}
    assert sum(r["length"] for r in written if r["file"] == "stats") == sum(len(body or "") for _, body, _, _ in rows)


def test_diffs_of_all_documents(spark, tmp_path):
    """Also of those without a text, which is an empty one; an empty text has no lines, and one is added to it."""
    texts = [None, "", "a", "\n", "a\nb", "b\nb\nb", "changed \n"]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("s_diff", "s_incremental"):
        assert difference(QUERIES[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) == ""
    got = {r["doc_id"]: (r["added"], r["removed"]) for r in QUERIES["s_diff"](spark, str(tmp_path)).collect()}
    assert got == {i: (int(i % 3 != 1), int(i % 3 == 2 and bool(t))) for i, t in rows}
