"""The inverted-list index: recall against the exact search, exactness by bounds, and which folders a search opens."""

from __future__ import annotations

import numpy as np
import pytest

from veldgraph.operators import vector, vector_index
from veldgraph.storage import load, scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def built(spark):  # noqa: ANN001, ANN201
    rows = load(spark, SF, "embeddings")
    return rows, vector_index.written(rows, scratch_path(spark, "index"), lists=16)


def _lists(df):  # noqa: ANN001, ANN202
    out: dict[int, list[int]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_recall(built):
    rows, index = built
    queries = rows.filter("vec_id % 50 = 0")
    want = _lists(vector.top_k_each(rows, queries, 10))
    recall = lambda probes: np.mean([len(set(want[q]) & set(got)) / len(want[q]) for q, got in _lists(vector_index.probed(index, queries, 10, probes)).items()])
    assert recall(None) >= 0.9
    assert recall(16) == 1.0
    assert recall(1) < 0.9


def test_an_index_is_opened_again(spark, built):
    rows, index = built
    again = vector_index.opened(spark, index.path)
    assert np.allclose(again.centres, index.centres) and again.probes == index.probes
    queries = rows.filter("vec_id = 3")
    assert _lists(vector_index.probed(again, queries, 5)) == _lists(vector_index.probed(index, queries, 5))


def test_exact_equals_the_search_of_all_rows(built):
    rows, index = built
    queries = rows.filter("vec_id % 50 = 0")
    rest = sorted(map(tuple, vector.top_k_each(rows, queries, 10).select("query_id", "id", "rank").collect()))
    assert sorted(map(tuple, vector_index.exact(index, queries, 10, 2).select("query_id", "id", "rank").collect())) == rest


def test_every_row_is_in_a_list(built):
    rows, index = built
    assert index.rows().count() == rows.count() == index.sizes.sum()
    one = int(np.argmax(index.sizes))
    plan = index.rows([one])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and index.rows([one]).count() == index.sizes[one]


def test_odd_vectors(spark):
    """Nulls, zero vectors, repeated vectors, another length, fewer rows than k, and an empty table."""
    unit = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [1.0, 0.0], [0.0, 0.0]]
    rows = spark.createDataFrame([*enumerate(unit), (5, None), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    index = vector_index.written(rows, scratch_path(spark, "index"), lists=3)
    assert index.rows().count() == 5
    queries = rows.filter("vec_id in (0, 2, 4)")
    want = _lists(vector.top_k_each(rows.filter("vec_id < 5"), queries, 10))
    assert _lists(vector_index.exact(index, queries, 10, 1)) == want
    assert _lists(vector_index.exact(index, queries, 2, 1)) == {q: ids[:2] for q, ids in want.items()}
    empty = vector_index.written(rows.limit(0), scratch_path(spark, "index"))
    assert vector_index.probed(empty, queries, 3, 2).count() == 0


def test_clustered_rows_leave_lists_closed(spark):
    """Where rows lie in clusters the bounds close most lists."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = spark.createDataFrame([(i, (centres[i % 20] + 0.02 * rng.normal(size=16)).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    index = vector_index.written(rows, scratch_path(spark, "index"), lists=20)
    asked = vector_index._asked(index, rows, "vec_id", "embedding").selectExpr("id", "v", "0.9D as least")
    assert vector_index._chosen(index, asked, 1, least=True).count() < 600
    assert index.probes <= 3
    queries = rows.filter("vec_id % 50 = 0")
    assert _lists(vector_index.exact(index, queries, 5, 1)) == _lists(vector.top_k_each(rows, queries, 5))
