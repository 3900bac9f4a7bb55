"""The most similar rows of each query, in blocks, against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from veldgraph.operators import vector

SCHEMA = "vec_id long, embedding array<float>, note string"


def _plain(rows: list, asked: list, k: int) -> set:
    whole = lambda v: v is not None and None not in v
    out = set()
    for q, a, _ in asked:
        scored = []
        for i, b, _ in rows:
            if whole(a) and whole(b) and len(a) == len(b):
                size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                scored.append((-round(sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0, 12), i))
        out |= {(q, i, round(-s, 6), n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_best_of_all_blocks(spark, block):  # noqa: ANN001
    """Ties, zero vectors, another length, nulls, and blocks of fewer rows than k."""
    numbers = np.random.default_rng(3).integers(-2, 3, (40, 3)).tolist()
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(numbers)]
    rows += [(50, [0.0, 0.0, 0.0], None), (60, None, None), (61, [1.0, None, 2.0], None), (70, [1.0, 2.0], None), (71, [2.0, 4.0], None), (72, [], None)]
    asked = [r for r in rows if r[0] % 5 == 0]
    found = vector.top_k_each(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), 4, block=block)
    got = [(r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(rows, asked, 4)


def test_no_queries_or_rows(spark):  # noqa: ANN001
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0], None)], SCHEMA)
    assert vector.top_k_each(one, none, 3).count() == vector.top_k_each(none, one, 3).count() == 0
