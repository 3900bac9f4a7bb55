"""Every query that has SQL gives the same rows as its SQL; the others run. All read tables."""

from __future__ import annotations

import pytest

from tests.compare import connection, difference
from veldgraph import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    return connection(SF)


def _reads(df) -> bool:  # noqa: ANN001
    """Whether the rows come from a stored table, not from literals."""
    return "Relation [" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):  # noqa: ANN001
    found = QUERIES[name](spark, SF)
    assert _reads(found)
    assert difference(found, con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):  # noqa: ANN001
    found = QUERIES[name](spark, SF)
    assert _reads(found)
    assert found.count() > 0
