"""All queries of the library but those of the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "analytics", "graph", "retrieval", "texts", "rules", "ingest", "sinks", "streams", "search", "stores")

Query = Callable[[SparkSession, str], DataFrame]


def _collected(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"veldgraph.plans.{name}"), kind).items():
            if key in out:
                raise ValueError(f"two queries have the name {key}")
            out[key] = value
    return out


def queries() -> dict[str, Query]:
    return _collected("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collected("ORACLES")
