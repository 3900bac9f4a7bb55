"""Named queries on the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldgraph.storage import load

#: "Now" of the dashboards: the day after the last order, and after the last event.
ORDERS_AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"


class Tables:
    """The tables of one data directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


class Plans:
    """Collects queries: functions of ``Tables`` that return a DataFrame, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def named(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            name = f.__name__
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return f

        return named
