"""Writes as pure functions from an old table and changes to a new table; Parquet has no merge, so the caller writes the result to a new place and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``new`` replace old ones with their key; of several new ones the first in ``order`` counts."""
    last = new.withColumn("rn_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("rn_ = 1").drop("rn_")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet are added, one for each key."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").dropDuplicates(key).select(*old.columns))


def merge_nodes(old: DataFrame, new: DataFrame, key: str, on_create: tuple[str, ...] = ()) -> DataFrame:
    """New values win over old ones, old ones stay where there is no new one; ``on_create`` columns are set only when a node is made."""
    others = [c for c in old.columns if c != key]
    a = old.select(key, *[F.col(c).alias(f"{c}_old_") for c in others])
    b = new.select(key, *[F.col(c).alias(f"{c}_new_") for c in others])
    pick = lambda c: F.coalesce(f"{c}_old_", f"{c}_new_") if c in on_create else F.coalesce(f"{c}_new_", f"{c}_old_")
    return a.join(b, key, "full").select(key, *[pick(c).alias(c) for c in others])


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """At most one edge of a type between two nodes; edges without both ends are left out."""
    ids = nodes.select("node_id").distinct()
    known = new.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return insert_missing(old, known, ["src", "dst", "rel_type"])


def synced(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as nodes and edges: types become labels, relation types upper case with underscores."""
    nodes = entities.select("entity_id", F.initcap("type").alias("label"), F.col("name"))
    edges = relations.select("src", "dst", F.upper(F.translate("type", "- ", "__")).alias("rel_type")).distinct()
    return nodes, edges


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def exposition(metrics: DataFrame, name: str, value: str, label: str) -> DataFrame:
    """Metrics as lines of text: name{label="x"} value."""
    return metrics.select(F.format_string(f'{name}{{{label}="%s"}} %s', F.col(label), F.col(value).cast("string")).alias("line"))
