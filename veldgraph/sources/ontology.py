"""Nested descriptions of diseases as flat entities, with indexes by name and by code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Categories with their subtypes, as a JSON text holds them.
SCHEMA = "map<string,struct<subtypes:map<string,struct<standard:string,korean_names:array<string>,english_names:array<string>,kcd_codes:array<string>,severity:string>>>>"


def entities(nested: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """(load, category, standard_name, names, kcd_codes, severity) of a column of JSON texts; ``load`` is the order of the texts by the column ``order``, then that in a text."""
    at = F.lit(0) if order is None else F.col(order)
    parsed = nested.select(at.alias("at"), F.map_entries(F.from_json(column, SCHEMA)).alias("c")).select("at", F.posexplode("c").alias("i", "c"))
    each = parsed.select("at", "i", F.col("c.key").alias("category"), F.posexplode(F.map_entries("c.value.subtypes")).alias("j", "s")).select("at", "i", "j", "category", "s.value.*")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    names = F.concat(F.array("standard"), listed("korean_names"), listed("english_names"))
    return each.select(F.struct("at", "i", "j").alias("load"), "category", F.col("standard").alias("standard_name"), names.alias("names"), listed("kcd_codes").alias("kcd_codes"), "severity")


def by_name(known: DataFrame) -> DataFrame:
    """(name, standard_name): lower-case names; of entities with one name the last loaded counts."""
    return known.select("load", "standard_name", F.explode("names").alias("name")).groupBy(F.lower("name").alias("name")).agg(F.max_by("standard_name", "load").alias("standard_name"))


def by_code(known: DataFrame) -> DataFrame:
    return known.select("load", "standard_name", F.explode("kcd_codes").alias("code")).groupBy("code").agg(F.max_by("standard_name", "load").alias("standard_name"))


def stats(known: DataFrame) -> DataFrame:
    """Entities, different codes and severities of each category."""
    codes = known.select("category", F.explode_outer("kcd_codes").alias("code"), "load", "severity")
    return codes.groupBy("category").agg(F.countDistinct("load").alias("entities"), F.countDistinct("code").alias("codes"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))
