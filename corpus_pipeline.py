"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

language ID        rejects documents in which no language is found: null texts and texts without a letter
near duplicates    one document of each group stays, the one with the least doc_id
decontamination    documents that hold a benchmark item go
secret scan        secrets are replaced in the texts; every document stays
mixing             takes documents by the target weights of a tree of domain, language and source

Rows without a doc_id have no place in the order of ids: near duplicates keep them all. Rows
that repeat a doc_id are one document there: they stay or go together. Decontamination and
what comes after it judge each row by its own text, with or without an id. Columns
other than those of documents are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldgraph.llm import decontaminate, language_id, near_dedup, queries, secrets
from veldgraph.storage import load, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents but those of no language."""
    known = language_id.profiles(docs.filter(~language_id.held_out()))
    rows = docs.select(F.struct("*").alias("row"), "text")
    return language_id.predicted(rows, known, language_id.PROFILE_SIZE, "row").filter("lang_pred <> 'und'").select("row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that are near copies of an earlier one."""
    gone = stored(near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark item."""
    gone = stored(decontaminate.contamination(docs, load(spark, sf_dir, "benchmark")).select("doc_key").distinct(), "contaminated")
    return docs.join(gone, decontaminate.doc_key() == gone["doc_key"], "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with n_tokens and n_epochs."""
    return queries.mixed(docs, keep_text=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
]

#: Rank-order profiles, near-duplicate components and greedy tiling are no SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
