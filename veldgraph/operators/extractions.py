"""What was extracted from the chunks and relations of documents, merged into one set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldgraph.functions import nlq, parsers
from veldgraph.storage import stored

# How subclauses begin, by number or else by letter.
SUBCLAUSES = (r"(?:^|\n)\s*(\d+)\s*\.\s+", r"(?:^|\n)\s*([가-힣])\s*\.\s+")

#: Documents whose nodes are made distinct in one task, or so.
DEALT = 20_000


def node_id(name: str | Column) -> Column:
    return F.substring(F.md5(F.encode(name, "UTF-8")), 1, 16)


def merged_entities(found: DataFrame, label: str, entity_id: str, order: list[str]) -> DataFrame:
    """(label, id, mentions): the first entity of a label stands for all."""
    return found.groupBy(F.col(label).alias("label")).agg(F.min_by(entity_id, F.struct(*order, entity_id)).alias("id"), F.count(F.lit(1)).alias("mentions"))


def merged_relations(found: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    """Each relation between two entities once for a kind."""
    return found.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(kind).alias("type")).distinct()


def histogram(entities: DataFrame, entity_type: str, relations: DataFrame, relation_type: str) -> DataFrame:
    """(kind, type, n) of all chunks' entities and relations; a null type is ``unknown``."""
    count = lambda df, kind, column: df.groupBy(F.coalesce(column, F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(entities, "entity", entity_type).unionByName(count(relations, "relation", relation_type))


def domain_graph(relations: DataFrame, product: str, order: list[str]) -> DataFrame:
    """(src, rel_type, dst) of relations (subject, action, object, condition): names are hashed into ids.

    A subject is a coverage of the product. An object, null if it could not be linked, is a
    disease that the coverage covers or excludes; other actions make none. The first
    relation with a condition says which coverage requires it.
    """
    r = relations.select(*order, node_id("subject").alias("coverage"), "subject", "action", node_id("object").alias("disease"), node_id("condition").alias("condition"))
    owned = r.select(node_id(F.lit(product)).alias("src"), F.lit("HAS_COVERAGE").alias("rel_type"), F.col("coverage").alias("dst")).distinct()
    linked = r.filter(F.col("action").isin("COVERS", "EXCLUDES") & F.col("disease").isNotNull()).select(F.col("coverage").alias("src"), F.col("action").alias("rel_type"), F.col("disease").alias("dst")).distinct()
    first = r.filter("condition is not null").groupBy("condition").agg(F.min_by("coverage", F.struct(*order, "subject")).alias("src"))
    return owned.unionByName(linked).unionByName(first.select("src", F.lit("REQUIRES").alias("rel_type"), F.col("condition").alias("dst")))


def clause_graph(docs: DataFrame, policy: str, text: str) -> DataFrame:
    """(policy, parent, node_id, label): policies, their articles, paragraphs and subclauses, and the amounts, periods and codes that a policy names, each once.

    Ids tell the place, or the value and its policy. A null text gives its policy alone; a null policy is left out.
    """
    known = docs.filter(F.col(policy).isNotNull()).select(F.col(policy).cast("string").alias("policy"), F.col(text).alias("text"))
    node = lambda df, parent, node_id_, label: df.select("policy", F.expr(parent).cast("string").alias("parent"), F.expr(node_id_).alias("node_id"), F.lit(label).alias("label"))
    parsed = parsers.mapped(known, ["policy"], "text", "article int, title string, paragraph int, body string, has_exception boolean", parsers.legal_structure)
    parts = stored(parsed.withColumns({"a": F.concat_ws("_article_", "policy", "article"), "p": F.concat(F.concat_ws("_article_", "policy", "article"), F.lit("_para_"), F.col("paragraph").cast("string"))}), "parts")
    numbers, letters = (F.regexp_extract_all("body", F.lit(x), F.lit(1)) for x in SUBCLAUSES)
    subs = parts.select("policy", "p", F.explode(F.when(F.size(numbers) > 0, numbers).otherwise(letters)).alias("s"))
    facts = [
        (parsers.mapped(known, ["policy"], "text", "value bigint, place int, found string", parsers.amounts), "value", "Amount"), (parsers.mapped(known, ["policy"], "text", "days int, place int, found string", parsers.periods), "days", "Period"),
        (known.select("policy", F.explode(nlq.kcd_codes(F.col("text"))).alias("code")), "code", "KCDCode"),
    ]
    found = node(known, "null", "policy", "Policy").unionByName(node(parts, "policy", "a", "Article")).unionByName(node(parts, "a", "p", "Paragraph")).unionByName(node(subs, "p", "concat(p, '_sub_', s)", "Subclause"))
    for df, value, label in facts:
        found = found.unionByName(node(df, "policy", f"concat(policy, '_{label.lower()}_', {value})", label))
    # By number, since rows are many times as large as what is shuffled of them.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // DEALT))
    return found.repartition(tasks, "policy").distinct()
