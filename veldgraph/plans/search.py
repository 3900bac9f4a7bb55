"""Full-text search through an inverted index, and links of names that are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.operators import fuzzy, text_index
from veldgraph.plans import Plans, Tables
from veldgraph.storage import scratch_path, stored

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

#: Weights A, B and C of the fields.
WEIGHTS = {"text": 1.0, "source": 0.4, "lang": 0.2}


def _index(t: Tables) -> text_index.Index:
    return text_index.written(t.documents, scratch_path(t.spark, "words"), "doc_id", WEIGHTS)


def _found_sql(words: list[str]) -> str:
    """CTEs of the documents that hold all words, by a scan of all texts."""
    split = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rank = " + ".join(f"{w} * len(list_filter({c}, lambda x: list_contains({listed}, x)))" for c, w in zip(("a", "b", "c"), WEIGHTS.values(), strict=True))
    return f"""t AS (SELECT doc_id AS id, {split("text")} AS a, {split("source")} AS b, {split("lang")} AS c FROM documents),
found AS (SELECT id, round({rank}, 6)::DOUBLE AS rank, a, b, c FROM t WHERE list_has_all(list_concat(a, b, c), {listed}))"""


@P.add(f"WITH {_found_sql(['en', 'the', 'onen'])} SELECT id, rank FROM found")
def flt_fulltext_index(t: Tables) -> DataFrame:
    """All words of the query, in any field."""
    return text_index.search(_index(t), "The onen, EN")


@P.add(f"WITH {_found_sql(['of', 'the'])} SELECT id, rank FROM found WHERE contains(' ' || array_to_string(a, ' ') || ' ', ' of the ')")
def flt_phrase_index(t: Tables) -> DataFrame:
    """The words one after the other in one field."""
    return text_index.search(_index(t), "of the", phrase=True)


@P.add(f"""
WITH {_found_sql(['the', 'of'])} SELECT id, rank, lang, n_chars, (SELECT count(*) FROM found) AS total FROM found JOIN documents ON doc_id = id ORDER BY rank DESC, id LIMIT 20 OFFSET 20""")
def an_search_index(t: Tables) -> DataFrame:
    """A page of the hits with their number; only the page's documents are read for the other columns."""
    hits = stored(text_index.search(_index(t), "of the"), "hits")
    page = hits.orderBy(F.desc("rank"), "id").offset(20).limit(20).withColumn("one", F.lit(1))
    total = hits.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return docs.join(F.broadcast(page.join(total, "one").drop("one")), "id")  # twenty rows


def _words(df: DataFrame) -> DataFrame:
    """The distinct words of some texts, letters only."""
    return df.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()


@P.add()
def jn_dim_fuzzy(t: Tables) -> DataFrame:
    """Each word of the conversations with the benchmark word that it is, or else the most similar one; tests compare with all pairs."""
    return fuzzy.linked(_words(t.conversations), _known(t), "word", "name", "value")


def _known(t: Tables) -> DataFrame:
    return _words(t.benchmark).withColumnRenamed("word", "name").withColumn("value", F.col("name"))


@P.add("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM conversations), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM benchmark), n AS (SELECT lower(word) AS k, min(word) AS value FROM b GROUP BY 1)
SELECT word, value, CASE WHEN value IS NULL THEN 'other' ELSE 'exact' END AS stage FROM w LEFT JOIN n ON k = lower(word)""")
def jn_dim_exact(t: Tables) -> DataFrame:
    """The first stage of the same, without the comparisons of the others."""
    found = fuzzy.exact_link(_words(t.conversations), _known(t), "word", "name", "value")
    return found.select("word", F.col("exact_").alias("value"), F.when(F.col("exact_").isNotNull(), "exact").otherwise("other").alias("stage"))
