"""Vector search, hybrid retrieval and query preparation. The list that a graph query would give is the rows with the query's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.functions import text
from veldgraph.operators import batches, joins, vector, vector_index
from veldgraph.plans import Plans, Tables
from veldgraph.storage import scratch_path

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles

Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)"
RAW = f"list_cosine_similarity(embedding::DOUBLE[], {Q})"
COS = f"round({RAW}, 6)"
LISTS = f"""
v AS (SELECT vec_id, {COS} AS score, row_number() OVER (ORDER BY {RAW} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50),
g AS (SELECT vec_id, 0.8::DOUBLE AS score, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings WHERE label = 3 QUALIFY rank <= 50)"""


def _query(t: Tables) -> list[float]:
    """One vector, by id."""
    return list(t.embeddings.filter("vec_id = 3").select("embedding").first()[0])


def _ranked(df: DataFrame, *order: F.Column) -> DataFrame:
    """Ranks of a list that a limit has made short."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = _ranked(vector.top_k(t.embeddings, _query(t), 50).select("vec_id", "score"), F.desc("score"), F.asc("vec_id"))
    g = t.embeddings.filter("label = 3").orderBy("vec_id").limit(50).select("vec_id", F.lit(0.8).alias("score"))
    return _ranked(g, F.asc("vec_id")), v


@P.add(f"SELECT vec_id, {COS} AS score FROM embeddings")
def v_cosine(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _query(t)])), 6).alias("score"))


@P.add(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {Q}), 5) AS distance FROM embeddings")
def v_euclid(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(vector.euclidean(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _query(t)])), 5).alias("distance"))


@P.add("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def v_normalize(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(F.get(vector.normalized(F.col("embedding")), F.lit(0)), 6).alias("first"))


@P.add(f"SELECT vec_id, {COS} AS score FROM embeddings ORDER BY {RAW} DESC, vec_id LIMIT 10")
def v_topk(t: Tables) -> DataFrame:
    return vector.top_k(t.embeddings, _query(t), 10).select("vec_id", "score")


@P.add(f"SELECT * FROM (SELECT vec_id, {COS} AS score FROM embeddings ORDER BY {RAW} DESC, vec_id LIMIT 10) WHERE score >= 0.3")
def flt_min_score(t: Tables) -> DataFrame:
    return vector.top_k(t.embeddings, _query(t), 10, min_score=0.3).select("vec_id", "score")


_EACH = """
SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id)::INT AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10"""


@P.add(_EACH)
def v_topk_graph(t: Tables) -> DataFrame:
    """Every fiftieth row as a query against all rows."""
    return vector.top_k_each(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), 10)


@P.add(_EACH)
def v_index_exact(t: Tables) -> DataFrame:
    """The same through an index of inverted lists, whose bounds keep closed what can't hold a better row."""
    index = vector_index.written(t.embeddings, scratch_path(t.spark, "index"))
    return vector_index.exact(index, t.embeddings.filter("vec_id % 50 = 0"), 10)


@P.add()
def v_index_probed(t: Tables) -> DataFrame:
    """The same from the nearest lists alone; tests measure the recall."""
    index = vector_index.written(t.embeddings, scratch_path(t.spark, "index"))
    return vector_index.probed(index, t.embeddings.filter("vec_id % 50 = 0"), 10)


@P.add(f"SELECT label, vec_id, {COS} AS score, row_number() OVER (PARTITION BY label ORDER BY {RAW} DESC, vec_id)::INT AS rank FROM embeddings QUALIFY rank <= 5")
def v_multi_index(t: Tables) -> DataFrame:
    return vector.top_k_per_index(t.embeddings, _query(t), 5, "label")


@P.add(f"SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {RAW} DESC, vec_id) AS rank FROM embeddings WHERE label IN (1, 2, 3)) WHERE rank <= 3")
def set_multi_index(t: Tables) -> DataFrame:
    found = vector.top_k_per_index(t.embeddings.filter("label in (1, 2, 3)"), _query(t), 3, "label")
    return found.select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@P.add("SELECT conv_id, turn, concat_ws(' ', text, role, CASE WHEN turn = 0 THEN 'coverage' END) AS expanded FROM conversations")
def v_expand(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat_ws(" ", "text", "role", F.when(F.col("turn") == 0, "coverage")).alias("expanded"))


@P.add(f"""
SELECT vec_id, round(least(e.score * CASE WHEN contains(lower(text), 'from') OR contains(lower(text), 'with') THEN 1.2 ELSE 1 END, 1), 6)::DOUBLE AS score
FROM (SELECT vec_id, {COS} AS score FROM embeddings ORDER BY {RAW} DESC, vec_id LIMIT 20) e JOIN documents ON doc_id = vec_id""")
def v_context_boost(t: Tables) -> DataFrame:
    top = vector.top_k(t.embeddings, _query(t), 20).select("vec_id", "score")
    found = t.documents.select(F.col("doc_id").alias("vec_id"), "text").join(F.broadcast(top), "vec_id")  # twenty rows
    return vector.context_boosted(found, ["From", "with"]).select("vec_id", "score")


@P.add(f"""
WITH {LISTS}, f AS (SELECT vec_id, round(coalesce(0.5 / (60 + g.rank), 0) + coalesce(0.5 / (60 + v.rank), 0), 9)::DOUBLE AS score FROM g FULL JOIN v USING (vec_id)),
h AS (SELECT * FROM f ORDER BY score DESC, vec_id LIMIT 10),
r AS (SELECT vec_id, round(least(score * CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 1.5 ELSE 1 END * CASE WHEN length(coalesce(text, '')) > 500 THEN 0.9 ELSE 1 END, 1), 6)::DOUBLE AS score FROM h LEFT JOIN documents ON doc_id = vec_id)
SELECT 'vector_only' AS strategy, vec_id, score FROM (SELECT vec_id, score FROM v ORDER BY rank LIMIT 10) UNION ALL SELECT 'graph_only', vec_id, score FROM (SELECT vec_id, score FROM g ORDER BY rank LIMIT 10) UNION ALL SELECT 'hybrid', * FROM h UNION ALL SELECT 'reranked', * FROM r""")
def h_strategy(t: Tables) -> DataFrame:
    """The best ten of each strategy: one list, the other, their fusion, and its reranking by the texts."""
    g, v = _lists(t)
    hybrid = vector.reciprocal_rank_fusion(g, v, "vec_id").orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")
    texts = t.documents.select(F.col("doc_id").alias("vec_id"), "text").join(F.broadcast(hybrid.select("vec_id")), "vec_id")  # ten rows
    reranked = vector.reranked(hybrid.join(texts, "vec_id", "left").fillna("", "text"), "The")
    plans = {"vector_only": v.orderBy("rank").limit(10), "graph_only": g.orderBy("rank").limit(10), "hybrid": hybrid, "reranked": reranked}
    return joins.union_all([df.select(F.lit(name).alias("strategy"), "vec_id", "score") for name, df in plans.items()])


@P.add(f"""
WITH {LISTS} SELECT vec_id, round(coalesce(0.7 / (60 + g.rank), 0) + coalesce(0.3 / (60 + v.rank), 0), 9)::DOUBLE AS score, g.rank IS NULL AS late, coalesce(g.rank, v.rank) AS first_seen FROM g FULL JOIN v USING (vec_id)""")
def h_rrf(t: Tables) -> DataFrame:
    g, v = _lists(t)
    return vector.reciprocal_rank_fusion(g, v, "vec_id", 0.7, 0.3).select("vec_id", "score", "first_seen.late", F.col("first_seen.rank").cast("long").alias("first_seen"))


@P.add("SELECT event_id, rank0, round(1.0::DOUBLE / (60 + rank0 + 1), 9)::DOUBLE AS score FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank0 FROM events)")
def h_rrf_const(t: Tables) -> DataFrame:
    """The share of one list alone: each user's events as a ranked list."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return t.events.select("event_id", (rank - 1).cast("long").alias("rank0"), F.round(F.lit(1.0) / (vector.RRF_K + rank), 9).alias("score"))


@P.add(f"WITH {LISTS} SELECT vec_id, round(coalesce(g.score, 0) * 0.6 + coalesce(v.score, 0) * 0.4, 6) AS score FROM g FULL JOIN v USING (vec_id)")
def h_weighted(t: Tables) -> DataFrame:
    return vector.weighted_sum(*_lists(t), "vec_id", 0.6, 0.4)


@P.add(f"WITH {LISTS} SELECT vec_id, greatest(g.score, v.score) AS best, least(g.score, v.score) AS least, round((coalesce(g.score, v.score) + coalesce(v.score, g.score)) / 2, 6) AS mean FROM g FULL JOIN v USING (vec_id)")
def h_other_fusion(t: Tables) -> DataFrame:
    g, v = _lists(t)
    named = [vector.other_fusion(g, v, "vec_id", how).withColumnRenamed("score", name) for how, name in (("max", "best"), ("min", "least"), ("average", "mean"))]
    return named[0].join(named[1], "vec_id").join(named[2], "vec_id")


@P.add(f"""
SELECT vec_id, round(least(e.score * CASE WHEN contains(lower(text), 'the') THEN 1.5 ELSE 1 END * CASE WHEN length(text) > 500 THEN 0.9 ELSE 1 END, 1), 6)::DOUBLE AS score
FROM (SELECT vec_id, {COS} AS score FROM embeddings ORDER BY {RAW} DESC, vec_id LIMIT 20) e JOIN documents ON doc_id = vec_id""")
def h_rerank(t: Tables) -> DataFrame:
    top = vector.top_k(t.embeddings, _query(t), 20).select("vec_id", "score")
    return vector.reranked(t.documents.select(F.col("doc_id").alias("vec_id"), "text").join(F.broadcast(top), "vec_id"), "The").select("vec_id", "score")  # twenty rows


@P.add(f"WITH x AS (SELECT {COS} AS score FROM embeddings) SELECT round(avg(score), 5) AS avg_score, max(score) AS max_score, min(score) AS min_score FROM x")
def h_score_stats(t: Tables) -> DataFrame:
    return v_cosine(t).agg(F.round(F.avg("score"), 5).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


@P.add("""
WITH f AS (SELECT conv_id, turn, 'Article ' || turn || ': ' || left(text, 100) AS formatted, (length(text) // 4)::INT AS tokens, (row_number() OVER (ORDER BY conv_id, turn, text) - 1) // 100 AS batch FROM conversations)
SELECT *, (('0x' || substr(md5(formatted || ':0'), 1, 8))::BIGINT - 2147483648) / 2147483648.0::DOUBLE AS first, (('0x' || substr(md5(formatted || ':63'), 1, 8))::BIGINT - 2147483648) / 2147483648.0::DOUBLE AS last FROM f""")
def e_batch(t: Tables) -> DataFrame:
    """Turns in batches of a hundred with the ends of their stand-in vectors."""
    formatted = F.concat(F.lit("Article "), F.col("turn").cast("string"), F.lit(": "), F.left("text", F.lit(100)))
    numbered = batches.numbered(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn", "text"])
    made = numbered.select("conv_id", "turn", formatted.alias("formatted"), F.floor(F.length("text") / 4).cast("int").alias("tokens"), F.floor(F.col("number") / 100).cast("long").alias("batch"))
    return made.withColumn("v", vector.stand_in(F.col("formatted"), 64)).withColumns({"first": F.get("v", F.lit(0)), "last": F.element_at("v", -1)}).drop("v")


@P.add("SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS clean FROM conversations")
def q_normalize_ws(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.collapsed(F.col("text")).alias("clean"))


_QUESTION = "CASE o_orderkey % 4 WHEN 0 THEN '갑상선암 ' || o_custkey || ' 보장 금액은?' WHEN 1 THEN '암진단비를 알려주세요 ' || o_orderpriority WHEN 2 THEN '보장되나요' ELSE 'is it covered? 제한이 있습니까?' END"
_ASKED = f"(SELECT o_orderkey AS id, {_QUESTION} AS q FROM orders) q"


def _asked(t: Tables) -> DataFrame:
    """A question for each order, with what the order holds in it."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_QUESTION).alias("q"))


@P.add(f"SELECT id, array_to_string(list_distinct_keep, '|') AS variations FROM (SELECT id, CASE WHEN contains(q, '?') THEN [q, replace(q, '?', '')] WHEN contains(q, '알려주세요') THEN [q, replace(q, '알려주세요', '')] ELSE [q] END AS list_distinct_keep FROM {_ASKED})")
def q_variations(t: Tables) -> DataFrame:
    return _asked(t).select("id", F.array_join(text.variations(F.col("q")), "|").alias("variations"))


@P.add(f"SELECT id, CASE WHEN length(regexp_replace(q, '[^가-힣]', '', 'g')) * 1.0 / greatest(length(regexp_replace(q, '[^가-힣A-Za-z]', '', 'g')), 1) > 0.3 THEN 'ko' ELSE 'en' END AS lang FROM {_ASKED}")
def q_lang_ratio(t: Tables) -> DataFrame:
    return _asked(t).select("id", text.language_by_ratio(F.col("q")).alias("lang"))
