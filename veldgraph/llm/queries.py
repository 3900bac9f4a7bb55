"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldgraph.llm import decontaminate, fill_in_middle, language_id, line_dedup, mixing, near_dedup, periodic_runs, pseudonyms, quality, secrets, token_counts, toxicity, warc
from veldgraph.storage import load

#: Stands in for a secret that production takes from its key store.
KEY = "pseudonyms of the public test tables"
#: Target weights of the root's children; every other node's children share evenly.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
#: The mixture takes this share of all tokens, each document at most so many times.
MIXED_PERCENT = 60
EPOCHS = 3
SEED = 20240131


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_counts(load(spark, sf_dir, "documents"), KEY)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": language_id.held_out()})
    known = language_id.profiles(docs.filter("not held_out"))
    return language_id.predicted(docs, known, language_id.PROFILE_SIZE, "doc_id", "held_out")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held = language_id.held_out("doc_id", 4, 2)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    model = toxicity.fitted(docs.filter("not held_out"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")))
    return toxicity.scored(docs, model, "doc_id", "held_out")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(load(spark, sf_dir, "documents"))


def mixed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """documents with domain, lang and source as the levels of a tree and their seeded epochs."""
    domain = F.concat(F.lit("d"), (F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{0,6})$", 1).try_cast("int") % 4).cast("string"))
    tree = docs.withColumn("domain", F.coalesce(domain, F.lit("d0")))
    return mixing.mixture(tree, ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}], percent=MIXED_PERCENT, max_epochs=EPOCHS, seed=SEED, keep_text=keep_text)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return mixed(docs)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(load(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(load(spark, sf_dir, "documents"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def with_planted_run(docs: DataFrame) -> DataFrame:
    """doc_id and text. From a drawn word on, one text in ten repeats a drawn number of words; a text without words or doc_id stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(periodic_runs.WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("words"), F.call_function("div", h, F.lit(10)).alias("g"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.pmod("g", n).cast("int")))
    rows = rows.withColumn("p", (F.lit(1) + F.call_function("div", n - F.col("a"), F.lit(3) + F.pmod("g", F.lit(8)))).cast("int"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))
    return rows.select("doc_id", F.when(F.col("p").isNull(), F.col("text")).otherwise(F.array_join(F.transform("words", word), " ")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_run(load(spark, sf_dir, "documents")), "doc_id")
    found = found.withColumn("best", periodic_runs.best_run("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.described(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_pseudonyms, op3_language_id, op4_toxicity, op5_secrets, op6_mixing, op7_quality, op8_token_counts, op9_warc, op10_near_dedup, op11_fill_in_middle, op12_periodic_runs, op13_line_dedup)
}

OP9 = """
WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT page_id, url, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digests)
SELECT page_id, payload_bytes, payload_digest, url,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _level_sql(name: str, above: str, key: list[str], weights: dict[str, int]) -> str:
    """CTEs that hand the budgets of ``above`` down to the nodes ``key``."""
    parent = ", ".join(key[:-1])
    own = ", ".join(key)
    return f"""
{name}_c AS (SELECT {own}, sum(tokens)::HUGEINT * {EPOCHS} AS capacity, {_case(key[-1], weights)}::HUGEINT AS weight FROM leaves GROUP BY {own}),
{name}_p AS (SELECT c.*, a.budget AS above, row_number() OVER (PARTITION BY {parent} ORDER BY capacity * 1000 // weight, {key[-1]}) AS place
  FROM {name}_c c JOIN {above} a USING ({parent})),
{name}_s AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
  sum(weight) OVER (PARTITION BY {parent} ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM {name}_p),
{name}_f AS (SELECT *, min((capacity * weight_left <= (above - given) * weight)::INT) OVER (PARTITION BY {parent} ORDER BY place) = 1 AS full_ FROM {name}_s),
{name}_o AS (SELECT *, above - coalesce(sum(CASE WHEN full_ THEN capacity END) OVER (PARTITION BY {parent}), 0) AS rest,
  coalesce(sum(CASE WHEN NOT full_ THEN weight END) OVER (PARTITION BY {parent}), 0) AS open_,
  coalesce(sum(CASE WHEN NOT full_ THEN weight END) OVER (PARTITION BY {parent} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM {name}_f),
{name} AS (SELECT {own}, CASE WHEN full_ THEN capacity ELSE least(capacity, rest::HUGEINT * (run + weight)::HUGEINT // open_::HUGEINT - rest::HUGEINT * run::HUGEINT // open_::HUGEINT) END::HUGEINT AS budget FROM {name}_o)"""


_PLACE = f"('0x' || substr(md5('{SEED}:' || e.epochs || ':' || doc_id), 1, 10))::BIGINT"
OP6 = f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce('d' || (TRY_CAST(regexp_extract(source, '([0-9]{{0,6}})$', 1) AS INT) % 4), 'd0') AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM docs GROUP BY ALL),
root AS (SELECT root, sum(tokens)::HUGEINT * {MIXED_PERCENT} // 100 AS budget FROM leaves GROUP BY root),
{_level_sql("b1", "root", ["root", "domain"], DOMAIN_WEIGHTS)},
{_level_sql("b2", "b1", ["root", "domain", "lang"], LANGUAGE_WEIGHTS)},
{_level_sql("b3", "b2", ["root", "domain", "lang", "source"], {})},
e AS (SELECT domain, lang, source, (CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END)::INT AS epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS left_
  FROM b3 JOIN leaves USING (domain, lang, source)),
placed AS (SELECT docs.*, e.epochs, e.left_, {_PLACE} AS place FROM docs JOIN e USING (domain, lang, source)),
runs AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) AS run FROM placed),
taken AS (SELECT doc_id, lang, source, domain, n_tokens, (epochs + (left_ > 0 AND run <= left_)::INT)::INT AS n_epochs FROM runs)
SELECT * FROM taken WHERE n_epochs > 0
"""

#: The form and cuts of each document, then the three parts by code points.
OP11 = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, CASE
  WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
  WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs),
parts AS (SELECT *, substr(text, 1, least(x, y)) AS prefix, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substr(text, greatest(x, y) + 1) AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

OP13 = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
shared AS (SELECT key, max(doc_id) AS keeps FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, line, place, coalesce(doc_id <> keeps, false) AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: The other operators are no SQL: keyed permutations, learned models, tiling, sketches and tokenizers. tests/llm hold them against brute force.
ORACLES: dict[str, str] = {"op6_mixing": OP6, "op9_warc": OP9, "op11_fill_in_middle": OP11, "op13_line_dedup": OP13}
