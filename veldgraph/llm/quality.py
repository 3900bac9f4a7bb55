"""Quality rules as weak supervision, with DataFrame functions only.

Eight rules each vote good or bad or abstain. Expectation-maximisation over the vote
patterns of the whole corpus estimates how often each rule votes which way on good
and on bad documents, and the share of good ones; a document's posterior probability
of being good then decides, not the worst of its rules.

Rules have three outcomes, so there are at most 3**8 = 6,561 patterns: the corpus is
grouped to that many counts at most, and only those come to the driver. EM runs to
convergence on exact counts of all documents, in a fixed order. Good is the component
that the rules' own votes call good: it starts at the majority of votes, and a rule's
vote never counts for the other side.

Nulls, empty and repeated rows: a null or wordless text has no words, fails the base
rules and is not kept. Rows stand for themselves. Other columns are ignored. Texts
are read whole; a text with n words takes n log n steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "letters", "line_ends", "few_words")
LEAST_POSTERIOR = 0.5
STEPS = 200


def _repeated_words(words: Column) -> Column:
    """How many words lie in a run of three words that occurs twice or more.

    Runs are compared by 64-bit hash. Sorting (hash, place) puts equal runs side by
    side; the places of repeated runs, sorted, then cover three words each but for
    what the next one covers.
    """
    runs = F.when(
        F.size(words) > 2, F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        def places(by_run: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(by_run, i)["h"] == F.get(by_run, j)["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(by_run, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)

        by_run = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.transform(F.array(by_run), places)
        return F.get(F.transform(found, total), F.lit(0))

    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.get(F.transform(F.array(runs), count), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the counts that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t_")).withColumn("w_", F.filter(F.split("t_", WHITE), lambda w: w != ""))
    lines = F.filter(F.split("t_", "\n"), lambda x: x.rlike(WORD))
    counted = words.select(
        "doc_id",
        F.size("w_").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t_", WHITE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t_", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"), F.size(F.filter(x, lambda y: y.rlike(r"[.!?:;\"')\]\x{2026}\x{201d}][\x20\x09-\x0D]*$"))).alias("ended"))), F.lit(0)).alias("l_"),
        _repeated_words(F.col("w_")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w_")).cast("long").alias("n_distinct_words"),
        F.regexp_count("t_", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("l_.again").cast("long").alias("n_dup_lines"), "n_repeat_words", "n_distinct_words", "n_letters",
        F.col("l_.n").cast("long").alias("n_lines"), F.col("l_.ended").cast("long").alias("n_ended_lines"),
    )


def _vote(bad: Column, good: Column) -> Column:
    """2 for good, 1 for bad, 0 for an abstention."""
    return F.when(bad, 1).when(good, 2).otherwise(0)


def votes() -> dict[str, Column]:
    """What each rule says of the columns of ``measured``; none says anything of a text without words but the first."""
    n, lines = F.col("n_words"), F.col("n_lines")
    part = lambda x, whole: F.col(x) / F.when(F.col(whole) > 0, F.col(whole))
    return {
        "length": _vote((n < 50) | (n > 100_000), n >= 100),
        "word_length": _vote((part("word_chars", "n_words") < 3) | (part("word_chars", "n_words") > 12), part("word_chars", "n_words").between(3.5, 9)),
        "symbols": _vote(part("n_symbols", "n_words") > 0.1, (part("n_symbols", "n_words") < 0.02) & (n >= 20)),
        "repeated_lines": _vote((part("n_dup_lines", "n_lines") > 0.3) & (lines >= 3), (F.col("n_dup_lines") == 0) & (lines >= 3)),
        "repeated_words": _vote(part("n_repeat_words", "n_words") > 0.2, (part("n_repeat_words", "n_words") < 0.05) & (n >= 50)),
        "letters": _vote(part("n_letters", "word_chars") < 0.8, (part("n_letters", "word_chars") > 0.9) & (n >= 20)),
        "line_ends": _vote((part("n_ended_lines", "n_lines") < 0.2) & (lines >= 3), (part("n_ended_lines", "n_lines") > 0.7) & (n >= 20)),
        "few_words": _vote((part("n_distinct_words", "n_words") < 0.15) & (n >= 50) & (n < 2000), (part("n_distinct_words", "n_words") > 0.3) & (n >= 50)),
    }


def estimated(patterns: list[tuple[int, int]], rules: int = len(RULES), steps: int = STEPS) -> tuple[float, list[list[float]]]:
    """(log odds of good, for each rule the log odds that each of its three outcomes adds) by EM.

    ``patterns``: (code, documents), the code with a rule's outcome in each digit to
    base 3. An abstention adds nothing: only votes are evidence. A vote for bad adds
    at most 0 and one for good at least 0.
    """
    rows = sorted((c, n) for c, n in patterns if n > 0)
    if not rows:
        return 0.0, [[0.0] * 3 for _ in range(rules)]
    digits = [[c // 3**r % 3 for r in range(rules)] for c, _ in rows]
    weights = [float(n) for _, n in rows]
    total = sum(weights)
    balance = [sum((d == 2) - (d == 1) for d in row) for row in digits]
    good = [1 / (1 + math.exp(-max(-30, min(30, b)))) for b in balance]
    prior, table, before = 0.0, [[0.0] * 3 for _ in range(rules)], -1.0
    for _ in range(steps):
        share = sum(w * g for w, g in zip(weights, good, strict=True))
        prior = math.log((share + 1) / (total - share + 1))
        for r in range(rules):
            seen = [[1.0, 1.0], [1.0, 1.0]]  # of bad and good documents: votes for bad and good, one of each beforehand
            for row, w, g in zip(digits, weights, good, strict=True):
                if row[r]:
                    seen[0][row[r] - 1] += w * (1 - g)
                    seen[1][row[r] - 1] += w * g
            rate = [[x / sum(side) for x in side] for side in seen]
            table[r] = [0.0, min(0.0, math.log(rate[1][0] / rate[0][0])), max(0.0, math.log(rate[1][1] / rate[0][1]))]
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(table[r][d] for r, d in enumerate(row)))))) for row in digits]
        if abs(share - before) < 1e-9 * total:
            break
        before = share
    return prior, table


def fitted(counted: DataFrame) -> tuple[float, list[list[float]]]:
    """EM over the vote patterns of all rows of ``measured``."""
    code = sum((v * 3**r for r, v in enumerate(votes().values())), F.lit(0))
    found = counted.select(code.alias("code")).groupBy("code").count().limit(3 ** len(RULES)).collect()
    return estimated([(r["code"], r["count"]) for r in found])


def judged(counted: DataFrame, model: tuple[float, list[list[float]]]) -> DataFrame:
    """The columns of ``measured`` with base_failed, posterior and the three-valued votes in one string (0 abstains, 1 bad, 2 good)."""
    prior, table = model
    cast = counted.withColumns({f"v_{k}": v for k, v in votes().items()})
    odds = F.lit(prior)
    for k, own in zip(RULES, table, strict=True):
        odds = odds + F.when(F.col(f"v_{k}") == 1, own[1]).when(F.col(f"v_{k}") == 2, own[2]).otherwise(0.0)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cast.select(*counted.columns, base.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior"), F.concat(*[F.col(f"v_{k}").cast("string") for k in RULES]).alias("votes"))


def quality(docs: DataFrame, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """doc_id, the counts, base_failed, kept, posterior and votes of every row."""
    from veldgraph.storage import stored

    counted = stored(measured(docs), "measures")
    out = judged(counted, fitted(counted))
    kept = ~F.col("base_failed") & (F.col("posterior") >= least_posterior)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior", "votes")
