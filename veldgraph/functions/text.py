"""Text expressions: cleaning, language, quality, chunks, hashes and templates. All are columns of built-in functions; ``(?U)`` keeps word classes Unicode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[ \t\n\x0B\f\r]+"


def let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def variations(question: Column) -> Column:
    """The question, without its question mark, and without a polite request; distinct, in this order."""
    asked = F.when(F.contains(question, F.lit("?")), F.replace(question, F.lit("?"), F.lit("")))
    polite = F.when(F.contains(question, F.lit("알려주세요")), F.replace(question, F.lit("알려주세요"), F.lit("")))
    return F.array_distinct(F.array_compact(F.array(question, asked, polite)))


def n_hangul(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[가-힣]"))


def n_latin(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def language_by_ratio(text: Column, share: float = 0.3) -> Column:
    """ko if Hangul is more than that share of the letters, or if there is no letter."""
    letters = n_hangul(text) + n_latin(text)
    return F.when(letters == 0, "ko").when(n_hangul(text) / F.greatest(letters, F.lit(1)) > share, "ko").otherwise("en")


def language_by_count(text: Column) -> Column:
    return F.when(n_hangul(text) > n_latin(text), "ko").when(n_latin(text) > 0, "en").otherwise("ko")


def keywords(text: Column, stopwords: list[str], least: int = 2) -> Column:
    """Words of letters and digits of some length that are no stopwords, repeated ones included."""
    words = F.split(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stopwords))


# Chunks


def sentences(text: Column) -> Column:
    """Runs up to and with their closing marks; a tail without one is dropped. Cutting behind the marks takes linear time where matching runs would not."""
    parts = F.split(F.regexp_replace(text, r"\A[.!?]+", ""), r"(?<=[.!?])(?![.!?])")
    return F.filter(parts, lambda p: p.rlike(r"[.!?]\z"))


def packed(parts: Column, most: int, joint: str = "") -> Column:
    """Neighbouring parts put together up to a length; a longer part stays alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = (F.length(acc["now"]) + len(joint) + F.length(part) <= most) | (acc["now"] == "")
        joined = F.when(acc["now"] == "", part).otherwise(F.concat(acc["now"], F.lit(joint), part))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"),
            F.when(fits, joined).otherwise(part).alias("now"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def windows(text: Column, size: int, step: int) -> Column:
    """Windows of ``size`` characters, stripped, blank ones dropped."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i, F.lit(size)))), lambda c: c != "")


def overlapped(chunks: Column, overlap: int) -> Column:
    """Each chunk but the first behind the end of the one before."""
    return F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.right(F.get(chunks, i - 1), F.lit(overlap)), F.lit("\n...\n"), c)))


def articles(text: Column) -> Column:
    """Segments that begin with an article, chapter or section mark, if there are two and more; what stands before the first is dropped."""
    mark = r"제\s*\d+\s*[조장절]"
    parts = F.filter(F.split(text, f"(?={mark})"), lambda p: p.rlike(f"^{mark}"))
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))


def chunk_type(chunk: Column) -> Column:
    return F.when(chunk.rlike(r"제\s*\d+\s*조"), "article").when(chunk.rlike(r"제\s*\d+\s*장"), "chapter").when(chunk.rlike(r"제\s*\d+\s*절"), "section").otherwise("paragraph")


def chunked(text: Column, small: int = 200, most: int = 1000, overlap: int = 100) -> Column:
    """A short text whole; else its articles or, without those, its packed sentences, with overlap."""
    return let(articles(text), lambda a: F.when(F.length(text) < small, F.array(text)).when(F.size(a) > 0, overlapped(a, overlap)).otherwise(let(packed(sentences(text), most), lambda s: overlapped(s, overlap))))


# Quality


def _banded(value: Column, bands: list[tuple[float, int]]) -> Column:
    """The points of the first band whose least value is reached, else 0."""
    out = F.lit(0)
    for least, points in reversed(bands):
        out = F.when(value >= least, points).otherwise(out)
    return out


def text_quality(text: Column, pages: Column) -> Column:
    """0 to 100: characters a page, share of letters, few special characters, no broken ones. An empty text has 0."""
    n = F.length(text)
    meant = (n_hangul(text) + n_latin(text)) / n * 100
    special = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\s\p{Z}]")) / n * 100
    broken = text.rlike(r"[■□○●◎◇◆△▲▽▼]{3,}|[\x00-\x1F]{2,}|�")
    score = _banded(n / F.greatest(pages, F.lit(1)), [(500, 40), (200, 30), (100, 20), (50, 10)]) + _banded(meant, [(70, 30), (50, 20), (30, 10)])
    score = score + F.when(special < 10, 20).when(special < 20, 15).when(special < 30, 10).when(special < 50, 5).otherwise(0) + F.when(broken, 0).otherwise(10)
    return F.when(n > 0, score).otherwise(0)


def quality_level(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").when(score >= 20, "poor").otherwise("very_poor")


def complexity(text: Column) -> Column:
    """0 to 100: little Hangul, many table glyphs, no articles or chapters, special characters and short lines make a text hard to take in. An empty text has 100."""
    n = F.length(text)
    hangul, tables = n_hangul(text) / n, F.regexp_count(text, F.lit("[┌┐└┘│─┼┬┴├┤]"))
    plain = (F.regexp_count(text, F.lit(r"제\d+조")) < 2) & (F.regexp_count(text, F.lit(r"제\d+장")) < 1)
    special = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s\p{Z}]")) / n
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\s\p{Z}]"))
    length = let(lines, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0), lambda s, y: s + F.length(y)) / F.size(x)).otherwise(0.0))
    score = F.when(hangul < 0.2, 35).when(hangul < 0.4, 20).otherwise(0) + F.when(tables > 50, 25).when(tables > 20, 15).otherwise(0) + F.when(plain, 20).otherwise(0)
    score = score + F.when(special > 0.4, 15).when(special > 0.3, 10).otherwise(0) + F.when(length < 10, 10).otherwise(0)
    return F.when(n > 0, F.least(score, F.lit(100))).otherwise(100)


def structure_quality(text: Column) -> Column:
    chapters, found = F.regexp_count(text, F.lit(r"제\d+장")), F.regexp_count(text, F.lit(r"제\d+조"))
    return F.round(0.6 * n_hangul(text) / F.greatest(F.length(text), F.lit(1)) + 0.4 * F.least((2 * chapters + found) / 50, F.lit(1.0)), 3)


# Templates


# Variable parts of a text, and what their values are by their beginning.
VARIABLES = {
    "article": r"제\s*\d+\s*조\s*\(.*?\)",
    "chapter": r"제\s*\d+\s*장\s*.*?\n",
    "number": r"\d+\.\s+",
    "amount": r"[\d,]+원",
    "percentage": r"\d+%",
    "days": r"\d+일",
    "months": r"\d+개월",
    "years": r"\d+년",
}
VARIABLE_TYPES = ("amount", "percentage", "days", "months", "years", "article")


def template_variables(text: Column) -> Column:
    """type:value of every variable part, pattern by pattern; a value that begins as no type is an other one."""
    return F.concat(*[_tagged(name if name in VARIABLE_TYPES else "other", p, text) for name, p in VARIABLES.items()])


def _tagged(name: str, pattern: str, text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.concat(F.lit(f"{name}:"), v))


def structural(line: Column) -> Column:
    """Whether a line is a heading or a numbered one."""
    return F.trim(line).rlike(r"^(제\s*\d+\s*[조장]|\d+\.|[①②③④⑤⑥⑦⑧⑨⑩])")


def common_lines(docs: DataFrame, group: str) -> DataFrame:
    """(group, place, line): structural lines of the group's first document, by doc_id, that are in all others of the group, white space aside.

    The lines of one document meet each text of its group; texts are stripped of white
    space once, and lines of a group are counted, not gathered.
    """
    first = docs.groupBy(group).agg(F.min_by("text", "doc_id").alias("first"), F.min("doc_id").alias("first_id"), F.countDistinct("doc_id").alias("docs"))
    lines = first.select(group, "first_id", "docs", F.posexplode(F.split("first", "\n")).alias("place", "line")).filter(structural(F.col("line")))
    lines = lines.withColumn("bare", F.regexp_replace("line", r"\s+", ""))
    others = docs.select(group, "doc_id", F.regexp_replace("text", r"\s+", "").alias("plain"))
    held = lines.join(others, group).filter((F.col("doc_id") != F.col("first_id")) & F.contains("plain", F.col("bare")))
    counts = held.groupBy(group, "place").agg(F.countDistinct("doc_id").alias("n"), F.first("line").alias("line"), F.first("docs").alias("docs"))
    return counts.filter("n = docs - 1").select(group, "place", "line")


def sketch_candidates(docs: DataFrame, key: str, group: str, asked: Column, least: float = 0.0) -> DataFrame:
    """(key, other_id, text, other): documents that are asked about, each with every other one of its group whose lengths allow a ratio of ``least``. No sketch leaves a pair out.

    This is the plain way, which writes both texts of each pair; ``operators.ratios`` finds the most alike without.
    """
    own = docs.filter(asked).select(F.col(key), F.col(group).alias("g"), "text")
    other = docs.select(F.col(key).alias("other_id"), F.col(group).alias("other_g"), F.col("text").alias("other"))
    n, other_n = F.length("text"), F.length("other")
    fits = 2 * F.least(n, other_n) >= (least - 1e-6) * (n + other_n)
    return own.join(other, F.col("g").eqNullSafe(F.col("other_g"))).filter((F.col(key) != F.col("other_id")) & fits).select(key, "other_id", "text", "other")


def template_of(text: Column) -> Column:
    """The text with its variable parts as placeholders."""
    for name, p in VARIABLES.items():
        text = F.regexp_replace(text, p, f"{{{name}}}")
    return text


def template_score(template: Column, text: Column, block: int = 100) -> Column:
    """The share of the template's characters in blocks that the text holds, the last block too; placeholders and white space don't count."""
    kept = F.regexp_replace(template, r"\{[^}]+\}|\s+", "")
    both = F.struct(F.regexp_extract_all(kept, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("blocks"), F.regexp_replace(text, r"\s+", "").alias("text"))
    held = lambda x: F.aggregate(F.filter(x["blocks"], lambda b: F.contains(x["text"], b)), F.lit(0), lambda s, b: s + F.length(b))
    return F.coalesce(F.when(F.length(kept) > 0, F.get(F.transform(F.array(both), held), F.lit(0)) / F.length(kept)), F.lit(0.0))


def table_markdown(rows: Column) -> Column:
    """An array of arrays of cells as a Markdown table with its first row as the head."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def krw(amount: Column) -> Column:
    """An amount in 억 and 만원; below 만 with thousands separators."""
    eok, rest = F.floor(amount / 100_000_000), amount % 100_000_000
    man = lambda x: F.concat(F.floor(x / 10_000).cast("string"), F.lit("만원"))
    return F.when((eok > 0) & (rest == 0), F.concat(eok.cast("string"), F.lit("억원"))).when(eok > 0, F.concat(eok.cast("string"), F.lit("억 "), man(rest))).when(amount >= 10_000, man(amount)).otherwise(F.concat(F.format_number(amount, 0), F.lit("원")))


def period(days: Column) -> Column:
    """Days as whole years, else as whole months, else as days; what is left over is dropped."""
    shown = lambda by, unit: F.concat(F.floor(days / by).cast("string"), F.lit(unit))
    return F.when(days >= 365, shown(365, "년")).when(days >= 30, shown(30, "개월")).otherwise(shown(1, "일"))


# Ways to read and to learn a document

# Bytes up to which a file is read at once, and of a piece beyond; bytes, complexity and quality beyond which a text goes to OCR; scores that allow a cheaper way of learning.
AT_ONCE, PIECE = 10 * 1024 * 1024, 1024 * 1024
OCR_BYTES, OCR_COMPLEXITY, OCR_QUALITY = 5 * 1024 * 1024, 70, 0.7
TEMPLATE_SCORE, VERSION_RATIO, MOST_CHANGED = 0.8, 0.85, 0.3


def best_extraction(attempts: Column) -> Column:
    """The text kept of several attempts (algorithm, text, pages), as (algorithm, score, level): the first excellent one, else the best, of equal ones the first. One without pages failed."""
    scored = F.transform(F.filter(attempts, lambda a: a["pages"] > 0), lambda a, i: F.struct(text_quality(a["text"], a["pages"]).alias("score"), (-i).alias("place"), a["algorithm"].alias("algorithm")))
    best = let(scored, lambda s: F.coalesce(F.get(F.filter(s, lambda x: x["score"] >= 80), F.lit(0)), F.array_max(s)))
    return let(best, lambda b: F.when(b.isNull(), F.struct(F.lit("none").alias("algorithm"), F.lit(0).alias("score"), F.lit("very_poor").alias("level"))).otherwise(F.struct(b["algorithm"].alias("algorithm"), b["score"].alias("score"), quality_level(b["score"]).alias("level"))))


def read_route(n_bytes: Column) -> Column:
    """Struct (route, pieces): files of some size are read in pieces."""
    return F.when(n_bytes < AT_ONCE, F.struct(F.lit("memory").alias("route"), F.lit(1).cast("long").alias("pieces"))).otherwise(F.struct(F.lit("stream").alias("route"), F.ceil(n_bytes / PIECE).alias("pieces")))


def extraction_route(strategy: Column, n_bytes: Column, text: Column) -> Column:
    """``ocr`` or ``simple`` by size, by complexity (``smart``, and others) or by the quality of what the simple way gives (``progressive``)."""
    to_ocr = F.when(strategy == "simple", n_bytes > OCR_BYTES).when(strategy == "progressive", structure_quality(text) < OCR_QUALITY).otherwise(complexity(text) >= OCR_COMPLEXITY)
    return F.when(to_ocr, "ocr").otherwise("simple")


def learning_strategy(template: Column, ratio: Column, changed: Column) -> Column:
    """Struct (strategy, saving): by a template that matches, else by the changed lines of a similar version, else by chunks. Nulls: there is no template or version."""
    by = lambda name, saving: F.struct(F.lit(name).alias("strategy"), saving.alias("saving"))
    return F.when(template >= TEMPLATE_SCORE, by("template", F.lit(0.95))).when((ratio >= VERSION_RATIO) & (changed <= MOST_CHANGED), by("incremental", F.round(1 - changed, 6))).otherwise(by("chunking", F.lit(0.0)))
