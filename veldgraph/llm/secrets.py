"""Secret scans over whole texts, with DataFrame functions only.

Three fixed patterns give the base spans. Besides, every run of key-like characters
of ``WINDOW`` and more is a candidate. What base spans leave of it is judged part by
part: a window slides over a part with letters and digits, and the counts of its
characters are kept, packed into a few integers. A step takes the leaving character out
of its count and adds the entering one to its, and changes the sum of count * log2(count)
by table. The highest entropy decides against the limit of the part's character class
(hexadecimal or other). An allow-list pattern for whole texts clears a part, one for
places only the windows that hold it.

Spans are code points, end exclusive. Nulls, empty and repeated rows: a null text
is an empty one and has no spans. Rows stand for themselves. Other columns are
ignored. Places are running sums by doubling, and texts are cut by places through
pieces of ``PIECE`` characters, so work is linear in a text's length, times the logarithm
of the number of its spans, and memory is linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: The least entropy in bits of a window: of hexadecimal candidates and of others.
HEX_BITS = 3.0
OTHER_BITS = 3.6
#: Parts that look random and are no secrets.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9+/_=-]+$",
    r"^([a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,4})([-_/=+]([a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,4}))*$",
)
#: A window that holds one of these words, in letters of either case, or a character so many times in a row is no secret; other windows of its part may be.
ALLOW_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx")
ALLOW_RUN = 8
ALLOW_WINDOW = rf"(?i:{'|'.join(ALLOW_WORDS)})|(.)\1{{{ALLOW_RUN - 1}}}"
SPANS = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,found:string>>"
PIECE = 1024
#: How many counts an integer holds in 5 bits each, and for how many characters from the space on there are counts.
PACKED = 12
COUNTED = 95
#: Scale of c * log2(c) as integers, so that sums are exact.
SCALE = 1 << 32


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], neutral: int = 0) -> Column:
    """The values combined with all before them, by doubling: as many passes as the logarithm of their number."""
    n = F.size(values)
    by = lambda acc, j: F.slice(F.concat(F.array_repeat(F.lit(neutral), F.pow(F.lit(2), j).cast("int")), acc), F.lit(1), F.size(acc))
    step = lambda acc, j: F.zip_with(acc, by(acc, j), lambda x, y: combine(x, y))
    passes = F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)
    return F.when(n > 1, F.aggregate(passes, values, step)).otherwise(values)


def located(text: Column, pattern: str) -> Column:
    """(start, match) of a pattern's leftmost non-overlapping matches, none of which is empty."""
    lengths = lambda texts: F.transform(texts, lambda x: F.length(x))

    def placed(z: Column) -> Column:
        # A match starts after the gap before it, which starts after the match before that.
        own = F.zip_with(lengths(F.slice(z["gaps"], F.lit(1), F.size(z["found"]))), F.concat(F.array(F.lit(0)), lengths(F.slice(z["found"], F.lit(1), F.size(z["found"]) - 1))), lambda x, y: x + y)
        return F.zip_with(running(own, lambda x, y: x + y), z["found"], lambda at, m: F.struct(at.alias("start"), m.alias("found")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _let(both, placed)).otherwise(F.array().cast(FOUND))


def between(spans: Column, length: Column) -> Column:
    """(start, end) of what sorted spans leave of a text, also where nothing is between two of them; spans that overlap count as one."""
    ends = running(F.transform(spans, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(F.transform(spans, lambda x: x["start"]), F.array(length)), lambda x, y: F.struct(x.alias("start"), y.alias("end")))
    return F.filter(gaps, lambda x: x["end"] >= x["start"])


def cut(text: Column, places: Column) -> Column:
    """The texts at places (start, end). A text is counted through once, not for each place."""

    def at(z: Column, x: Column) -> Column:
        first = F.floor(x["start"] / PIECE).cast("int")
        near = F.slice(z["pieces"], first + 1, F.floor(F.greatest(x["end"] - 1, x["start"]) / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(near, ""), x["start"] - first * PIECE + 1, x["end"] - x["start"])

    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), places.alias("places"))
    return _let(both, lambda z: F.transform(z["places"], lambda x: at(z, x)))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["found"])).alias("end"))).cast(SPANS)


def window_entropy(text: Column, window: int = WINDOW, allowed: bool = False) -> Column:
    """The highest Shannon entropy, in bits a character, of any ``window`` characters; null if there are none. The text is of printable ASCII, as candidates are; another character counts as the one at its distance modulo ``COUNTED``. With ``allowed``, windows that hold an allow-list word or run don't count.

    The entropy is log2(w) - S / w with S the sum of c * log2(c) over the counts c.
    """
    gain = [round((c + 1) * math.log2(c + 1) * SCALE) - (round(c * math.log2(c) * SCALE) if c else 0) for c in range(window)]
    gains, units = F.array(*[F.lit(g).cast("long") for g in gain]), F.array(*[F.lit(1 << 5 * i).cast("long") for i in range(PACKED)])
    words = -(-COUNTED // PACKED)

    def coded(c: Column) -> Column:
        code = F.pmod(F.ascii(c) - 32, F.lit(COUNTED))
        return F.struct(c.alias("char"), F.floor(code / PACKED).cast("int").alias("word"), F.get(units, F.pmod(code, F.lit(PACKED))).alias("unit"))

    count = lambda counts, x: F.pmod(F.call_function("div", F.get(counts, x["word"]), x["unit"]), F.lit(32)).cast("int")
    seen = lambda acc: F.when((acc["n"] >= window) & ((acc["latest"] < acc["n"] - window) if allowed else F.lit(True)), F.least(acc["least"], acc["s"])).otherwise(acc["least"])

    def step(acc: Column, pair: Column) -> Column:
        n, enter, leave = acc["n"] + 1, pair["enter"], pair["leave"]
        # The entering character's count is taken without the leaving one.
        own = F.get(gains, count(acc["counts"], enter) - F.when(leave["char"] == enter["char"], 1).otherwise(0))
        gone = F.when(leave.isNull(), F.lit(0)).otherwise(F.get(gains, count(acc["counts"], leave) - 1))
        counts = F.transform(acc["counts"], lambda w, k: w + F.when(k == enter["word"], enter["unit"]).otherwise(0) - F.when(k == leave["word"], leave["unit"]).otherwise(0))
        held = [acc["run"], acc["tail"], acc["latest"]]
        if allowed:
            # The last characters, how often the last one stands in a row, and where the latest listed word or run begins that has ended.
            run = F.when(F.substring(acc["tail"], -1, 1) == enter["char"], acc["run"] + 1).otherwise(1)
            tail = F.substring(F.concat(acc["tail"], enter["char"]), -max(map(len, ALLOW_WORDS)), max(map(len, ALLOW_WORDS)))
            ended = [F.when(F.lower(tail).endswith(w), n - len(w)) for w in ALLOW_WORDS] + [F.when(run >= ALLOW_RUN, n - ALLOW_RUN)]
            held = [run, tail, F.greatest(acc["latest"], *ended)]
        names = ("run", "tail", "latest")
        return F.struct(n.alias("n"), (acc["s"] - gone + own).alias("s"), counts.alias("counts"), seen(acc).alias("least"), *[h.cast(t).alias(k) for h, t, k in zip(held, ("int", "string", "int"), names, strict=True)])

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), coded)
    nothing = F.lit(None).cast("struct<char:string,word:int,unit:bigint>")
    pairs = _let(codes, lambda z: F.zip_with(z, F.slice(F.concat(F.array_repeat(nothing, window), z), F.lit(1), F.size(z)), lambda x, y: F.struct(x.alias("enter"), y.alias("leave"))))
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"), F.array(*[F.lit(0).cast("long")] * words).alias("counts"), F.lit(None).cast("long").alias("least"),
        F.lit(0).alias("run"), F.lit("").alias("tail"), F.lit(-1).alias("latest"),
    )
    return F.when(F.length(text) >= window, math.log2(window) - F.aggregate(pairs, start, step, seen) / (window * SCALE))


def _suspicious(text: Column) -> Column:
    mixed = (F.length(text) >= WINDOW) & text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    for pattern in ALLOW:
        mixed &= ~text.rlike(pattern)
    limit = F.when(text.rlike("^[0-9A-Fa-f]+$"), HEX_BITS).otherwise(OTHER_BITS)
    highest = F.when(text.rlike(ALLOW_WINDOW), window_entropy(text, allowed=True)).otherwise(window_entropy(text))
    return F.when(mixed, F.coalesce(highest >= limit, F.lit(False))).otherwise(False)


def _parts(text: Column, base: Column) -> Column:
    """(start, found) of the candidates in what base spans, which are in order, leave of a text."""
    room = F.filter(between(base, F.length(text)), lambda x: x["end"] - x["start"] >= WINDOW)
    both = _let(room, lambda z: F.zip_with(z, cut(text, z), lambda x, t: F.struct(x["start"].alias("start"), t.alias("text"))))
    within = lambda part: F.transform(located(part["text"], CANDIDATE), lambda x: F.struct((part["start"] + x["start"]).alias("start"), x["found"].alias("found")))
    return F.when(F.size(base) == 0, located(text, CANDIDATE)).when(text.rlike(CANDIDATE), F.flatten(F.transform(both, within))).otherwise(F.array().cast(FOUND))


def scanned(docs: DataFrame) -> DataFrame:
    """All columns of docs with ``base_spans`` and ``all_spans``: arrays of (start, kind, end) in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 6)
    found = docs.withColumns({"assign_": _spans(assign, 0), "access_": _spans(located(text, ACCESS), 1), "hex_": _spans(located(text, HEX), 2)})
    found = found.withColumn("base_spans", F.array_sort(F.concat("assign_", "access_", "hex_"))).drop("assign_", "access_", "hex_")
    more = _spans(F.filter(_parts(text, F.col("base_spans")), lambda x: _suspicious(x["found"])), 3)
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", more)))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every row."""
    count = lambda kind: F.size(F.filter("all_spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(_joined(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of ``text`` replaced; overlapping spans are replaced as one. n_chars, where it exists, follows."""
    walked = F.array_join(cut(F.col("text"), between(F.col("all_spans"), F.length("text"))), mark)
    found = scanned(docs.select(F.struct("*").alias("row"), "text")).withColumn("text", F.when(F.size("all_spans") > 0, walked).otherwise(F.col("text")))
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[kept[c].alias(c) for c in docs.columns])
