"""Fill-in-the-middle texts by relational units.

A text is a sequence of units, leftmost matches of a pattern of which every text is the
concatenation: code points, words with the white space after them, lines. A cut
request is a number of units of one document. The texts are shuffled once by their row's
key; everything after that stays in the same partitions. ``posexplode`` gives the
matches, ``RUN`` units to a row, so that a long text is a few thousand short rows and not
a row for each letter. A window sums the units and lengths of the runs before. Requests
meet the run that holds their last unit, by the unit's ordinal; units of one code point
are counted from the run's start, others are exploded again, two runs a document, with
a second running sum. Offsets are aggregated for each document, joined with its text and
used by ``substring``.

Form and cuts come from the first four 8-digit groups, read as unsigned integers, of the
hexadecimal SHA-256 of ``seed:doc_id``. Texts that are empty or hold a tag stay plain.

Nulls, empty and repeated rows: a null text is an empty one. A null doc_id is hashed as
an empty string and comes back null. Rows are told apart by doc_id, length and
hash of the text, so rows that repeat a doc_id are cut each by its own text, and equal
rows give equal results. Equal cuts give an empty middle. Other columns are ignored. An
empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Units: patterns of which every text is the concatenation of matches.
CHARACTER = r"(?s)."
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
LINE = r"[^\n]*\n|[^\n]+"
#: Units in a row of the first explode.
RUN = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TAG = "<[PSM]>"
PLAIN_FROM = 90
SPM_BELOW = 20
KEY = ["id", "n", "text_hash"]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return docs.select(ident.alias("id"), F.length(text).cast("long").alias("n"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _draw(seed: int | str, group: int) -> Column:
    """The group-th integer of a document's digest."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256), 8 * group + 1, 8), 16, 10).cast("long")


def _requests(rows: DataFrame, unit: str, seed: int | str) -> DataFrame:
    """(key, cut, last): for the lesser and the greater cut the ordinal of its last unit; none before the first unit."""
    units = F.col("n") if unit == CHARACTER else F.regexp_count("text", F.lit(unit)).cast("long")
    drawn = rows.withColumn("units", units).select(*KEY, *[F.pmod(_draw(seed, k), F.col("units") + 1).alias(f"h{k}") for k in (0, 1)])
    cuts = F.array(F.struct(F.lit(0).alias("cut"), (F.least("h0", "h1") - 1).alias("last")), F.struct(F.lit(1).alias("cut"), (F.greatest("h0", "h1") - 1).alias("last")))
    return drawn.select(*KEY, F.inline(cuts)).filter("last >= 0")


def _runs(rows: DataFrame, unit: str) -> DataFrame:
    """(key, place, first, units, start, length): runs of matches with the units and lengths of all before them; for units of several code points also the run's text."""
    whole = unit if unit == CHARACTER else f"(?:{unit})"
    # The outer form keeps a filter on the matches from being pushed, and computed, before the shuffle.
    runs = rows.select(*KEY, F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"{whole}{{1,{RUN}}}"), F.lit(0))).alias("place", "run"))
    runs = runs.filter("place is not null").withColumn("length", F.length("run").cast("long"))
    runs = runs.withColumn("units", F.col("length") if unit == CHARACTER else F.regexp_count("run", F.lit(unit)).cast("long"))
    # Rows that are equal have one key: their runs are the same.
    kept = [F.first(c).alias(c) for c in ("units", "length", *(() if unit == CHARACTER else ("run",)))]
    runs = runs.groupBy(*KEY, "place").agg(*kept)
    before = Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns({"first": F.coalesce(F.sum("units").over(before), F.lit(0)), "start": F.coalesce(F.sum("length").over(before), F.lit(0))})


def offsets(rows: DataFrame, requests: DataFrame, unit: str = CHARACTER) -> DataFrame:
    """(key, cut_0, cut_1): where the requested cuts are, in code points; null for a cut before the first unit. ``rows`` are partitioned by their key."""
    hit = (F.col("last") >= F.col("first")) & (F.col("last") < F.col("first") + F.col("units"))
    met = _runs(rows, unit).join(requests.hint("merge"), KEY).filter(hit)
    if unit == CHARACTER:
        found = met.withColumn("offset", F.col("start") + F.col("last") - F.col("first") + 1)
    else:
        exploded = met.select(*KEY, "cut", (F.col("last") - F.col("first")).alias("ordinal"), "start", F.posexplode_outer(F.regexp_extract_all("run", F.lit(unit), F.lit(0))).alias("at", "piece"))
        upto = Window.partitionBy(*KEY, "cut").orderBy("at")
        found = exploded.withColumn("offset", F.col("start") + F.sum(F.length("piece")).over(upto)).filter("at = ordinal")
    return found.groupBy(*KEY).agg(*[F.max(F.when(F.col("cut") == k, F.col("offset"))).alias(f"cut_{k}") for k in (0, 1)])


def fill_in_middle(docs: DataFrame, unit: str = CHARACTER, seed: int | str = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output of every row."""
    rows = _rows(docs)
    keyed = rows.repartition(*KEY)
    found = offsets(keyed, _requests(rows, unit, seed), unit).hint("shuffle_hash")
    cut = keyed.join(found, KEY, "left").withColumns({f"cut_{k}": F.coalesce(f"cut_{k}", F.lit(0)).cast("int") for k in (0, 1)})
    plain = (F.col("n") == 0) | F.col("text").rlike(TAG) | (F.pmod(_draw(seed, 2), F.lit(100)) >= plain_from)
    form = F.when(plain, "plain").when(F.pmod(_draw(seed, 3), F.lit(100)) < spm_below, "spm").otherwise("psm")
    first, middle, last = F.col("text").substr(F.lit(1), F.col("cut_0")), F.col("text").substr(F.col("cut_0") + 1, F.col("cut_1") - F.col("cut_0")), F.col("text").substr(F.col("cut_1") + 1, F.col("n").cast("int"))
    psm, spm = F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    chars = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return cut.withColumn("form", form).select(
        F.expr("try_cast(id as long)").alias("doc_id"), "n", "form", chars(F.col("cut_0")).alias("prefix_chars"), chars(F.col("cut_1") - F.col("cut_0")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text with a tag was cut, and the places where a tag meets a text can't make another one."""
    parts = F.split(output, TAG, -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
