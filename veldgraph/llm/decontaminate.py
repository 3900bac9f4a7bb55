"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document that share a run of ``match`` words (a seed, found
by running Karp-Rabin hash) are tiled: the longest common run of words that no tile
holds yet is marked in both texts, again and again, until none of ``match`` words is
left. Tiles are found wherever they stand, so an item whose sentences were dealt anew or
set apart by other text is still covered. A document is contaminated if the tiles
of one item cover ``coverage`` of its words. Words are runs of letters and digits
in lower case. An item of fewer than ``match`` words says too little to be a passage: it
matches where it is a whole line or sentence, between line ends and the marks . ! ?

Seeds are joined, not sent: tasks hold a bit table of the benchmark's seeds of
``filter_bytes`` at most, whatever the benchmark's size, and only what passes it is
joined with the table of seeds. So one pass reads the documents, only those with a
possible seed are written out, and the driver holds the bit table and nothing else.
An item leaves out of the join the seeds that most documents hold, as many as together
cover less of its words than is needed: a pair that shares no other seed can't be covered
enough. So a phrase that many documents and many items share joins none of them. Where the
words of all shared seeds are enough the pair is tiled. Seeds and items that many
documents share are split.

Nulls, empty and repeated rows: null or wordless texts match nothing, on either
side. Rows that repeat doc_id and text, or item_id and text, count once; a doc_id or
item_id with several texts is held with each of them, and the best counts. A null doc_id
is reported by ``contamination`` and left out by ``contaminated``. Long texts are read
whole; time and memory grow with their length and not with the product of equal seeds.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.llm.skew import split_join
from veldgraph.llm.tokens import PUNCTUATION, U, blocks, rolling, running_hash, word_hashes
from veldgraph.storage import stored

MATCH = 5
COVERAGE = 0.5
FILTER_BYTES = 16 << 20
#: The most items in one row of the table that seeds are looked up in.
LISTED = 1000
#: Documents of one seed that meet its items in one task.
SPLIT = 10_000
SCHEMA = "doc_id long, doc_key long, item_id long, n_item_words int, n_covered int, n_tiles int, coverage double"


class _Side:
    """One text's words with its running hash and what no tile holds yet."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free, self.sums = words, free, running_hash(words)
        self.renew()

    def renew(self) -> None:
        """How many free words follow from each place on."""
        taken = np.append(np.flatnonzero(~self.free), len(self.free))
        at = np.arange(len(self.free))
        self.room = taken[np.searchsorted(taken, at)] - at

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of free runs of n words and their hashes."""
        at = np.flatnonzero(self.room >= n)
        return at, rolling(self.sums, at, n)


def _longest(item: _Side, doc: _Side, least: int, most: int) -> int:
    """The length of the longest common free run, 0 if it is below ``least``: where there is a run, there is a shorter one."""
    low, high = least - 1, most
    while low < high:
        n = (low + high + 1) // 2
        if np.isin(item.runs(n)[1], doc.runs(n)[1]).any():
            low = n
        else:
            high = n - 1
    return low if low >= least else 0


def tiles(item: np.ndarray, doc: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (item position, document position, words), longest first; then leftmost in the item, then in the document.

    Both texts are word hashes. All tiles of one length are marked in one pass, and a
    run whose hashes agree is compared word by word.
    """
    if min(len(item), len(doc)) < match:
        return []
    one, other = _Side(item, np.ones(len(item), bool)), _Side(doc, np.ones(len(doc), bool))
    # Words of the document in no shared seed can be in no tile.
    at, seeds = other.runs(match)
    near = np.zeros(len(doc) + 1, np.int64)
    shared = at[np.isin(seeds, one.runs(match)[1])]
    np.add.at(near, shared, 1)
    np.add.at(near, shared + match, -1)
    other.free = np.cumsum(near[:-1]) > 0
    other.renew()
    out: list[tuple[int, int, int]] = []
    n = _longest(one, other, match, min(len(item), len(doc)))
    while n:
        places, hashes = other.runs(n)
        order = np.argsort(hashes, kind="stable")
        hashes, places = hashes[order], places[order]
        mine, own = one.runs(n)
        first, end = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        reached: dict[int, int] = {}
        for i, a, b in zip(mine.tolist(), first.tolist(), end.tolist(), strict=True):
            if a == b or not one.free[i : i + n].all():
                continue
            for k in range(reached.get(a, a), b):
                j = int(places[k])
                if other.free[j : j + n].all() and (item[i : i + n] == doc[j : j + n]).all():
                    one.free[i : i + n] = other.free[j : j + n] = False
                    out.append((i, j, n))
                    reached[a] = k + 1
                    break
            else:
                reached[a] = b
        one.renew()
        other.renew()
        n = _longest(one, other, match, n - 1)
    return out


def _seeds(words: np.ndarray, n: int) -> np.ndarray:
    return rolling(running_hash(words), np.arange(max(0, len(words) - n + 1)), n)


def _benchmark_seeds(items: DataFrame, match: int) -> DataFrame:
    """(item_key, n_words, length, seed, places): an item's seeds, of ``match`` words or of the whole item if it is shorter, and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words, at = word_hashes(batch.column("text"), PUNCTUATION)
            rows: list[tuple] = []
            for k, key in enumerate(batch.column("item_key").to_pylist()):
                own = words[at[k] : at[k + 1]]
                if len(own):
                    n = min(match, len(own))
                    seeds, where = np.unique(_seeds(own, n).view(np.int64), return_inverse=True)
                    order = np.argsort(where, kind="stable")
                    places = np.split(order, np.searchsorted(where[order], np.arange(1, len(seeds))))
                    rows += [(key, len(own), n, int(s), p.tolist()) for s, p in zip(seeds, places, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (*[pa.int64()] * 4, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_key", "n_words", "length", "seed", "places"])

    return items.select("item_key", "text").mapInArrow(run, "item_key long, n_words long, length long, seed long, places array<int>")


def _rare(held: DataFrame, coverage: float) -> DataFrame:
    """(item_key, seed) of the seeds that items are looked up by: all but the most frequent ones that cover too few of the item's words together. ``held`` has an item's seeds with their number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], []
            for key, n_words, length, seeds in zip(*(batch.column(c).to_pylist() for c in ("item_key", "n_words", "length", "seeds")), strict=True):
                covered, left = np.zeros(n_words, bool), []
                for s in sorted(seeds, key=lambda s: (-s["documents"], s["seed"])):
                    now = covered.copy()
                    for p in s["places"]:
                        now[p : p + length] = True
                    if left or now.sum() >= coverage * n_words:
                        left.append(s["seed"])
                    else:
                        covered = now
                keys += [key] * len(left)
                kept += left
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kept, pa.int64())], names=["item_key", "seed"])

    grouped = held.groupBy("item_key", "n_words", "length").agg(F.collect_list(F.struct("seed", "documents", "places")).alias("seeds"))
    return grouped.mapInArrow(run, "item_key long, seed long")


def _enough(pairs: DataFrame, match: int, coverage: float) -> DataFrame:
    """The pairs whose shared seeds touch enough of the item's words. ``pairs`` has the seeds of the document and those of the item with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for own, seeds, n_words, length in zip(*(batch.column(c).to_pylist() for c in ("own", "seeds", "n_words", "length")), strict=True):
                held, covered = set(own), np.zeros(n_words, bool)
                for s in seeds:
                    if s["seed"] in held:
                        for p in s["places"]:
                            covered[p : p + length] = True
                keep.append(bool(covered.sum() >= coverage * n_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("item_key")], names=["doc_key", "item_key"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("doc_key", "item_key", "own", "seeds", "n_words", "length").mapInArrow(run, "doc_key long, item_key long")


def _wholes(texts: pa.Array, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines and sentences that have one of some numbers of words, and which text each is of."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\n.!?]+")
    owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    words, at = word_hashes(parts.flatten(), PUNCTUATION)
    sums, size = running_hash(words), np.diff(at)
    found = [(rolling(sums, at[:-1][size == n], n), owner[size == n]) for n in lengths]
    return np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])


def _with_seeds(docs: DataFrame, seeds: DataFrame, match: int, filter_bytes: int) -> DataFrame:
    """(doc_id, doc_key, text, seeds) of the documents with runs that pass the bit table of the benchmark's seeds."""
    size = max(1, filter_bytes // 8)
    word, bit = F.pmod(F.shiftright("seed", 6), F.lit(size)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("seed").bitwiseAND(F.lit(63)).cast("int"))
    table = seeds.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    lengths = sorted(r["length"] for r in seeds.select("length").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast((table.column("word").to_numpy(), table.column("bits").to_numpy(), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_word, at_bits, lengths = sent.value
        bits = np.zeros(size, np.int64)
        bits[at_word] = at_bits
        for batch in blocks(batches, "text"):
            words, at = word_hashes(batch.column("text"), PUNCTUATION)
            sums, found = running_hash(words), [np.zeros(0, U)]
            owners = [np.zeros(0, np.int64)]
            short = [n for n in lengths if n < match]
            if short:
                hashes, owner = _wholes(batch.column("text"), short)
                signed = hashes.view(np.int64)
                hit = (bits[(signed >> 6) % size] >> (signed & 63)) & 1 == 1
                found.append(hashes[hit])
                owners.append(owner[hit])
            for n in (n for n in lengths if n == match):
                starts = np.arange(max(0, len(words) - n + 1))
                owner = np.searchsorted(at, starts, "right") - 1
                starts, owner = starts[starts + n <= at[owner + 1]], owner[starts + n <= at[owner + 1]]
                hashes = rolling(sums, starts, n)
                signed = hashes.view(np.int64)
                hit = (bits[(signed >> 6) % size] >> (signed & 63)) & 1 == 1
                found.append(hashes[hit])
                owners.append(owner[hit])
            hashes, owner = np.concatenate(found).view(np.int64), np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            rows, begin = np.unique(owner[order], return_index=True)
            lists = [np.unique(x).tolist() for x in np.split(hashes[order], begin[1:])] if len(rows) else []
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "doc_key", "text", "seeds"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key("doc_id"), "text").filter("text is not null")
    return own.mapInArrow(run, "doc_id long, doc_key long, text string, seeds array<long>").dropDuplicates(["doc_key"])


def _tiled(pairs: DataFrame, match: int, coverage: float) -> DataFrame:
    """Pairs (doc_id, text, item_id, item_text) of which the tiles cover enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks([batch], "text"):
                docs, items = part.column("text").dictionary_encode(), part.column("item_text").dictionary_encode()
                (words, at), (own, begin) = word_hashes(docs.dictionary, PUNCTUATION), word_hashes(items.dictionary, PUNCTUATION)
                rows = []
                for doc_id, key, d, item_id, i in zip(part.column("doc_id").to_pylist(), part.column("doc_key").to_pylist(), docs.indices.to_pylist(), part.column("item_id").to_pylist(), items.indices.to_pylist(), strict=True):
                    item = own[begin[i] : begin[i + 1]]
                    found = tiles(item, words[at[d] : at[d + 1]], min(match, len(item)))
                    covered = sum(t[2] for t in found)
                    if found and covered >= coverage * len(item):
                        rows.append((doc_id, key, item_id, len(item), covered, len(found), covered / len(item)))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return pairs.select("doc_id", "doc_key", "text", "item_id", "item_text").mapInArrow(run, SCHEMA)


def _key(column: str) -> Column:
    """Ids may be null or have several texts, so rows are told apart by id and text."""
    return F.xxhash64(F.col(column).cast("long"), F.xxhash64("text")).alias(column.replace("_id", "_key"))


def doc_key() -> Column:
    """What tells a document's row apart in ``contamination``."""
    return _key("doc_id")


def contamination(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Each document with each benchmark item of which its tiles cover at least ``coverage``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _key("item_id"), "text").filter("text is not null").dropDuplicates(["item_key"])
    seeds = stored(_benchmark_seeds(items, match), "seeds")
    hits = stored(_with_seeds(docs, seeds, match, filter_bytes), "hits")
    found = hits.select("doc_key", F.explode("seeds").alias("seed"))
    sizes = stored(found.groupBy("seed").agg(F.count("*").alias("documents")), "sizes")
    # A seed that no document holds is shared by no pair.
    used = stored(sizes.join(seeds.groupBy("seed").agg(F.count("*").alias("size")).hint("merge"), "seed"), "used")
    held = stored(split_join(seeds, used, ["seed"]), "held")
    rare = stored(_rare(held, coverage), "rare")
    # Items that are looked up by one seed stand in lists of bounded length, and a seed of many documents meets them in several tasks.
    lists = stored(rare.groupBy("seed").agg(F.count("*").alias("size"), F.ceil(F.count("*") / LISTED).alias("lists")), "lists")
    dealt = split_join(rare, lists, ["seed"]).groupBy("seed", F.pmod(F.xxhash64("item_key"), F.col("lists")).alias("list")).agg(F.collect_list("item_key").alias("items"))
    looked = lists.select("seed").join(sizes.withColumnRenamed("documents", "size").hint("merge"), "seed").withColumn("splits", F.ceil(F.col("size") / SPLIT).cast("int"))
    looked = stored(looked, "looked")
    asked = split_join(found, looked, ["seed"]).withColumn("split", F.pmod(F.xxhash64("doc_key"), F.col("splits")).cast("int")).drop("splits")
    dealt = dealt.join(looked.select("seed", "splits").hint("merge"), "seed").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    pairs = stored(asked.join(dealt.hint("merge"), ["seed", "split"]).select("doc_key", F.explode("items").alias("item_key")).distinct(), "proposed")
    # An item may be in any share of the documents.
    whole = held.groupBy("item_key", "n_words", "length").agg(F.collect_list(F.struct("seed", "places")).alias("seeds"))
    counted = lambda p: p.groupBy("item_key").agg(F.count("*").alias("size")).hint("merge")
    both = split_join(pairs, stored(whole.join(counted(pairs), "item_key"), "items"), ["item_key"]).join(hits.select("doc_key", F.col("seeds").alias("own")).hint("merge"), "doc_key")
    pairs = stored(_enough(both, match, coverage), "pairs")
    texts = items.select("item_key", "item_id", F.col("text").alias("item_text"))
    near = split_join(pairs, stored(texts.join(counted(pairs), "item_key"), "texts"), ["item_key"])
    return _tiled(hits.select("doc_key", "doc_id", "text").join(near.hint("merge"), "doc_key"), match, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row for each contaminated document: its number of items and the one covered most."""
    best = F.struct(F.col("coverage"), (-F.col("item_id")).alias("item"))
    found = contamination(docs, benchmark, match, coverage, filter_bytes).filter("doc_id is not null")
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max(best).alias("best")).select("doc_id", "n_items", (-F.col("best.item")).alias("item_id"), F.col("best.coverage").alias("coverage"))
