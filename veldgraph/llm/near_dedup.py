"""Near-duplicate documents by Fast Similarity Sketching.

Each shingle set gets a sketch of ``bands * rows`` coordinates. In round i every
element throws itself into a random coordinate with the value i + U(0,1); in the
second half of the rounds, round i fills coordinate i - t from all elements, so
every coordinate is filled after 2t rounds at most, mostly after few. Two sketches
agree in a coordinate with the Jaccard similarity as probability and are
concentrated as if coordinates were independent. Bands of coordinates give
candidates; every candidate is confirmed on the two full sets.

Documents with one and the same set are one class from the start. Within a bucket,
members are tested against one hub, not against each other. Buckets of one hub make a
group, and groups that links have not yet made one component are finished around the
centre of the component that most of their members have: the document closest to that
component's hub. Let a difference be the elements that only one of a document and the
centre has. If a document x is not similar to the centre but is similar to y, then the
differences of x and y share elements, since else y would be as far from x as x is from
the centre; how many at least follows from the sizes. So pairs meet in lists of such
elements, by prefixes of the differences that can't both miss all shared elements, what
only few documents have first. In a list, only those outside its main component are
held against the others, and only if signatures of 512 bits allow enough shared
elements. No link is lost, and the number of pairs follows the links and not the square
of a group. Every pair is confirmed on the two whole sets.

Sets hold 64-bit hashes of shingles; a wrong verdict needs hashes of two different
shingles of one pair to be equal, about 1e-13 for texts of 1,000 words. Words are hashed
modulo 2**64 and modulo a prime, so long words over two letters don't collide by their form.

Nulls, empty and repeated rows: a null or wordless text has the empty set and is
linked with nothing. A null doc_id can't be linked: component_id is null and the
row is kept. Rows that repeat a doc_id are one node. Texts of any length are read
whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldgraph.llm.components import connected
from veldgraph.llm.skew import split_join
from veldgraph.llm.tokens import U, blocks, mix, shingle_sets
from veldgraph.storage import stored

SHINGLE = 2
BANDS = 40
ROWS = 6
SIMILARITY = 80
#: 64-bit words of a signature.
SIGNATURE = 8
#: Rows of one key that a task takes before the key is split.
SPLIT = 256
WORDS = [f"word{i}" for i in range(SIGNATURE)]

_ROUND_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """The t coordinates of a non-empty set: round number in the high half, hash value in the low half."""
    seeds = _ROUND_SEEDS if len(_ROUND_SEEDS) == 2 * t else mix(np.arange(1, 2 * t + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    empty = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty)
    enough = t * (int(np.log(t)) + 3)
    done = 0
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + max(1, -(-enough // len(elements)))))
        hashes = mix(elements[None, :] ^ seeds[rounds][:, None])
        bins = ((hashes >> U(32)) * U(t)) >> U(32)
        late = rounds >= t
        bins[late] = (rounds[late] - t).astype(U)[:, None]
        values = (rounds.astype(U) << U(32))[:, None] | (hashes & U(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel().astype(np.intp), values.ravel())
        done = int(rounds[-1]) + 1
        if not (out == empty).any():
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=U)
    for column in coordinates.reshape(bands, rows).T:
        keys = mix(keys * U(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _sketched(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set and the bands (none for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sizes, first, second, keys = [], [], [], []
            for s in shingle_sets(batch.column("text"), shingle):
                sizes.append(len(s))
                first.append(int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                second.append(int(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
                keys.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _signature(elements: np.ndarray) -> list[int]:
    """512 bits, one of them set for each element."""
    bits = np.zeros(64 * SIGNATURE, dtype=np.uint8)
    bits[(mix(elements) % U(64 * SIGNATURE)).astype(np.intp)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _prefixes(x: np.ndarray, centre: np.ndarray, similarity: int) -> tuple[int, int, bool, list[int], list[int], list[int]]:
    """How a set differs from a centre: sizes of intersection and difference, whether it is similar, signature, and the prefixes ``far`` and ``any``.

    With P = 100 + similarity and Q = 100 - similarity, two sets are similar if and only
    if P * |difference| <= Q * (sum of sizes). From this for a set y similar to an x that
    is not similar to the centre: their differences share more than
    (P * |own| - Q * (n - n_centre)) / 2P elements, and at least
    (P * |x's| - Q * (n_x + n_centre)) / 200. A prefix leaves out one element less.
    """
    inside = np.isin(x, centre, assume_unique=True)
    more, less = x[~inside], np.setdiff1d(centre, x, assume_unique=True)
    differ, both = np.concatenate((more, less)), int(inside.sum())
    p, q, d = 100 + similarity, 100 - similarity, len(differ)
    linked = both > 0 and p * d <= q * (len(x) + len(centre))
    least_any = (p * d - q * (len(x) - len(centre))) // (2 * p) + 1
    least_far = max(1, -(-(p * d - q * (len(x) + len(centre))) // 200))
    signed = differ.view(np.int64)
    far = [] if linked else signed[: d - least_far + 1].tolist()
    return both, d, linked, _signature(differ), far, signed[: max(0, d - least_any + 1)].tolist()


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, splits) with both texts. ``a`` may stand in any number of pairs, so its text is repeated for each of its splits and joined with these."""
    of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    firsts = pairs.groupBy("a").agg(F.max("splits").alias("splits")).join(of("a").hint("merge"), "a")
    firsts = firsts.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"))
    split = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("splits")).cast("int").alias("part"))
    return split.join(of("b").hint("merge"), "b").join(firsts.hint("merge"), ["a", "part"]).select("a", "b", "text_a", "text_b")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int, differences: bool = False) -> DataFrame:
    """The pairs with ``shared``, the size of their full sets' intersection, and ``linked``; with ``differences`` also how b differs from a."""
    fields = "a long, b long, n_a long, n_b long, shared long, linked boolean"
    if differences:
        fields += ", differ long, signature array<long>, far array<long>, any array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *((pa.int64(), longs, longs, longs) if differences else ()))
        for batch in batches:
            for part in blocks([batch], "text_b", 4 << 20):
                firsts = part.column("text_a").dictionary_encode()
                sets = shingle_sets(firsts.dictionary, shingle)
                rows: list[tuple] = []
                for k, y in zip(firsts.indices.to_pylist(), shingle_sets(part.column("text_b"), shingle), strict=True):
                    x = sets[k]
                    if differences:
                        both, differ, linked, signature, far, short = _prefixes(y, x, similarity)
                        rows.append((len(x), len(y), both, linked, differ, signature, far, short))
                    else:
                        both = int(np.isin(x, y, assume_unique=True).sum())
                        rows.append((len(x), len(y), both, both > 0 and 100 * both >= similarity * (len(x) + len(y) - both)))
                columns = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[f.split()[0] for f in fields.split(", ")])

    return _with_texts(pairs, texts).mapInArrow(run, fields)


def _groups(bucketed: DataFrame) -> DataFrame:
    """(hub, id, splits): each member with the hub of each of its buckets, the member itself where it is the hub. Similar buckets choose the same one, and no window sorts a bucket."""
    hubs = bucketed.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = stored(hubs.select("band", "hub", F.ceil(F.col("size") / SPLIT).cast("int").alias("splits"), "size"), "hubs")
    return split_join(bucketed, hubs, ["band"]).groupBy("hub", "id").agg(F.max("splits").alias("splits"))


def _labelled(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """df with the component of a column's documents as ``label``; a document without links is its own."""
    named = labels.select(F.col("id").alias(column), "component").hint("merge")
    return df.join(named, column, "left").withColumn("label", F.coalesce("component", column)).drop("component")


def _centred(groups: DataFrame, tested: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, splits) of the centre of each unfinished group with its members."""
    mine = stored(_labelled(groups, labels, "id"), "groups")
    shares = mine.groupBy("hub", "label").agg(F.count("*").alias("members")).groupBy("hub")
    shares = shares.agg(F.max(F.struct("members", "label")).alias("main"), F.count("*").alias("labels"), F.sum("members").alias("size")).filter("labels > 1")
    linked = tested.filter("linked")
    closest = linked.groupBy(F.col("a").alias("hub")).agg(F.max(F.struct(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), -F.col("b"))).alias("best"), F.count("*").alias("links"))
    centres = _labelled(closest, labels, "hub").groupBy("label").agg(F.max(F.struct("links", -F.col("hub"), "best")).alias("top"))
    # One component may be the main one of most groups.
    shares = stored(shares.select("hub", F.col("main.label").alias("label"), "size"), "shares")
    centres = shares.groupBy("label").agg(F.count("*").alias("groups")).join(centres.select("label", (-F.col("top.best.col2")).alias("centre")).hint("merge"), "label", "left")
    named = split_join(shares, stored(centres, "mains"), ["label"], "groups").select("hub", F.coalesce("centre", "label").alias("a"), F.ceil(F.col("size") / SPLIT).cast("int").alias("splits"), "size")
    pairs = split_join(mine.select("hub", F.col("id").alias("b")), stored(named, "centres"), ["hub"])
    return pairs.filter("a <> b").groupBy("a", "b").agg(F.max("splits").alias("splits"))


def _listed(around: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, lists): the elements of all prefixes, and of each element's list its main component and size. Lists of one component or without two ends of a pair are none."""
    entry = lambda prefix, far: around.select("a", "b", "label", F.explode(prefix).alias("element"), F.lit(far).alias("far"))
    entries = entry("far", True).unionByName(entry("any", False))
    counts = entries.groupBy("a", "element", "label").agg(F.count("*").alias("size"), F.count_if("far").alias("far"))
    lists = counts.groupBy("a", "element").agg(F.max(F.struct("size", "label")).alias("main"), F.count("*").alias("labels"), F.sum("far").alias("far"), F.sum("size").alias("size"))
    lists = lists.filter("labels > 1 and far > 0 and far < size").select("a", "element", F.col("main.label").alias("main"), F.ceil(F.col("size") / SPLIT).cast("int").alias("splits"), "size")
    return entries, stored(lists, "lists")


def _apart(around: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, splits) of different components that the lists bring together and that signatures allow to be similar.

    Of the two ends of a pair one at least is outside the list's main component. That
    end is repeated for each split of the list, the other end stands in one of them.
    """
    entries, lists = _listed(around)
    traits = around.select("a", "b", "n_b", "differ", *[F.get("signature", F.lit(i)).alias(w) for i, w in enumerate(WORDS)])
    rows = stored(split_join(entries, lists, ["a", "element"]).join(traits.hint("merge"), ["a", "b"]), "entries")
    outside, every = F.col("label") != F.col("main"), F.sequence(F.lit(0), F.col("splits") - 1)
    own = F.array(F.pmod(F.xxhash64("b"), F.col("splits")).cast("int"))

    def side(far: bool, x: str) -> DataFrame:
        # In kind 0 the far end is outside the main component, in kind 1 it is within and the other end is outside.
        kinds = F.when(outside, F.array(F.lit(0)) if far else F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)) if far else F.array(F.lit(0)))
        kept = rows.filter(F.col("far") == far).withColumn("kind", F.explode(kinds))
        kept = kept.withColumn("part", F.explode(F.when((F.col("kind") == 0) == F.lit(far), every).otherwise(own)))
        return kept.select("a", "element", "kind", "part", *[F.col(c).alias(f"{c}_{x}") for c in ("b", "label", "n_b", "differ", *WORDS)])

    def most(x: str, y: str) -> Column:
        """An upper bound of the shared elements: what x differs by but for those that y can't have."""
        return F.col(f"differ_{x}") - sum(F.bit_count(F.col(f"{w}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{w}_{y}")))) for w in WORDS)

    apart = F.col("differ_x") + F.col("differ_y") - 2 * F.least(most("x", "y"), most("y", "x"))
    possible = (F.col("label_x") != F.col("label_y")) & ((100 + similarity) * apart <= (100 - similarity) * (F.col("n_b_x") + F.col("n_b_y")))
    pairs = side(True, "x").hint("merge").join(side(False, "y").hint("merge"), ["a", "element", "kind", "part"]).filter(possible)
    return pairs.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct().withColumn("splits", F.lit(1))


def links(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketched documents, classes of two and more equal sets, components of class representatives).

    The components are those of the graph of similar pairs, as far as the bands
    propose them: at the default 40 bands of 6, a pair of similarity 0.8 is missed
    once in 200,000 times.
    """
    base = stored(_sketched(docs, shingle, bands, rows), "sketches")
    known = base.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = stored(classes.filter("copies > 1"), "classes")
    alone = split_join(known.select("doc_id", "set_a", "set_b", "bands"), classes, ["set_a", "set_b"], "copies", "left").filter("class_id is null or class_id = doc_id")
    bucketed = stored(alone.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")), "buckets")
    groups = stored(_groups(bucketed), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    # The ids grow with the corpus, so they are never broadcast, not even where they happen to be few.
    wanted = groups.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    texts = stored(texts.join(wanted, "doc_id", "left_semi"), "texts")
    tested = stored(_compared(groups.filter("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b"), "splits"), texts, shingle, similarity), "tested")
    labels = stored(connected(tested.filter("linked").select("a", "b")), "labels")
    around = stored(_compared(_centred(groups.select("hub", "id"), tested, labels), texts, shingle, similarity, differences=True), "differences")
    labels = _more(labels, around)
    found = stored(_apart(stored(_labelled(around, labels, "b"), "around"), similarity), "pairs")
    return base, classes, _more(labels, stored(_compared(found, texts, shingle, similarity), "confirmed"))


def _more(labels: DataFrame, tested: DataFrame) -> DataFrame:
    """The components with further links. What is known is a star for each component, so only those and the new links are gone through."""
    fresh = tested.filter("linked").select("a", "b")
    if fresh.isEmpty():
        return labels
    stars = labels.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return stored(connected(stars.unionByName(fresh)), "labels")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    base, classes, labels = links(docs, shingle, bands, rows, similarity)
    # The component of a class comes with it, so no row looks for it by an id that many share.
    own = labels.select(F.col("id").alias("class_id"), "component").hint("merge")
    classes = stored(classes.join(own, "class_id", "left").select("set_a", "set_b", "copies", F.coalesce("component", "class_id").alias("class_component")), "classes")
    known = split_join(base.drop("bands"), classes, ["set_a", "set_b"], "copies", "left")
    out = known.join(labels.select(F.col("id").alias("doc_id"), "component").hint("merge"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("class_component", "component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
