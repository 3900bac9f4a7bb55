"""Lines that many documents share, dropped everywhere but in one document.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys are
hashed, and (hash, document, place) rows are range-partitioned by all three columns and
sorted within a partition by hash, document (the largest first) and place. A stream over
a sorted partition meets a key's first occurrence first: that document keeps its
lines, and all later documents lose theirs once a third one is seen; no more than one
document's places are held back. Since the document belongs to the range, a key of any
number of lines is spread over as many partitions as its rows fill. Its part in a
partition that it may enter from the one before stays open, and is decided by a
table of the three largest documents of each partition's first and last key: at most six
rows a partition, so that table is broadcast.

What comes out is no text: for each document that loses lines, the zlib-compressed
bitmap of the lines it keeps, up to its last dropped line. ``applied`` joins
bitmaps and texts by document.

Nulls, empty and repeated rows: a null text is one empty line. Rows without a doc_id
lose nothing and don't count. Rows that repeat a doc_id are one document where documents
are counted, each with its own lines; they are told apart by a hash of the text. Where a
key's largest document has it in several lines, or rows, all of them stay. Other columns
pass through ``applied``. An empty table gives no rows. Texts and lines of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.storage import stored

#: The least code points of a key, and in how many documents it must be.
LEAST_CHARS = 20
LEAST_DOCS = 3
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "text_hash"]
DROPPED, OPEN, SUMMARY = 0, 1, 2
STREAMED = "kind int, hash_a long, hash_b long, doc_id long, text_hash long, place int"


def lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(hash_a, hash_b, doc_id, text_hash, place) of every line that is long enough: 128 bits of its key's SHA-256, and where it stands."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    split = known.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    key = F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER)
    hashed = split.withColumn("key", key).filter(F.length("key") >= least_chars).withColumn("hash", F.sha2("key", 256))
    # Fifteen hexadecimal digits fit a long; two such parts are 120 bits.
    part = lambda at: F.conv(F.substring("hash", at, 15), 16, 10).cast("long")
    return hashed.select(part(1).alias("hash_a"), part(17).alias("hash_b"), "doc_id", "text_hash", "place")


class _Stream:
    """Verdicts on the sorted rows of one partition, batch by batch."""

    def __init__(self, least_docs: int):
        self.least = least_docs
        #: The group that may go on in the next batch: its hash, its latest document, how many documents it has and the largest of these.
        self.hash: tuple[int, int] | None = None
        self.doc, self.docs, self.largest = 0, 0, []
        #: Whether it is the partition's first group, which may have begun before.
        self.first = True
        #: Rows of the group that wait for the number of its documents.
        self.held: list[np.ndarray] = []

    def _summary(self) -> list[tuple]:
        a, b = self.hash
        return [(SUMMARY, a, b, d, 0, 0) for d in self.largest]

    def _finish(self, last: bool) -> list[np.ndarray]:
        """What is known when the current group ends: it is open if it may have begun before or may go on."""
        if self.hash is None:
            return []
        out = []
        if self.first or last:
            out = [np.vstack([np.full(h.shape[1], OPEN), h]) for h in self.held]
            out.append(np.array(self._summary(), np.int64).T.reshape(6, -1))
        self.held = []
        return out

    def rows(self, columns: np.ndarray) -> list[np.ndarray]:
        """Verdicts on five columns of rows that follow those before."""
        out: list[np.ndarray] = []
        n = columns.shape[1]
        change = np.ones(n, bool)
        change[1:] = (columns[0, 1:] != columns[0, :-1]) | (columns[1, 1:] != columns[1, :-1])
        change[0] = self.hash != (int(columns[0, 0]), int(columns[1, 0]))
        if not change[0]:
            # The group goes on: its rows up to the next change.
            stop = int(np.flatnonzero(change)[0]) if change.any() else n
            out += self._more(columns[:, :stop])
            columns, change = columns[:, stop:], change[stop:]
            n -= stop
        if not n:
            return out
        out += self._finish(last=False)
        if self.hash is not None:
            self.first = False
        begins = np.flatnonzero(change)
        if self.first:
            # The partition's first group is taken by itself.
            stop = int(begins[1]) if len(begins) > 1 else n
            self._begin(columns[:, 0])
            out += self._more(columns[:, :stop])
            if len(begins) == 1:
                return out
            out += self._finish(last=False)
            self.first = False
            columns, begins = columns[:, stop:], begins[1:] - stop
        tail = int(begins[-1])
        out += self._whole(columns[:, :tail], begins[:-1])
        self._begin(columns[:, tail])
        return out + self._more(columns[:, tail:])

    def _begin(self, row: np.ndarray) -> None:
        self.hash, self.doc, self.docs, self.largest, self.held = (int(row[0]), int(row[1])), 0, 0, [], []

    def _more(self, columns: np.ndarray) -> list[np.ndarray]:
        """Rows of the current group."""
        fresh = np.ones(columns.shape[1], bool)
        fresh[1:] = columns[2, 1:] != columns[2, :-1]
        fresh[0] = self.docs == 0 or columns[2, 0] != self.doc
        ordinal = self.docs - 1 + np.cumsum(fresh)
        self.docs, self.doc = int(ordinal[-1]) + 1, int(columns[2, -1])
        if len(self.largest) < self.least:
            self.largest += columns[2, fresh][: self.least - len(self.largest)].tolist()
        if self.first:
            return [np.vstack([np.full(columns.shape[1], OPEN), columns])]
        later = columns[:, ordinal > 0]
        # The first document's rows are never dropped if the group begins here; the others' wait for enough documents.
        if self.docs < self.least:
            self.held.append(later)
            return []
        out = [np.vstack([np.full(h.shape[1], DROPPED), h]) for h in (*self.held, later)]
        self.held = []
        return out

    def _whole(self, columns: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """Groups that begin and end within the batch."""
        n = columns.shape[1]
        if not n:
            return []
        fresh = np.ones(n, bool)
        fresh[1:] = columns[2, 1:] != columns[2, :-1]
        fresh[begins] = True
        count = np.cumsum(fresh)
        sizes = np.diff(np.append(begins, n))
        before = np.repeat(count[begins] - 1, sizes)
        total = np.repeat(np.append(count[begins[1:]] - 1, count[-1]), sizes) - before
        gone = (count - before > 1) & (total >= self.least)
        return [np.vstack([np.full(int(gone.sum()), DROPPED), columns[:, gone]])]

    def end(self) -> list[np.ndarray]:
        return self._finish(last=True)


def streamed(rows: DataFrame, least_docs: int = LEAST_DOCS, ranges: int | None = None) -> DataFrame:
    """Dropped places, open places and summaries (``kind``) of ``lines`` after the range shuffle."""
    names = ["hash_a", "hash_b", "doc_id", "text_hash", "place"]
    order = ["hash_a", "hash_b", F.desc("doc_id"), "text_hash", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(least_docs)

        def batch_of(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            parts = [p for p in parts if p.shape[1]]
            if parts:
                table = np.hstack(parts)
                types = [pa.int32(), *[pa.int64()] * 4, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(table, types, strict=True)], names=["kind", *names])

        for batch in batches:
            if batch.num_rows:
                yield from batch_of(state.rows(np.vstack([batch.column(c).to_numpy().astype(np.int64) for c in names])))
        yield from batch_of(state.end())

    parted = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return parted.sortWithinPartitions(*order).mapInArrow(run, STREAMED)


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, ranges: int | None = None) -> DataFrame:
    """(doc_id, text_hash, place) of every line that goes."""
    found = stored(streamed(stored(lines(docs, least_chars), "lines"), least_docs, ranges), "verdicts")
    # A document that the border of two ranges cuts is in the summaries of both.
    summaries = found.filter(F.col("kind") == SUMMARY).select("hash_a", "hash_b", "doc_id").distinct()
    shared = summaries.groupBy("hash_a", "hash_b").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeps")).filter(F.col("docs") >= least_docs)
    opened = found.filter(F.col("kind") == OPEN).join(F.broadcast(shared), ["hash_a", "hash_b"]).filter("doc_id <> keeps")
    return found.filter(F.col("kind") == DROPPED).select(*KEY, "place").unionByName(opened.select(*KEY, "place"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, ranges: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap) of each document that loses lines.

    A set bit is a kept line; lines after the bitmap's last byte are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps = [], []
            for places in batch.column("places"):
                gone = places.values.to_numpy()
                keep = np.ones(int(gone.max()) + 1, bool)
                keep[gone] = False
                counts.append(len(keep) - int(keep.sum()))
                # The bits that fill the last byte stand for kept lines.
                maps.append(zlib.compress((~np.packbits(~keep)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=[*KEY, "n_dropped", "bitmap"])

    gathered = dropped_lines(docs, least_chars, least_docs, ranges).groupBy(*KEY).agg(F.collect_list("place").alias("places"))
    return gathered.mapInArrow(run, "doc_id long, text_hash long, n_dropped long, bitmap binary")


def applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines of their bitmaps as ``text`` and with n_lines (before) and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text_").to_pylist()
            for i, bitmap in enumerate(batch.column("bitmap_").to_pylist()):
                if bitmap is not None:
                    split = texts[i].split("\n")
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(split)].tolist()
                    keep += [1] * (len(split) - len(keep))
                    texts[i] = "\n".join([line for line, k in zip(split, keep, strict=True) if k])
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], "text_"])

    names = docs.columns
    rows = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    # The bitmaps are the small side; the texts are read past them and not sorted.
    joined = rows.join(bitmaps.hint("shuffle_hash"), KEY, "left")
    text = F.coalesce(F.col("row_.text"), F.lit(""))
    parts = joined.select("row_", (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), text.alias("text_"), F.col("bitmap").alias("bitmap_"))
    others = [F.col(f"row_.`{c}`").alias(c) for c in names if c not in ("text", "n_lines", "n_dropped")]
    flat = parts.select(*others, "n_lines", "n_dropped", "text_", "bitmap_")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema[:-2])
    return flat.mapInArrow(run, f"{schema}, text_ string").withColumnRenamed("text_", "text")


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, ranges: int | None = None) -> DataFrame:
    """``docs`` without the lines that go, with n_lines and n_dropped."""
    return applied(docs, keep_bitmaps(docs, least_chars, least_docs, ranges))
