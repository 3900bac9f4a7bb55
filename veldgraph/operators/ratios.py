"""The texts of a group that are most alike by the ratio of matching characters: all pairs, none lost.

The ratio is difflib's, 2 M / T: M characters lie in matching blocks, T is the length of
both texts. From 200 characters on, difflib looks up no character that makes up more than a
hundredth of the second text. So each block holds a character that is rare there (an
anchor), but for one that begins both texts. A block's characters lie right of an anchor,
up to the next one, or left of its first. At most as many anchors match with t characters
beside them as both texts share runs of an anchor and these t characters, so the shared
runs of a few lengths bound M. Unrelated texts share about half of what a ratio of 0.5
needs, and few pairs are left to match.

Texts are dealt into cells by group and length, asked texts into every cell whose lengths
allow the ratio, and no text is written once a pair. In a cell the runs of many asked
texts are the columns of a table; a text adds up the rows of its own runs, weighted by the
characters that they stand for. Runs are hashed: where two fall into one row, the bound
grows, and no pair is lost. The work grows with asked texts times texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.functions.parsers import AnchorMatcher, common_lines, ratio_from
from veldgraph.storage import stored

#: Characters beside an anchor from which on a longer run is asked for.
GRADES = (2, 4, 6, 9)
#: Characters and number of the texts of a cell, characters of its asked texts; asked texts and bits of a table, and its rows for each run of its longest text.
CELL_CHARS, CELL_ROWS, ASKED_CHARS, COLUMNS, BITS, ROOM = 16_000_000, 2_000, 32_000_000, 512, 1 << 28, 32
#: difflib's own: the length from which on it leaves popular characters out.
LONG = 200
STEP, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def most_alike(docs: DataFrame, key: str, group: str, asked: Column, least: float, most: int) -> DataFrame:
    """(key, other_id, ratio, rank): for every asked document the ``most`` others of its group with the greatest ratio of ``least`` or more, of equal ones the least ids. Null texts are left out."""
    if not 0 < least <= 1:
        raise ValueError("the least ratio is above 0 and 1 at most")
    docs = docs.filter("text is not null")
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = stored(docs.select(F.col(key).alias("id"), named.alias("g"), F.length("text").alias("n"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h"), F.coalesce(asked, F.lit(False)).alias("asked")), "texts")
    # Copies stand for each other: of one text, no more ids than a rank can hold and the asked one are needed.
    first = Window.partitionBy("g", "h").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = rows.withColumns({"place": F.row_number().over(Window.partitionBy("g", "h").orderBy("id")), "text_id": F.min("id").over(first)}).filter(F.col("place") <= most + 1)
    members = stored(members.select("id", "text_id", "g", "h", "n"), "members")
    mine = rows.filter("asked").withColumn("asked_id", F.min("id").over(Window.partitionBy("g", "h"))).select("id", "asked_id", "g", "h", "n")

    alike = _within_cells(docs.select(F.col(key).alias("id"), "text"), members.filter("id = text_id"), mine.filter("id = asked_id"), least)
    best = Window.partitionBy("asked_id").orderBy(F.desc("ratio"), "other_id")
    found = alike.join(members.select(F.col("id").alias("other_id"), "text_id"), "text_id").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most + 1).drop("place")
    found = found.join(mine.select(F.col("id").alias(key), "asked_id"), "asked_id").filter(F.col(key) != F.col("other_id"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ratio"), "other_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "other_id", "ratio", "rank")


def _within_cells(docs: DataFrame, texts: DataFrame, mine: DataFrame, least: float) -> DataFrame:
    """(asked_id, text_id, ratio) of all asked and other texts with that ratio. Lengths are in classes of half as much again; where a group is small, in one."""
    total = texts.groupBy("g").agg(F.sum(F.col("n") + 16).alias("all"))
    parts = mine.groupBy("g").agg(F.ceil(F.sum(F.col("n") + 16) / ASKED_CHARS).alias("asked_parts")).join(total, "g")
    level = lambda n: F.when(F.col("all") > CELL_CHARS // 16, F.floor(F.log(1.5, n + 1))).otherwise(0).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("h"), n).cast("int")
    texts = texts.join(F.broadcast(parts), "g").withColumn("level", level(F.col("n")))
    sizes = stored(texts.groupBy("g", "level", "asked_parts", "all").agg(F.ceil(F.greatest(F.sum(F.col("n") + 16) / CELL_CHARS, F.count("id") / CELL_ROWS)).alias("parts")), "cells")
    cells = sizes.agg(F.sum(F.col("parts") * F.col("asked_parts"))).first()[0] or 1

    cell = F.concat_ws(":", "level", "part", "asked_part", "g")
    texts = texts.join(F.broadcast(sizes.select("g", "level", "parts")), ["g", "level"]).withColumn("part", dealt(F.col("parts")))
    texts = texts.withColumn("asked_part", F.explode(F.sequence(F.lit(0), F.col("asked_parts").cast("int") - 1))).select("id", cell.alias("cell"), F.lit(1).alias("role"))
    wide = (2 - least) / least
    low, high = level(F.greatest(F.lit(0), F.floor(F.col("n") / wide * 0.999) - 1)), level(F.ceil(F.col("n") * wide * 1.001) + 1)
    mine = mine.join(F.broadcast(parts), "g").withColumns({"low": low, "high": high, "asked_part": dealt(F.col("asked_parts"))}).select("id", "g", "low", "high", "asked_part")
    mine = mine.join(F.broadcast(sizes.select("g", "level", "parts")), "g").filter("level between low and high")
    mine = mine.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).select("id", cell.alias("cell"), F.lit(0).alias("role"))

    met = docs.join(mine, "id").unionByName(docs.join(texts, "id")).repartition(max(12, min(2 * cells, 20_000)), "cell").sortWithinPartitions("cell", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])
        for batch in batches:
            for name, role, i, text in zip(*(batch.column(c) for c in ("cell", "role", "id", "text")), strict=True):
                if name != at:
                    yield from compared(*held, least)
                    at, held = name, ([], [])
                held[role.as_py()].append((i.as_py(), text.as_py()))
        yield from compared(*held, least)

    def compared(asked: list, others: list, least: float) -> Iterator[pa.RecordBatch]:
        if asked and others:
            for found in matches(asked, others, least):
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((key_type, key_type, pa.float64()))], names=["asked_id", "text_id", "ratio"])

    kind = docs.schema["id"].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return met.select("cell", "role", "id", "text").mapInArrow(run, f"asked_id {kind}, text_id {kind}, ratio double")


class Runs:
    """A text's anchors: the runs beside them (hashed) with the characters that each stands for, and where the first anchor is."""

    def __init__(self, text: str) -> None:
        codes = codes_of(text)
        self.n = len(codes)
        top = int(codes.max()) + 1 if self.n else 1
        counts = np.bincount(codes.astype(np.intp), minlength=top)
        self.chars = np.flatnonzero(counts)
        self.counts = counts[self.chars]
        self.rare = self.chars if self.n < LONG else self.chars[self.counts <= self.n // 100 + 1]
        at = places_of(codes, self.rare) if self.n >= LONG else np.arange(self.n)
        self.first = int(at[0]) if len(at) else self.n
        right, left = _beside(at, self.n)
        last = GRADES[0] - 1
        hashes, weights = [_steps(codes, at, 1, None, 0)], [1 + np.minimum(right, last) + np.minimum(left, last)]
        for _, k, h, gap in _graded(codes, at, right, left, GRADES):
            hashes.append(h)
            weights.append((np.minimum(gap, GRADES[k + 1] - 1) if k + 1 < len(GRADES) else gap) - GRADES[k] + 1)
        h, w = np.concatenate(hashes), np.concatenate(weights)
        order = np.argsort(-w, kind="stable")  # of equal runs those that stand for more count first
        order = order[np.argsort(h[order], kind="stable")]
        self.hashes, self.weights = _numbered(h[order]), w[order].astype(np.float32)


class InOrder:
    """The runs beside a text's anchors in order, for a bound that no order of blocks passes."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, right: np.ndarray, left: np.ndarray) -> None:
        self.anchors = codes[at].tolist()
        self.beside = min(GRADES[0] - 1, int(right.max(initial=0))) + min(GRADES[0] - 1, int(left.max(initial=0)))
        self.runs = {(side, k): (h.tolist(), gap) for side, k, h, gap in _graded(codes, at, right, left, GRADES)}

    @classmethod
    def of(cls, text: str, rare: np.ndarray, whole: bool) -> InOrder:
        """Of the second text (``whole``), whose runs end at the next anchor, or of a first one, whose runs end with it."""
        codes = codes_of(text)
        at = places_of(codes, rare)
        return cls(codes, at, *(_beside(at, len(codes)) if whole else (len(codes) - 1 - at, at)))

    def bound(self, a: InOrder) -> int:
        """No more characters lie in blocks with the first text ``a``, but for a common beginning: of each length of run, as many as both have in the same order."""
        most = (1 + self.beside) * common_lines(a.anchors, self.anchors)
        for (side, k), (own, gap) in self.runs.items():
            other = a.runs.get((side, k), ((), None))[0]
            if k + 1 < len(GRADES):
                most += (GRADES[k + 1] - GRADES[k]) * common_lines(other, own)
            elif shared := set(other).intersection(own):
                most += sum(int(g) - GRADES[k] + 1 for h, g in zip(own, gap, strict=True) if h in shared)
        return most


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def places_of(codes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Where one of ``chars`` stands."""
    if not len(codes) or not len(chars):
        return np.zeros(0, np.intp)
    known = np.zeros(int(max(codes.max(), chars.max())) + 1, bool)
    known[chars.astype(np.intp)] = True
    return np.flatnonzero(known[codes.astype(np.intp)])


def _beside(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many characters lie right and left of each anchor, up to the next one."""
    return np.diff(at, append=n) - 1, np.diff(at, prepend=-1) - 1


def _graded(codes: np.ndarray, at: np.ndarray, right: np.ndarray, left: np.ndarray, grades: tuple) -> Iterator[tuple]:
    """(side, grade, hashes, characters beside) of the runs beside each place that has so many characters there."""
    start = _steps(codes, at, 1, None, 0)
    for side, gap in ((1, right), (-1, left)):
        places, h, t = at, start, 0
        for k, grade in enumerate(grades):
            kept = gap >= grade
            places, gap, h = places[kept], gap[kept], h[kept]
            if not len(places):
                break
            h = _steps(codes, places, side, h, t, grade)
            t = grade
            yield side, k, _of(h, side), gap


def _steps(codes: np.ndarray, at: np.ndarray, side: int, h: np.ndarray | None, done: int, to: int = 0) -> np.ndarray:
    """Hashes of the characters at ``at`` and ``to`` more beside them, from those of ``done`` more."""
    if h is None:
        h, done = codes[at] * PRIME, 0
    for k in range(done + 1, to + 1):
        h = ((h ^ (h >> np.uint64(31))) + codes[at + side * k]) * PRIME
    return h


def _of(h: np.ndarray, side: int) -> np.ndarray:
    return h if side > 0 else h ^ STEP


def _numbered(h: np.ndarray) -> np.ndarray:
    """Sorted hashes, the k-th of equal ones hashed with k, as 32 bits."""
    if not len(h):
        return np.zeros(0, np.uint32)
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    k = np.arange(len(h)) - np.repeat(starts, np.diff(starts, append=len(h)))
    h = (h + k.astype(np.uint64) * STEP) * PRIME
    return ((h ^ (h >> np.uint64(33))) * PRIME >> np.uint64(32)).astype(np.uint32)


def _all_runs(text: str, chars: np.ndarray, grades: tuple) -> np.ndarray:
    """The hashed runs beside each of ``chars`` in the text, whatever characters they hold."""
    codes = codes_of(text)
    at = places_of(codes, chars)
    return _numbered(np.sort(np.concatenate([_steps(codes, at, 1, None, 0), *(h for _, _, h, _ in _graded(codes, at, len(codes) - 1 - at, at, grades))])))


def matches(asked: list[tuple], others: list[tuple], least: float) -> Iterator[list[tuple]]:
    """(asked id, other id, ratio) of all pairs of (id, text) with a ratio of ``least`` or more, in lists."""
    asked = sorted(asked, key=lambda x: len(x[1]))
    others = sorted(others, key=lambda x: len(x[1]))
    runs = [Runs(text) for _, text in others]
    long = [k for k, r in enumerate(runs) if r.n >= LONG]
    # Characters that are rare in a tenth of the long texts, or everywhere, are the anchors of most of them; other texts have tables of their own.
    rare_in, count = Counter(), Counter()
    for k in long:
        rare_in.update(runs[k].rare.tolist())
        count.update(dict(zip(runs[k].chars.tolist(), runs[k].counts.tolist(), strict=True)))
    total = sum(count.values())
    usual = {c for c, n in rare_in.items() if 10 * n > len(long) or 100 * count[c] < total}
    for r in runs:
        r.usual = r.n >= LONG and usual.issuperset(r.rare.tolist())
    for kept, grades in (([k for k in long if runs[k].usual], GRADES), ([k for k in long if not runs[k].usual], GRADES), ([k for k, r in enumerate(runs) if r.n < LONG], ())):
        if kept:
            chars = np.unique(np.concatenate([runs[k].rare for k in kept]))
            yield from _by_tables(asked, [(*others[k], runs[k]) for k in kept], chars, grades, least)


def _by_tables(asked: list[tuple], others: list[tuple], chars: np.ndarray, grades: tuple, least: float) -> Iterator[list[tuple]]:
    sizes = np.array([o[2].n for o in others])
    wide = (2 - least) / least
    first = int(np.searchsorted([len(a[1]) for a in asked], sizes[0] / wide - 2))
    pairs: list[tuple[int, int]] = []
    while first < len(asked) and len(asked[first][1]) <= sizes[-1] * wide + 2:
        found, bits, last = [], 4, first
        while last < len(asked) and len(found) < COLUMNS and len(asked[last][1]) <= min(sizes[-1] * wide, 2 * len(asked[first][1])) + 2:
            own = _all_runs(asked[last][1], chars, grades)
            more = max(bits, int(max(1, len(own)) * ROOM - 1).bit_length())
            if found and (len(found) + 1) << more > BITS:
                break
            found.append(own)
            bits, last = more, last + 1
        bits = min(bits, 24)
        table = np.zeros((1 << bits, -(-len(found) // 8)), np.uint8)
        for k, own in enumerate(found):
            table[own >> np.uint32(32 - bits), k // 8] |= 128 >> k % 8
        lengths = np.array([len(a[1]) for a in asked[first:last]])
        at, end = np.searchsorted(sizes, [lengths[0] / wide - 2, lengths[-1] * wide + 2])
        for b in range(int(at), int(end)):
            r = others[b][2]
            need = least * (lengths + r.n) / 2
            held = np.unpackbits(np.take(table, (r.hashes >> np.uint32(32 - bits)).astype(np.intp), axis=0), axis=1, count=len(found))
            lacks = need - 0.01 - 1.00001 * (r.weights @ held.astype(np.float32))
            for k in np.flatnonzero((lacks <= r.first) & (np.minimum(lengths, r.n) >= need - 0.01)).tolist():
                if lacks[k] <= 0 or asked[first + k][1].startswith(others[b][1][: math.ceil(lacks[k])]):
                    pairs.append((b, first + k))
            if len(pairs) >= 50_000:
                yield _matched(pairs, asked, others, least)
                pairs = []
        first = last
    if pairs:
        yield _matched(sorted(pairs), asked, others, least)


def _matched(pairs: list[tuple[int, int]], asked: list[tuple], others: list[tuple], least: float) -> list[tuple]:
    at, found = None, []
    for b, a in pairs:
        one, other = asked[a][1], others[b][1]
        if one == other:
            found.append((asked[a][0], others[b][0], 1.0))
            continue
        if b != at:
            at, matcher, runs = b, None, others[b][2]
            ordered = InOrder.of(other, runs.rare, True) if runs.n >= LONG else None
        need = least * (len(one) + len(other)) / 2 - 1e-6
        most = ordered.bound(InOrder.of(one, runs.rare, False)) if ordered else common_lines(one, other)  # of a short text, each character is an anchor
        if most < need and not (runs.first and one.startswith(other[: math.ceil(need - most)])):
            continue
        matcher = matcher or AnchorMatcher(other)
        matcher.set_seq1(one)
        score = ratio_from(matcher, least)
        if score is not None and score >= least:
            found.append((asked[a][0], others[b][0], score))
    return found
