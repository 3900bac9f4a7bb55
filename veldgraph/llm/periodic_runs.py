"""Runs of periodic words by a harmonic grid of longest common extensions.

A run of period p that is at least 4 p words long holds four neighbouring multiples of
p. So for each period the grid has the places j p, and where the words at j p, (j+1) p,
(j+2) p and (j+3) p are one and the same, the longest common extensions of j p and (j+1) p
forward and backward give the run: n log n places in all. An extension is the minimum
of the suffix array's neighbour lengths between two ranks, found in a table of minima
of doubling ranges; the backward one comes from the array of the reversed words. Only
texts with a place that passes need the arrays. What several places and multiples of
one period find is one run, with the least period.

Texts stay where they are: there is no shuffle, a task holds one Arrow batch of bounded
size, and an array takes n log n integers. Words are numbered exactly, not by hashes.

Nulls, empty and repeated rows: a null or wordless text has no runs and an empty
collapsed text. Every row stands for itself, also with a null or repeated doc_id. Of
runs with one exponent the one with the least start, then period, is the best. Other
columns are ignored unless kept by name. An empty table gives no rows. Texts of any
length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldgraph.llm.tokens import blocks

WORD = r"[^\x20\x09-\x0D]+"
#: A run has at least so many words, and so many periods. The grid needs four periods or more.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Grids of texts up to so many words are kept; those of longer ones are made period by period.
KEPT_GRID = 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_WORD = re.compile(WORD)


@cache
def _grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last places (j+3) p below n in order, with their j p and p."""
    last, at, period = [], [], []
    for p in range(1, n // 4 + 1):
        places = np.arange(3 * p, n, p, dtype=np.int32)
        last.append(places)
        at.append(places - 3 * p)
        period.append(np.full(len(places), p, dtype=np.int32))
    if not last:
        return (np.zeros(0, np.int32),) * 3
    joined = [np.concatenate(x) for x in (last, at, period)]
    order = np.argsort(joined[0], kind="stable")
    return joined[0][order], joined[1][order], joined[2][order]


def _candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places j p and periods p whose four words are equal."""
    n = len(words)
    if n <= KEPT_GRID:
        last, at, period = _grid(1 << max(4, int(n - 1).bit_length()))
        upto = int(np.searchsorted(last, n))
        at, period = at[:upto], period[:upto]
        for k in (1, 2, 3):
            same = np.flatnonzero(words[at] == words[at + k * period])
            at, period = at[same], period[same]
        return at.astype(np.int64), period.astype(np.int64)
    found: list[tuple[np.ndarray, int]] = []
    for p in range(1, n // 4 + 1):
        on = words[::p]
        pairs = on[1:] == on[:-1]
        hits = np.flatnonzero(pairs[:-2] & pairs[1:-1] & pairs[2:])
        if len(hits):
            found.append((hits * p, p))
    return np.concatenate([np.zeros(0, np.int64), *[h for h, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[np.full(len(h), p, np.int64) for h, p in found]])


class Extensions:
    """Longest common extensions of two places: suffix array by doubling, lengths shared by neighbours, and their range minima."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        levels, step = [words.astype(np.int64)], 1
        order = np.argsort(levels[0], kind="stable")
        while step < n:
            rank = levels[-1]
            pair = rank * (n + 1)
            pair[: n - step] += rank[step:] + 1
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            number = np.zeros(n, np.int64)
            np.cumsum(ordered[1:] != ordered[:-1], out=number[1:])
            fresh = np.empty(n, np.int64)
            fresh[order] = number
            levels.append(fresh)
            step *= 2
            if number[-1] == n - 1:
                break
        self.n = n
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        # Two suffixes agree in 2**k more words where their ranks of that level are equal.
        x, y = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (x < n) & (y < n)
            # A rank of words that run over the end tells shorter suffixes apart, so equal ranks mean equal whole words.
            equal = np.zeros(len(x), bool)
            equal[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            move = equal.astype(np.int64) << k
            shared, x, y = shared + move, x + move, y + move
        self.minima = [shared]
        while 2 << (len(self.minima) - 1) <= len(shared):
            half, below = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(below[: len(below) - half], below[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and j on; i and j differ, and n stands for the end."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            table = self.minima[k]
            out[inside[own]] = np.minimum(table[low[own]], table[high[own] - (1 << int(k))])
        return out


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    if least_periods < 4:
        raise ValueError("the grid finds runs of four periods and more")
    n = len(words)
    if n < max(least_words, least_periods):
        return []
    at, period = _candidates(words)
    if not len(at):
        return []
    forward, backward = Extensions(words), Extensions(words[::-1])
    start = at - backward.of(n - at, n - at - period)
    length = at + period + forward.of(at, at + period) - start
    long = (length >= np.maximum(least_words, least_periods * period)).nonzero()[0]
    best: dict[tuple[int, int], int] = {}
    for s, m, p in zip(start[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True):
        best[s, m] = min(p, best.get((s, m), p))
    return sorted((s, m, p) for (s, m), p in best.items())


def periodic_runs(docs: DataFrame, *keep: str, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The kept columns with ``runs`` and ``collapsed``: the words that no run repeats, joined by one space.

    A run repeats its words but for those of its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text_"):
            starts, rows, collapsed = [0], [], []
            for text in batch.column("text_").to_pylist():
                words = _WORD.findall(text or "")
                numbers: dict[str, int] = {}
                found = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32), least_words, least_periods)
                rows += found
                starts.append(len(rows))
                if found:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, m, p in found:
                        gone[s + p] += 1
                        gone[s + m] -= 1
                    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    words = [words[i] for i in kept.tolist()]
                collapsed.append(" ".join(words))
            fields = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            spans = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            kept_columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept_columns, spans, pa.array(collapsed, pa.string())], names=[*keep, "runs", "collapsed"])

    rows = docs.select(*keep, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, runs {RUNS}, collapsed string")


def best_run(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; null of none. ``runs`` are by start, then period."""
    better = lambda x, y: y.isNull() | (x["length"] * y["period"] > y["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda acc, x: F.when(better(x, acc), x).otherwise(acc))


def described(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
