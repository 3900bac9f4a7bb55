"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams of 1 to 3 characters, counted
over all labelled training texts. A document's most frequent n-grams are ranked in
the same way; its out-of-place distance to a profile is the sum of the differences
of ranks, with the profile's length for an n-gram the profile lacks. The language of
least distance is predicted. Ties of counts go to the lower n-gram, ties of
distances to the lower language name. Characters are lower-cased letters; all others
are one word boundary.

The counts are summed over all training texts; only the profiles (``profile_size``
times the number of languages, which ``max_languages`` bounds) come to the driver.

Nulls, empty and repeated rows: a text that is null or has no letter is ``und`` with
score 0. Training ignores rows without a language. With no training row at all every
row is ``und``. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldgraph.llm.tokens import blocks

PROFILE_SIZE = 400
MAX_LANGUAGES = 1000
#: A training task hands its counts on when it holds so many different n-grams.
HELD = 1 << 20

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, as three code points in 63 bits, and their counts.

    A boundary is code 1. The first field of a pair and the second of a single
    character are 0, so grams of different lengths never look alike.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    codes = np.concatenate(([1], np.where(_is_letter()[codes], codes, 1), [1]))
    codes = codes[np.concatenate(([True], (codes[1:] != 1) | (codes[:-1] != 1)))]
    one = codes[codes != 1]
    if not len(one):
        return one, one
    two = codes[:-1] << 21 | codes[1:]
    three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[1:-1] != 1]
    return np.unique(np.concatenate((one << 42, two, three)), return_counts=True)


def _counted(training: DataFrame) -> DataFrame:
    """(lang, gram, n) of the texts, summed within tasks as far as memory allows."""

    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            for i in range(0, len(keys), 1 << 16):
                own = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[own]), pa.string()), pa.array(keys[own]), pa.array(n[own])], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in blocks(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                k, c = grams(text)
                held.setdefault(lang, []).append((k, c))
                size += len(k)
            if size > HELD:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return training.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def profiles(training: DataFrame, profile_size: int = PROFILE_SIZE, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, in order, from all rows with a text and a language."""
    counts = _counted(training.filter("lang is not null and text is not null")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", rank).filter(F.col("rank") <= profile_size).limit(profile_size * max_languages + 1).collect()
    if len(rows) > profile_size * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, dtype=np.int64) for lang, g in found.items()}


class Ranker:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, known: dict[str, np.ndarray], profile_size: int = PROFILE_SIZE):
        self.langs, self.size = sorted(known), profile_size
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *known.values()]))
        self.ranks = np.full((len(self.langs), len(self.vocabulary)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.vocabulary, known[lang])] = np.arange(len(known[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its share of the closeness to all (1 minus distance over the largest distance)."""
        found, counts = grams(text or "")
        if not self.langs or not len(found):
            return "und", 0.0
        top = found[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.vocabulary, top)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == top
        place = self.ranks[:, at]
        away = np.where(known & (place >= 0), np.abs(place - np.arange(len(top))), self.size).sum(axis=1)
        near = 1.0 - away / (self.size * len(top))
        best = int(np.argmin(away))
        return self.langs[best], float(near[best] / near.sum()) if near.sum() > 0 else 1.0 / len(self.langs)


def predicted(docs: DataFrame, known: dict[str, np.ndarray], profile_size: int = PROFILE_SIZE, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(sent.value, profile_size)
        for batch in blocks(batches, "seen_text"):
            said = [ranker.predict(t) for t in batch.column("seen_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])
    return docs.select(*(F.col(f"`{f.name}`") for f in fields), F.col("text").alias("seen_text")).mapInArrow(run, schema)


def held_out(doc_id: str | Column = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == fold, F.lit(False))
