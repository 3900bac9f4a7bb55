"""Toxicity by weak supervision.

1. *Voters.* The distinct word beginnings of 4, 5 and 6 bytes (a shorter word counts
   with its end) of the labelled rows are counted in toxic and in clean documents;
   the most telling ones become the lexicon, each a voter. Three patterns (shouting,
   rows of exclamation marks, remarks on the reader) vote toxic as well; a text on
   which all of these abstain gets a vote for clean; and the given label votes.
2. *Label model.* A generative model with the true class hidden and each voter's
   accuracy is estimated by expectation-maximisation. Voters that vote together
   within a class are not independent evidence: the correlations within the classes
   are estimated in each step, and a voter's log odds are divided by one plus the
   sum of its positive correlations with others.
3. *Classifier.* A logistic regression on the lexicon and the patterns is trained on
   the posterior labels, not on the given ones. It alone scores documents.

The model is fitted to a bounded sample: at most ``max_rows`` labelled documents, those
with the least hashes of doc_id. Counting runs in tasks; the driver gets ``max_features``
counts and, for the sample, which of those each document has. Scoring reads every whole text once and
shuffles nothing; what is broadcast has at most ``max_features`` entries.

Nulls, empty and repeated rows: a null text is an empty one and gets the score of a
text without any hit. Labels that are null or not 0 or 1 are not used; of several for
one document the highest counts. Without any toxic label every score is the
classifier's prior. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldgraph.llm.tokens import U, blocks, prefix_hashes

MAX_ROWS = 20_000
MAX_FEATURES = 2_000
MAX_VOTERS = 250
SIZES = (4, 5, 6)
#: A beginning that fewer toxic rows have is no voter.
LEAST_SUPPORT = 4
THRESHOLD = 0.3
#: Weaker correlations of voters are taken as chance.
CORRELATED = 0.25
#: RE2 patterns on the text as it is.
PATTERNS = (r"\b[A-Z]{4,}\b[^a-z]{0,40}\b[A-Z]{4,}\b", r"!!", r"(?i)\byou(?:'re| are| r)? (?:a|an|so|such|all)\b")


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the features, then of the patterns
    bias: float
    accuracies: np.ndarray  # of the voters; the last two are the one for texts without any hit and the given label


def _distinct(hashes: list[np.ndarray], at: np.ndarray, i: int) -> np.ndarray:
    return np.unique(np.concatenate([h[at[i] : at[i + 1]] for h in hashes]))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, clean, toxic): in how many rows of each label it occurs. Feature 0 occurs in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in held]])
            label = np.concatenate([np.zeros(0, np.int64), *[np.full(len(k), y) for k, y in held]])
            found, where = np.unique(keys, return_inverse=True)
            toxic = np.bincount(where, weights=label, minlength=len(found)).astype(np.int64)
            every = np.bincount(where, minlength=len(found)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(every - toxic), pa.array(toxic)], names=["feature", "clean", "toxic"])

        for batch in blocks(batches, "text"):
            hashes, at = prefix_hashes(batch.column("text"), SIZES)
            for i, label in enumerate(batch.column("label").to_pylist()):
                keys = np.concatenate(([0], _distinct(hashes, at, i).view(np.int64)))
                held.append((keys, label))
                size += len(keys)
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
        yield flush()

    return rows.select("text", "label").mapInArrow(run, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


class _Finder:
    """Which known features occur in texts."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(features >> U(48)).astype(np.intp)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) index pairs, distinct and in order."""
        hashes, at = prefix_hashes(texts, SIZES)
        pairs = [np.zeros(0, np.int64)]
        for h in hashes if len(self.features) else ():
            near = np.flatnonzero(self.maybe[(h >> U(48)).astype(np.intp)])
            place = np.searchsorted(self.features, h[near])
            place[place == len(self.features)] = 0
            own = self.features[place] == h[near]
            text = np.searchsorted(at, near[own], "right") - 1
            pairs.append(text * len(self.features) + place[own])
        both = np.unique(np.concatenate(pairs))
        n = max(1, len(self.features))
        return both // n, both % n


def _patterns(texts: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts, "")
    return np.array([pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in PATTERNS], dtype=bool)


def label_model(votes: np.ndarray, start: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, accuracy of each voter) of a matrix of votes: 1 toxic, -1 clean, 0 abstains.

    ``start`` is a first guess of the posteriors, and its mean the share of toxic rows. A voter is right with its accuracy
    whenever it votes, and never worse than chance; abstaining says nothing.
    """
    posterior, accuracy = start.astype(float), np.full(votes.shape[1], 0.5)
    if not votes.size:
        return posterior, accuracy
    v = votes.astype(np.float64)
    toxic, clean, cast = v > 0, v < 0, np.abs(v)
    share = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
    for _ in range(steps):
        right = posterior @ toxic + (1 - posterior) @ clean
        accuracy = np.clip((right + 1) / (cast.sum(axis=0) + 2), 0.5, 0.999)
        together = np.zeros((v.shape[1], v.shape[1]))
        for w in (1 - posterior, posterior):
            total = w.sum() + 2
            rate = w @ cast / total
            middle = cast - rate
            spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
            together += (w.sum() / len(v)) * ((middle * w[:, None]).T @ middle) / total / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        together[together < CORRELATED] = 0
        alone = 1 / (1 + np.minimum(together, 1).sum(axis=1))
        odds = np.log(share / (1 - share)) + v @ (np.log(accuracy / (1 - accuracy)) * alone)
        now = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = np.abs(now - posterior).max()
        posterior = now
        if moved < 1e-6:
            break
    return posterior, accuracy


def logistic(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, ridge: float = 0.1, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression of soft targets on a sparse 0/1 matrix, by Newton steps that conjugate gradients solve."""
    n, w = len(target), np.zeros(width + 1)
    if not n:
        return w[:-1], 0.0
    times = lambda v: np.bincount(rows, weights=v[:-1][columns], minlength=n) + v[-1]
    back = lambda u: np.append(np.bincount(columns, weights=u[rows], minlength=width), u.sum())
    hold = np.append(np.full(width, ridge), 1e-3)
    w[-1] = np.log((target.sum() + 0.5) / (n - target.sum() + 0.5))
    loss = lambda v: float(np.logaddexp(0, times(v)).sum() - target @ times(v) + 0.5 * (hold * v * v).sum())
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope, curve = back(p - target) + hold * w, np.maximum(p * (1 - p), 1e-9)
        move, left = np.zeros(width + 1), -slope
        way, size = left.copy(), left @ left
        for _ in range(60):
            if size < 1e-12:
                break
            turned = back(curve * times(way)) + hold * way
            far = size / (way @ turned)
            move, left = move + far * way, left - far * turned
            way, size = left + (left @ left) / size * way, left @ left
        scale = 1.0
        while (then := loss(w + scale * move)) > now and scale > 1e-4:
            scale /= 2
        if now - then < 1e-6 * n * 1e-3:
            break
        w, now = w + scale * move, then
    return w[:-1], float(w[-1])


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, max_voters: int = MAX_VOTERS) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, label)."""
    from veldgraph.storage import stored

    known = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "labelled")
    counts = _counted(sample)
    totals = counts.filter("feature = 0").collect()
    clean, toxic = (int(totals[0]["clean"] or 0), int(totals[0]["toxic"] or 0)) if totals else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    told = counts.filter((F.col("feature") != 0) & (F.col("toxic") >= LEAST_SUPPORT)).withColumn("told", odds * F.sqrt("toxic"))
    top = told.filter(odds > 1.0).orderBy(F.desc("told"), "feature").limit(max_features).collect()
    by_worth = np.array([r["feature"] for r in top], dtype=np.int64).view(U)
    features = np.sort(by_worth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(features)
        for batch in blocks(batches, "text"):
            text, feature = finder.hits(batch.column("text"))
            own = np.split(feature.astype(np.int32), np.searchsorted(text, np.arange(1, batch.num_rows)))
            fired = _patterns(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(list(own), pa.list_(pa.int32())), pa.array([np.flatnonzero(f).astype(np.int32) for f in fired.T], pa.list_(pa.int32()))],
                names=["doc_id", "label", "hits", "patterns"],
            )

    seen = sample.withColumn("label", F.col("label").cast("int")).mapInArrow(run, "doc_id long, label int, hits array<int>, patterns array<int>")
    # Of several texts of one doc_id the one with the least hits counts, whatever the order of arrival.
    rows = seen.groupBy("doc_id", "label").agg(F.min(F.struct("hits", "patterns")).alias("least")).select("doc_id", "label", "least.*").toPandas()
    rows = rows.sort_values("doc_id")
    label = rows["label"].to_numpy(dtype=float)
    width = len(features) + len(PATTERNS)
    hits = [np.concatenate((np.asarray(h, dtype=np.int64), np.asarray(p, dtype=np.int64) + len(features))) for h, p in zip(rows["hits"], rows["patterns"], strict=True)]
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate([np.zeros(0, np.int64), *hits])
    voters = np.concatenate((np.searchsorted(features, by_worth[:max_voters]), np.arange(len(features), width)))
    votes = np.zeros((len(hits), len(voters) + 2), dtype=np.int8)
    place = np.full(width, -1)
    place[voters] = np.arange(len(voters))
    inside = place[column] >= 0
    votes[row[inside], place[column[inside]]] = 1
    votes[:, -2] = -1 * ~votes.any(axis=1)
    votes[:, -1] = np.where(label > 0, 1, -1)
    posterior, accuracies = label_model(votes, 0.05 + 0.9 * label)
    weights, bias = logistic(row, column, posterior, width)
    return Model(features, weights, bias, accuracies)


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        finder = _Finder(m.features)
        for batch in blocks(batches, "seen_text"):
            text, feature = finder.hits(batch.column("seen_text"))
            odds = m.bias + np.bincount(text, weights=m.weights[feature], minlength=batch.num_rows)[: batch.num_rows]
            odds = odds + m.weights[len(m.features) :] @ _patterns(batch.column("seen_text"))
            score = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*(f.name for f in fields), "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    return docs.select(*(F.col(f"`{f.name}`") for f in fields), F.col("text").alias("seen_text")).mapInArrow(run, schema)
