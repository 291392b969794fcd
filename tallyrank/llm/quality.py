"""Document quality by Bradley-Terry ranking.

A document's strength is linear in features of its whole text. It is learned from preference pairs (a good document
over a bad one) by logistic loss on the differences of their features. The cut is a quantile of the strengths in the
labelled training documents, all of them: the one at the share of bad documents. Strengths become scores through a logistic curve that puts
the cut at the wanted threshold.

Features are shares of the text's bytes and words: letters, capitals, digits, signs, runs of one sign, words that
repeat the word before, words and word pairs that came before, mean word length, and the log of the length.
They know no vocabulary, so they carry over to any language with an alphabet.

Null and empty texts get the features of no words: all zero. Repeated rows are scored alike. A document as strong as the
cut is kept; the cut is halfway between the two neighbours in the order of strengths, so where these tie, all that tie
are kept. A doc_id with two different labels counts under both, with all its rows. Only doc_id and text are read. Weights are fitted on at most SAMPLE rows of each label, a documented bound. Features are those of
whole texts, in fitting as in scoring, and are taken by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from . import sampling
from .common import Workspace
from .words import SPACED, grams, slices, texts, tokenize

#: Training rows of each label, and preference pairs, at most.
SAMPLE, PAIRS = 4_000, 40_000
#: Strengths that the driver holds while it looks for the cut, and bins of a pass.
HELD, BINS = 10_000, 2_000
SEED = 7
#: Unlikely to clash with a column of the documents.
SCORE = "__quality_score"

_CLASS = np.zeros((256, 6), np.float32)  # capital, small, digit, sign, line feed, beyond ASCII
_CLASS[65:91, 0] = _CLASS[97:123, 1] = _CLASS[48:58, 2] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 3] = 1
_CLASS[10, 4] = 1
_CLASS[128:, 5] = 1
_KIND = np.argmax(_CLASS, axis=1).astype(np.uint8)
_KIND[_CLASS.sum(axis=1) == 0] = 6
FEATURES = 18


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    buf, offsets = texts(column)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(buf):
        return out
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kinds = _KIND[buf]

    def per_text(mask: np.ndarray) -> np.ndarray:
        if n == 1:  # perhaps a very long one: no array of places
            return np.array([np.count_nonzero(mask)])
        at = np.flatnonzero(mask)
        return np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])

    counts = [per_text(kinds == k) for k in range(6)]
    letters = np.maximum(counts[0] + counts[1] + counts[5], 1)
    same = np.zeros(len(buf), bool)
    same[1:] = (buf[1:] == buf[:-1]) & (kinds[1:] == 3)
    words = tokenize(buf, offsets, SPACED)
    total = words.counts
    many = np.maximum(total, 1).astype(np.float64)
    h = words.hashes
    text_of = np.repeat(np.arange(n), total)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    rows = lambda mask: np.bincount(text_of[mask], minlength=n)
    lone = rows((words.ends - words.starts == 1) & (kinds[words.starts] == 3)) if len(h) else np.zeros(n)
    closing = rows(kinds[words.ends - 1] == 3) if len(h) else np.zeros(n)
    capital = rows((kinds[words.starts] == 0) & (kinds[words.ends - 1] == 0)) if len(h) else np.zeros(n)
    out[:, 0] = counts[0] / letters
    out[:, 1] = counts[3] / size
    out[:, 2] = counts[2] / size
    out[:, 3] = per_text(same) / size
    out[:, 4] = np.bincount(text_of[again], minlength=n) / many
    out[:, 5] = 1 - _distinct(h, text_of, n) / many
    pairs = grams(h, 2)
    inside = text_of[:-1] == text_of[1:] if len(h) > 1 else np.zeros(0, bool)
    out[:, 6] = np.where(total > 1, 1 - _distinct(pairs[inside], text_of[:-1][inside] if len(h) > 1 else text_of[:0], n) / np.maximum(total - 1, 1), 0)
    out[:, 7] = lone / many
    out[:, 8] = closing / many
    out[:, 9] = capital / many
    out[:, 10] = np.bincount(text_of, weights=words.ends - words.starts, minlength=n) / many / 10
    out[:, 11] = counts[4] / many
    out[:, 12] = np.log1p(total) / 10
    for at, (source, edge) in enumerate([(9, 0.02), (8, 0.5), (7, 0.02), (4, 0.1), (3, 0.01)], 13):
        out[:, at] = out[:, source] > edge
    out[total == 0] = 0
    return out


def _distinct(values: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, text_of))
    v, t = values[order], text_of[order]
    first = np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])])
    return np.bincount(t[first], minlength=n)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0
    threshold: float = 0.3

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(good: np.ndarray, bad: np.ndarray, threshold: float, steps: int = 30, ridge: float = 1e-3) -> Ranking:
    """Logistic loss on differences of features of preference pairs, by Newton steps; then the cut."""
    every = np.concatenate([good, bad]) if len(good) + len(bad) else np.zeros((1, FEATURES))
    out = Ranking(every.mean(axis=0), every.std(axis=0) + 1e-6, np.zeros(FEATURES), threshold=threshold)
    if not len(good) or not len(bad):  # nothing to prefer: all alike, above the cut unless all are bad
        out.cut = 1.0 if len(bad) else -1.0
        return out
    rng = np.random.default_rng(SEED)
    n = min(PAIRS, 10 * max(len(good), len(bad)))
    d = (good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]) / out.scale
    w = np.zeros(FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance given to the wrong order
        gradient = d.T @ p / n - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out.weights = w
    return out


def train(good: list[str], bad: list[str], share_bad: float, threshold: float) -> Ranking:
    """share_bad: the part of bad documents among all labelled ones, whose strengths' quantile is the cut."""
    x = [features(pa.array(t, pa.large_string())) if t else np.zeros((0, FEATURES)) for t in (good, bad)]
    ranking = fit(*x, threshold)
    if not good or not bad:
        return ranking
    a, b = ranking.strength(x[0]), ranking.strength(x[1])
    # the sample holds each label up to a bound, so strengths are weighted back to the labels' shares
    strengths = np.concatenate([a, b])
    weights = np.concatenate([np.full(len(a), (1 - share_bad) / len(a)), np.full(len(b), share_bad / len(b))])
    order = np.argsort(strengths)
    at = int(np.searchsorted(np.cumsum(weights[order]), share_bad))
    at = min(at, len(order) - 2)
    ranking.cut = float(strengths[order][at] + strengths[order][at + 1]) / 2
    ranking.slope = _slope(a, b)
    return ranking


def _slope(good: np.ndarray, bad: np.ndarray) -> float:
    return float(np.clip(4 / max(1e-6, np.median(good) - np.median(bad)), 0.05, 20))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the features x of each whole text that is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(batch.column("text"))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    kind = StructType([docs.schema["doc_id"]]).add("x", ArrayType(DoubleType()))
    return docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(run, kind)


def nth(values: DataFrame, n: int) -> float:
    """The nth least (from 0) of the values v, exactly: bins are counted and the right one refined until it is small."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    inside = values
    while low < high and inside.count() > HELD:
        width = (high - low) / BINS
        binned = inside.withColumn("bin", F.least(F.floor((F.col("v") - low) / F.lit(width)), F.lit(BINS - 1)))
        for row in binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect():
            if n < row["n"]:
                break
            n -= row["n"]
        low, high = row["low"], row["high"]
        inside = values.where(F.col("v").between(low, high))
    return float(low) if low == high else sorted(r["v"] for r in inside.select("v").collect())[n]


def fitted(docs: DataFrame, labels: DataFrame, threshold: float) -> Ranking:
    """The ranking of documents with label 1 over those with label 0: weights from a sample, the cut from all."""
    taken, _ = sampling.chosen(labels, SAMPLE)
    known = labels.where("label is not null and doc_id is not null").distinct()
    space = Workspace(docs.sparkSession)
    rows = space.written(measured(docs).join(known, "doc_id"), "features")
    # an id may be that of many rows; the sample has one for each
    sample = rows.join(F.broadcast(taken), ["doc_id", "label"]).groupBy("label", "doc_id").agg(F.min("x").alias("x"))
    sample = sorted((r["label"], r["doc_id"], r["x"]) for r in sample.collect())
    good, bad = (np.array([x for label, _, x in sample if label == side]).reshape(-1, FEATURES) for side in (1, 0))
    ranking = fit(good, bad, threshold)
    if not len(good) or not len(bad):
        space.keep()
        return ranking
    ranking.slope = _slope(ranking.strength(good), ranking.strength(bad))
    factors = ranking.weights / ranking.scale
    strength = sum((F.col("x")[i] - float(ranking.mean[i])) * float(factors[i]) for i in range(FEATURES))
    strengths = space.written(rows.select(strength.alias("v"), "label"), "strengths")
    counts = {r["label"]: r["n"] for r in strengths.groupBy("label").agg(F.count("*").alias("n")).collect()}
    below = counts[0]  # as many fall under the cut as are bad
    ranking.cut = (nth(strengths, below - 1) + nth(strengths, below)) / 2
    space.keep()
    return ranking


def score(docs: DataFrame, model: Ranking, keep_text: bool = True, name: str = SCORE) -> DataFrame:
    """All columns of the documents (or all but the text), and a score under a name that they do not have."""
    fields = docs.schema.fields
    kept = [i for i, x in enumerate(fields) if keep_text or x.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.score(features(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(scores, pa.float64())], names=[*[batch.schema.names[i] for i in kept], name])

    return docs.mapInArrow(run, StructType([fields[i] for i in kept]).add(name, DoubleType()))
