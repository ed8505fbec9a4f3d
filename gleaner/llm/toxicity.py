"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are used. Features are words and word openings
(hashes) that confirmed documents have more often than unlabelled ones; a linear model over
their presence is trained with the non-negative risk: with class prior ``p``, the risk of
unlabelled text as negative, less ``p`` times that of the positives, is kept from falling below
zero, so the model cannot win by overfitting it.

Only the fit uses samples, of at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` documents, spread by
hash; feature counts over them are made by Spark. Whole texts of all rows are scored.

Defined cases: null and empty texts have no feature and get the score of the intercept; without
confirmed documents every score is 0; contradicted labels are ignored; repeated rows are scored
one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.folds import bounded, in_fold, labelled
from gleaner.llm.rows import mapped
from gleaner.llm.words import hash_words, plain_bytes, word_bounds

MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
FEATURES = 2_048
LEAST_GAIN = 12.0
OPENINGS = (4, 5, 6, 7)    # bytes of word openings
STEPS, STEP_SIZE, DECAY = 400, 0.05, 1e-4
_PLAIN = np.ones(256, dtype=bool)      # separators: ASCII that is neither letter nor digit
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the words and of their openings, and log2(1 + count) of each."""
    data = plain_bytes(text)
    starts, ends = word_bounds(data, _PLAIN)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    parts = [hash_words(data, starts, ends)]
    for i, n in enumerate(OPENINGS):
        long = ends - starts > n
        parts.append(hash_words(data, starts[long], starts[long] + n) ^ np.uint64(i + 1))
    keys, times = np.unique(np.concatenate(parts), return_counts=True)
    return keys, np.log2(1.0 + times)


def known_features(text: str | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``keys`` and values of the text's features that are there."""
    mine, value = features(text)
    at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
    same = keys[at] == mine if len(keys) else np.zeros(len(mine), dtype=bool)
    return at[same], value[same]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        if len(self.keys) == 0:
            return float(1 / (1 + np.exp(-self.intercept)))
        at, value = known_features(text, self.keys)
        z = self.intercept + self.weights[at] @ value
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for y, t in zip(b["y"], b["text"]):
            f, _ = features(t)
            yield pd.DataFrame({"y": np.full(len(f), y, dtype=np.int32), "feature": f.view(np.int64)})


def _chosen(keys: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [known_features(t, keys) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"].to_numpy(), "at": [a.tolist() for a, _ in got], "value": [v.tolist() for _, v in got]})

    return run


def non_negative_fit(x: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept: full gradient steps (Adam) on the non-negative risk with the logistic loss."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)
    vals = np.concatenate(values).astype(np.float64) if len(rows) else np.zeros(0)
    pos, unl = y == 1, y == 0
    share_p, share_u = np.where(pos, 1 / max(pos.sum(), 1), 0.0), np.where(unl, 1 / max(unl.sum(), 1), 0.0)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        z = b + np.bincount(rows, weights=w[cols] * vals, minlength=len(x))
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss_negative = np.logaddexp(0, z)
        rest = (share_u * loss_negative).sum() - prior * (share_p * loss_negative).sum()
        negative = (share_u - prior * share_p) * p                    # gradient of the negative part by z
        g = prior * share_p * (p - 1) + negative if rest >= 0 else -negative
        grad = np.append(np.bincount(cols, weights=g[rows] * vals, minlength=size) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = STEP_SIZE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0) -> Model:
    """Fit without the held-out fold. The class prior is the share of label 1 among usable labels."""
    known = labelled(labels, label, folds, held)
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    if not total.p:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -50.0)
    prior = float(np.clip(total.p / total.n, 1e-3, 0.5))
    positive = bounded(known.where("y = 1"), MOST_POSITIVE).select("doc_id", F.lit(1).alias("y"))
    free = docs.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held)).select("doc_id")
    unlabelled = bounded(free, MOST_UNLABELLED).select("doc_id", F.lit(0).alias("y"))
    # A confirmed document may also be drawn as unlabelled text: that is what the prior corrects.
    chosen = positive.unionByName(unlabelled.distinct())
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")
    counted = sample.transform(mapped, _rows, "y int, feature bigint").groupBy("feature").agg(
        F.sum("y").alias("p"), F.sum(F.expr("1 - y")).alias("u"))
    n_p, n_u = positive.count(), max(unlabelled.count(), 1)
    # Log-likelihood gain of a feature that is commoner among the positives: chance seldom reaches LEAST_GAIN.
    gain = F.expr(f"p * ln(p * {n_p + n_u}D / ({n_p}D * (p + u)))")
    keys = np.sort(np.array([r.feature for r in counted.where("p >= 3").withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
                             .orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()], dtype=np.int64).view(np.uint64))
    got = sample.transform(mapped, _chosen(keys), "y int, at array<int>, value array<double>").collect()
    got = sorted((r.y, r["at"], r.value) for r in got)
    w, b = non_negative_fit([np.array(r[1], dtype=np.int64) for r in got], [np.array(r[2]) for r in got], np.array([r[0] for r in got]), len(keys), prior)
    return Model(keys, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [model.score(t) for t in b["text"]]})

    return docs.select("doc_id", "text").transform(mapped, run, f"doc_id {key}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
