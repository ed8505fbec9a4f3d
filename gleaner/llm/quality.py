"""Quality by a sparse rule ensemble.

Shallow boosted trees are grown over statistics of the texts; every path from a root to a node is
a conjunctive rule; a lasso logistic regression keeps few of them; the kept rules become one
Spark column expression over the statistics, so scoring is a plain projection.

Only the fit uses a sample: at most ``most`` labelled rows (``TRAIN_ROWS``), spread by hash. Statistics
and scores are computed for whole texts of all rows.

Defined cases: null and empty texts have zero statistics and get a score like any other;
contradicting labels of a doc_id are ignored; without usable labels of both kinds the score is the
share of label 1 (0.5 without any); repeated rows are scored one by one; columns of the input that
are named like a statistic do not disturb it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.folds import bounded, in_fold, labelled
from gleaner.llm.rows import mapped
from gleaner.llm.words import hash_words, plain_bytes, word_bounds

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 20
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "marks", "exclaims", "bars", "symbols", "full_stops", "non_ascii",
    "distinct", "repeats", "commonest", "short_words", "long_words", "line_words", "distinct_lines", "marked_words")

_CLASS = np.zeros((256, 7))
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!\"'(),-./:;?[]{}", "!", "|", "#$%&*+<=>@\\^_`~", ".")):
    for _c in _chars:
        _CLASS[ord(_c), _i] = 1
_HIGH = np.arange(256) >= 0x80
_LEAD = (np.arange(256) & 0xC0) != 0x80


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    data = plain_bytes(text, lower=False)
    if not data:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars = float(counts[_LEAD].sum())
    kinds = counts @ _CLASS / chars
    starts, ends = word_bounds(data)
    n = len(starts)
    if n == 0:
        return (np.log1p(chars), 0.0, 0.0, *kinds, float((counts * (_HIGH & _LEAD)).sum() / chars), *(0.0,) * (len(STATISTICS) - 11))
    size = ends - starts
    words = hash_words(data, starts, ends)
    _, times = np.unique(words, return_counts=True)
    units = np.frombuffer(data, dtype=np.uint8)
    last = units[ends - 1]
    marked = ~(((last >= 0x30) & (last <= 0x39)) | ((last >= 0x41) & (last <= 0x5A)) | ((last >= 0x61) & (last <= 0x7A)) | (last >= 0x80))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (np.log1p(chars), np.log1p(n), float(size.mean()), *kinds, float((counts * (_HIGH & _LEAD)).sum() / chars),
            len(times) / n, float((words[1:] == words[:-1]).sum() / n), float(times.max() / n), float((size <= 2).sum() / n), float((size >= 12).sum() / n),
            np.log1p(n / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), float(marked.sum() / n))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns of all rows and a struct ``stats`` of their texts' statistics."""
    fields = ", ".join(f"{s} double" for s in STATISTICS)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.array([statistics(t) for t in b["_text"]], dtype=np.float64).reshape(-1, len(STATISTICS))
            out = b[list(keep)].reset_index(drop=True)
            out["stats"] = pd.DataFrame(rows, columns=list(STATISTICS)).to_dict("records")
            yield out

    return docs.select(*keep, F.col("text").alias("_text")).transform(mapped, run, f"{kept}, stats struct<{fields}>")


@dataclass(frozen=True)
class Rule:
    """All of ``parts`` hold; a part is (statistic, above, threshold): > if above, else <=."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, above, cut in self.parts:
            out &= (x[:, i] > cut) if above else (x[:, i] <= cut)
        return out

    def column(self, stats: Column) -> Column:
        cond = F.lit(True)
        for i, above, cut in self.parts:
            value = stats.getField(STATISTICS[i])
            cond = cond & ((value > F.lit(float(cut))) if above else (value <= F.lit(float(cut))))
        return cond


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, out: np.ndarray) -> list[tuple]:
    """One tree on gradients: fills ``out`` with leaf values, returns the paths to its nodes."""
    paths: list[tuple] = []
    todo = [(np.arange(len(grad)), ())]
    while todo:
        rows, path = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if len(path) < depth and len(rows) >= 2 * LEAF:
            for f in range(bins.shape[1]):
                if len(cuts[f]) == 0:
                    continue
                n = len(cuts[f]) + 1
                b = bins[rows, f]
                cg, ch, cn = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (grad[rows], hess[rows], None))
                gain = cg ** 2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g ** 2 / (h + 1)
                gain[(cn < LEAF) | (len(rows) - cn < LEAF)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            out[rows] = -g / (h + 1)
            continue
        _, f, k = best
        right = bins[rows, f] > k
        for above, part in ((False, rows[~right]), (True, rows[right])):
            longer = (*path, (f, above, float(cuts[f][k])))
            paths.append(longer)
            todo.append((part, longer))
    return paths


def _merged(path: tuple) -> Rule:
    """Several bounds of one statistic on the same side are one."""
    parts: dict[tuple[int, bool], float] = {}
    for f, above, cut in path:
        old = parts.get((f, above))
        parts[f, above] = cut if old is None else max(old, cut) if above else min(old, cut)
    return Rule(tuple((f, above, cut) for (f, above), cut in sorted(parts.items())))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, p = x.shape
    step = 4.0 / (1.0 + np.linalg.norm(x, 2) ** 2 / n)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    b, w = float(np.log(mean / (1 - mean))), np.zeros(p)
    bz, z, t = b, w.copy(), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(bz + x @ z))) - y
        nb = bz - step * r.mean()
        nw = z - step * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bz, z = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = 5e-4) -> RuleModel:
    """Trees, their paths as rules, lasso weights."""
    y = y.astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return RuleModel(float(np.log(mean / (1 - mean))), ())
    cuts, bins = [], np.zeros(x.shape, dtype=np.int64)
    for f in range(x.shape[1]):
        c = np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower"))
        c = np.unique(np.concatenate((c, np.quantile(x[:, f], [0.002, 0.01, 0.99, 0.998], method="lower"))))
        cuts.append(c := c[c < x[:, f].max()])
        bins[:, f] = np.searchsorted(c, x[:, f], side="left")
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, np.ndarray] = {}
    value = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for path in _grow(bins, cuts, p - y, p * (1 - p), depth, value):
            rule = _merged(path)
            if rule not in rules:
                rules[rule] = rule.holds(x)
        margin += RATE * value
    seen: dict[bytes, Rule] = {}
    for rule, held in rules.items():           # of rules that hold for the same rows, the shortest
        key = np.packbits(held).tobytes()
        if 0 < held.sum() < len(y) and (key not in seen or len(rule.parts) < len(seen[key].parts)):
            seen[key] = rule
    chosen = sorted(seen.values(), key=lambda r: (len(r.parts), r.parts))
    if not chosen:
        return fit_rules(np.zeros((0, x.shape[1])), y[:0])
    m = np.stack([rules[r] for r in chosen], axis=1).astype(np.float64)
    b, w = _lasso(m, y, penalty)
    return RuleModel(b, tuple((r, float(v)) for r, v in zip(chosen, w) if abs(v) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, most: int = TRAIN_ROWS) -> RuleModel:
    """Fit on at most ``most`` labelled rows outside the held-out fold (two small numbers a row reach the driver)."""
    rows = bounded(labelled(labels, label, folds, held), most)
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    got = with_statistics(sample, "doc_id", "y").select("doc_id", "y", "stats.*").toPandas()
    # Repeated documents of one doc_id: the order of rows must not matter.
    got = got.sort_values(["doc_id", *STATISTICS]).drop_duplicates("doc_id")
    return fit_rules(got[list(STATISTICS)].to_numpy(dtype=np.float64), got["y"].to_numpy())


def score(docs: DataFrame, model: RuleModel, *keep: str) -> DataFrame:
    """The ``keep`` columns of all rows and their ``score`` (0 to 1, higher: label 1 likelier)."""
    return with_statistics(docs, *keep).select(*keep, model.score(F.col("stats")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all columns as they were."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    model = train(docs, labels)
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text"))
    scored = score(plain, model, *names.values())
    return scored.where("score >= 0.5").select(*[F.col(n).alias(c) for c, n in names.items()])


def crc_fold(key: object, folds: int) -> int:
    """The fold of a key, for tests and local use."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds
