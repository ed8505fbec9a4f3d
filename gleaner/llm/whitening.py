"""Embedding whitening: principal components to double precision, and the vectors projected on them.

1. *Integers.* Entries become ``floor(256 * c)``; the fit list holds each distinct integer vector once.
2. *Covariance.* Two passes over the fit list: count and sums per dimension in whole numbers, then
   products of centred rows, one matrix a task, added up by row of the matrix.
3. *Mixed-precision refinement.* The matrix of dims x dims is all that reaches the driver. Its
   eigenvectors in float32 are corrected by Ogita-Aishima iterations, which consist of matrix products
   in a higher precision (``numpy.longdouble``, at least double) and double the right digits each time.
   Eigenvalues too close for the current precision form clusters; their subspace is corrected as a
   whole and split by a small eigenproblem of its own, shifted by the cluster's middle.
4. *Projection.* Every vector is centred and projected where it lies, without a shuffle.

The driver and each task hold ``dims`` squared numbers, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are dropped, as are
those whose length isn't the most frequent one (ties: the longest); repeated rows and keys are each
projected but fitted once; components whose eigenvalue is below ``RANK`` of the greatest have no
direction and are left out, so one single vector gives no rows, and an empty table gives an empty
one. ``deviation`` is null where it exceeds 64 bits. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

SCALE = 256.0
RANK = 2.0 ** -40          # eigenvalues below this share of the greatest are rounding
ROUNDS = 30                # of refinement; three to five are usual
BLOCK = 1024               # rows multiplied at once
_HIGH = np.longdouble
CLOSE = 1024 * float(np.finfo(_HIGH).eps)     # values closer than this share of the greatest are one
_HALF = 1 << 31            # whole numbers are summed in two parts, so that no sum overflows


def integers(column: str) -> Column:
    return F.transform(column, lambda c: F.floor(F.lit(SCALE) * c.cast("double")))


def finite(column: str) -> Column:
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """((vec_id, x) of the rows that remain, their length)."""
    rows = vectors.select("vec_id", "embedding").where(finite("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    return rows.where(F.size("embedding") == dims).select("vec_id", integers("embedding").alias("x")), dims


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows of the fit list, exact sums per dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for b in batches:
            x = _matrix(b, dims)
            n += len(x)
            high += (x // _HALF).sum(axis=0)
            low += (x % _HALF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()),
                                              "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    parts = fit.mapInArrow(run, "i int, n bigint, high bigint, low bigint").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    rows = sorted(parts.collect(), key=lambda r: r["i"])
    return (rows[0]["n"], [int(r["high"]) * _HALF + int(r["low"]) for r in rows]) if rows else (0, [0] * dims)


def mean_of(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The means as whole numbers and the rest below one, so that centring loses nothing of large entries."""
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest


def covariance(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Sum of the products of centred rows over ``n``; the tasks' parts are added without rounding between."""
    whole, rest = mean_of(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((dims, dims), dtype=_HIGH), False
        for b in batches:
            z = centred(_matrix(b, dims), whole, rest)
            for at in range(0, len(z), BLOCK):
                part = z[at:at + BLOCK]
                total += part.T @ part
                some = True
        if some:
            for i in range(dims):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "v": pa.array([total[i].astype(np.float64)], pa.list_(pa.float64()))})

    def add(parts: pa.Table) -> pa.Table:
        rows = parts.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        out = [math.fsum(rows[:, j].tolist()) for j in range(dims)]
        return pa.table({"i": parts.column("i").slice(0, 1), "v": pa.array([out], pa.list_(pa.float64()))})

    rows = fit.mapInArrow(run, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>").collect()
    v = np.zeros((dims, dims))
    for r in rows:
        v[r["i"]] = np.array(r["v"]) / n
    return (v + v.T) / 2


def _runs(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Positions of ascending values in runs whose neighbours are at most ``width`` apart."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > width) + 1)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """One step from nearly to more nearly orthonormal columns."""
    return x @ (np.eye(x.shape[1], dtype=_HIGH) * _HIGH(1.5) - (x.T @ x) / 2)


def _split(a: np.ndarray, x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The columns ``run`` of ``x`` turned into eigenvectors within the subspace that they span."""
    part = _orthonormal(x[:, run])
    small = part.T @ (a @ part)
    middle = np.trace(small) / len(run)
    small = small - middle * np.eye(len(run), dtype=_HIGH)
    scale = np.abs(small).max()
    if scale == 0:
        return part
    turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))[1]
    return part @ turn.astype(_HIGH)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: (values, better vectors, size of the correction)."""
    eye = np.eye(len(a), dtype=_HIGH)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2      # else their rounding, over a small gap, would turn columns against each other
    values = np.diag(s) / (1 - np.diag(r))
    norm = np.sqrt((a * a).sum())
    width = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r * r).sum())) + norm * CLOSE
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > width
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    return values, x + x @ e, float(np.abs(e).max())


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling, of a symmetric matrix.

    From float32 eigenvectors; each round is a refinement, then a sub-solve in every cluster that the
    round could not tell apart. It ends when corrections stay below the precision or no longer shrink.
    """
    scale = float(np.abs(a).max()) if a.size else 0.0
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    high = (a / scale).astype(_HIGH)
    _, first = np.linalg.eigh((a / scale).astype(np.float32))
    x = first.astype(_HIGH)
    tiny, before = float(np.finfo(_HIGH).eps), math.inf
    for turn in range(ROUNDS):
        values, x, size = refine(high, x)
        order = np.argsort(values, kind="stable")
        values, x = values[order], x[:, order]
        residual = np.sqrt(((high @ x - x * values[None, :]) ** 2).sum())
        for run in _runs(values, float(2 * residual) + CLOSE):
            if len(run) > 1:
                x[:, run] = _split(high, x, run)
        if size < 64 * tiny or turn > 4 and size > before / 2:
            break
        before = size
    for _ in range(2):
        x = _orthonormal(x)
    values = np.diag(x.T @ (high @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))[None, :]
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, in whole numbers."""
    most = max(n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0), 1)
    if most * most * max(len(sums), 1) < 1 << 63:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [f if f < 1 << 63 else None for f in found]


def project(rows: DataFrame, dims: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> DataFrame:
    """One row for each row and component: (vec_id, component, n, deviation, whitened, explained)."""
    key = rows.schema["vec_id"].dataType.simpleString()
    whole, rest = mean_of(n, sums)
    turned, k = vectors / np.sqrt(values)[None, :], len(values)
    explained = (values / trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _matrix(part, dims)
                white = centred(x, whole, rest) @ turned
                m = len(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array([n] * (m * k), pa.int64()),
                    "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(explained * m),
                })

    return rows.mapInArrow(run, f"vec_id {key}, component int, n bigint, deviation bigint, whitened double, explained double")


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``k`` whitened columns minus the identity."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """For every usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    key = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {key}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], schema)
    rows, dims = usable(vectors)
    if dims == 0:
        return nothing
    fit = cut_lineage(rows.select("x").distinct(), "whitening-fit")
    n, sums = totals(fit, dims)
    v = covariance(fit, dims, n, sums)
    values, turned = eigen(v)
    k = min(components, int((values > RANK * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if k == 0:
        return nothing
    values, turned, trace = values[:k], turned[:, :k], float(np.trace(v))
    whole, rest = mean_of(n, sums)
    matrix = turned / np.sqrt(values)[None, :]

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = centred(_matrix(b, dims), whole, rest) @ matrix
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))], ["w"])

    error = identity_error(fit.mapInArrow(white, "w array<double>"), k)
    return project(rows, dims, n, sums, values, turned, trace).withColumn("identity_error", F.lit(error))
