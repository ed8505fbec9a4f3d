"""Exact nearest-vector search over a cell-partitioned index.

* *Cells.* Centroids are fitted to a bounded sample; every vector lies in the cell of its nearest
  centroid, at a known angle. A cell is stored in parts of at most about ``PART_ROWS`` rows, so a dense
  cell, or a vector that a third of all rows share, is many parts. Per part its rows and its least
  and greatest angle are kept: a table whose size depends on the parts alone.
* *Bound.* Angles obey the triangle inequality: no vector of a part is nearer to a probe at angle
  ``a`` from the centroid than ``max(low - a, a - high, 0)``.
* *Search.* A probe meets the part that its bound puts first, which gives a score that its k-th best
  must reach; then only the parts whose bound reaches that score. Parts no probe needs are not read.
* *Bundles.* Parts travel in bundles of bounded size and probes in blocks, so a probe is sent once a
  bundle, with one bit for each of its parts, and a bundle once a block.
* *Scores.* Products in single precision, whose error is bounded, leave out what can't reach the floor
  or the k best; the others are computed in double precision.

The centroids are few and sent to tasks; probes and vectors never pass the driver. Vectors that are
null, hold null or non-finite entries or have no length score 0, as do vectors of unequal lengths: each
length has its own cells, and for the others the bound is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleaner.dims import small_table
from gleaner.session import cut_lineage, scratch_path

CELL_ROWS = 4096        # rows a cell should hold ...
MAX_CELLS = 4096        # ... as long as there are no more cells than this
PART_ROWS = 16384       # rows of a part at most, by hash
BUNDLE_VALUES = 1 << 22 # vector entries that the parts of a bundle hold together ...
BUNDLE_PARTS = 62       # ... and parts, a bit each
PROBE_BLOCK = 32768     # probes that meet a bundle at once
STRIPE = 512            # of these in one matrix product
PRODUCTS = 1 << 23      # scores held at once
EXACT = 1 << 16         # pairs computed in double precision at once
SAMPLE_PER_CELL = 16    # rows a centroid is fitted to ...
MAX_SAMPLE = 16384      # ... as long as they are no more than this
ROUNDS = 4
MAX_TASKS = 4096        # tasks that bundles and blocks are dealt to
DIGITS = 10             # scores closer than this are ties, broken by id
SLACK = 1e-9            # angles and scores are rounded


def flat(vector: Column) -> Column:
    """Whether a vector has no direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce((F.size(vector) <= 0) | bad | (length < 1e-12), F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of lists of one length."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(array) == 0:
        return np.zeros((0, 0))
    m = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def cosines(a: Iterable, b: Iterable) -> np.ndarray:
    """Rounded cosines of any vectors, 0 where lengths differ or one has no direction."""
    def units(vectors: Iterable) -> tuple[np.ndarray, list[np.ndarray]]:
        rows = [np.asarray([] if v is None else v, dtype=np.float64) for v in vectors]
        sound = [len(r) if len(r) and np.isfinite(r).all() and np.linalg.norm(r) >= 1e-12 else 0 for r in rows]
        return np.array(sound, dtype=np.int64), [r / np.linalg.norm(r) if n else r for r, n in zip(rows, sound)]

    (na, xa), (nb, xb) = units(a), units(b)
    out = np.zeros((len(na), len(nb)))
    for d in np.unique(na[na > 0]).tolist():
        i, j = np.flatnonzero(na == d), np.flatnonzero(nb == d)
        if len(j):
            out[np.ix_(i, j)] = np.round(np.stack([xa[k] for k in i]) @ np.stack([xb[k] for k in j]).T, DIGITS)
    return out


def _angles(score: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(score, -1.0, 1.0))


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids after a few rounds of spherical k-means; rows drawn at random are the start."""
    c = np.unique(sample, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:cells]]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-9, total / np.where(size > 1e-9, size, 1.0)[:, None], c)
    return c


@dataclass
class Cells:
    """Stored rows (``dims``, ``cell``, ``part`` beside their own columns) and what tasks know of them."""

    rows: DataFrame
    centroids: dict[int, np.ndarray]                     # by length; cells are numbered through
    first: dict[int, int] = field(default_factory=dict)  # the first cell of a length
    parts: np.ndarray | None = None                      # number, length, cell, rows, low, high, bundle, bit: ascending by number

    def bounds(self, dims: int, probes: np.ndarray) -> np.ndarray:
        """(probes, parts): the greatest score that a part may hold."""
        p = self.parts
        out = np.zeros((len(probes), len(p)))
        mine = np.flatnonzero((p["dims"] == dims) & (p["cell"] >= 0))
        if len(mine) and len(probes) and dims in self.centroids:
            a = _angles(probes @ self.centroids[dims].T)[:, p["cell"][mine] - self.first[dims]]
            gap = np.maximum(np.maximum(p["low"][mine] - a, a - p["high"][mine]), 0.0)
            out[:, mine] = np.cos(np.minimum(gap, math.pi))
        return out


_PART = np.dtype([("part", np.int64), ("dims", np.int64), ("cell", np.int64), ("rows", np.int64), ("low", np.float64), ("high", np.float64),
                  ("bundle", np.int64), ("bit", np.int64)])


def bundled(parts: list[tuple]) -> list[tuple]:
    """Parts with the number of their bundle and their place in it. A bundle's vectors share a length."""
    out, bundle, bit, held, last = [], -1, 0, 0, None
    for part in parts:
        dims, values = part[1], part[3] * max(part[1], 64)
        if dims != last or bit == BUNDLE_PARTS or held + values > BUNDLE_VALUES:
            bundle, bit, held, last = bundle + 1, 0, 0, dims
        out.append((*part, bundle, bit))
        bit, held = bit + 1, held + values
    return out


def build(rows: DataFrame, key: str, name: str, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS) -> Cells:
    """An index of ``rows``, which carry ``vector``; written below the shared folder."""
    # What the rows are made of (joins, rules) runs once; counting, sampling and placing read the result.
    rows = cut_lineage(rows.withColumn("dims", F.when(flat(F.col("vector")), 0).otherwise(F.size("vector"))), f"{name}-rows")
    sizes = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}
    centroids, first, at = {}, {}, 0
    pieces: dict[int, int] = {-1: max(1, math.ceil(sizes.get(0, 0) / part_rows))}
    for dims in sorted(d for d in sizes if d > 0):
        cells = max(1, min(MAX_CELLS, round(sizes[dims] / cell_rows)))
        # Keys, not vectors, decide by hash what is sampled, so a vector that many rows share counts as often.
        most = 1 if cells == 1 else min(cells * SAMPLE_PER_CELL, MAX_SAMPLE)
        sample = matrix(rows.where(F.col("dims") == dims).select(key, "vector").orderBy(F.xxhash64(key), key).limit(most).toArrow().column("vector"))
        centroids[dims] = fit_centroids(sample, cells)
        first[dims], at = at, at + len(centroids[dims])
        share = np.bincount(np.argmax(sample @ centroids[dims].T, axis=1), minlength=len(centroids[dims])) / len(sample)
        pieces.update({first[dims] + i: max(1, math.ceil(f * sizes[dims] / part_rows)) for i, f in enumerate(share.tolist())})
    shared = rows.sparkSession.sparkContext.broadcast((centroids, first, pieces))
    schema = StructType([*rows.schema.fields]).add("pieces", "integer").add("cell", "integer").add("angle", "double")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, split = shared.value
        for b in batches:
            length = b.column("dims").to_numpy(zero_copy_only=False)
            cell, angle = np.full(b.num_rows, -1, dtype=np.int32), np.zeros(b.num_rows)
            for d in np.unique(length[length > 0]).tolist():
                mine = np.flatnonzero(length == d)
                x = matrix(b.column("vector").take(pa.array(mine)))
                for s in range(0, len(mine), STRIPE):
                    score = x[s:s + STRIPE] @ known[d].T
                    best = np.argmax(score, axis=1)
                    cell[mine[s:s + STRIPE]] = best + start[d]
                    angle[mine[s:s + STRIPE]] = _angles(score[np.arange(len(best)), best])
            many = pa.array([split[c] for c in cell.tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, many, pa.array(cell), pa.array(angle)], [*b.schema.names, "pieces", "cell", "angle"])

    number = (F.col("cell") + 1).cast("bigint") * (1 << 32) + F.pmod(F.xxhash64(key), F.col("pieces"))
    placed = rows.mapInArrow(assign, schema).withColumn("part", number).drop("pieces")
    folder = scratch_path(rows.sparkSession, f"{name}-cells")
    placed.repartition("cell", "part").write.partitionBy("cell").parquet(folder)
    stored = rows.sparkSession.read.schema(placed.schema).parquet(folder)
    stats = stored.groupBy("part", "dims", "cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    table = np.array(bundled(sorted((tuple(r) for r in stats.collect()), key=lambda r: (r[1], r[0]))), dtype=_PART)
    table.sort(order="part")
    return Cells(stored.drop("angle"), centroids, first, table)


def needed(index: Cells, probes: DataFrame, home: bool | None) -> DataFrame:
    """(bundle, mask, the probe's columns): the bits of the part where a probe starts (``home``), of all others
    that may hold a row not worse than ``floor`` (not ``home``), or of all of them (None)."""
    shared = probes.sparkSession.sparkContext.broadcast(Cells(None, index.centroids, index.first, index.parts))
    schema = StructType([*probes.schema.fields]).add("bundle", "long").add("mask", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        bundle, bit = known.parts["bundle"], np.int64(1) << known.parts["bit"]
        order = np.argsort(bundle, kind="stable")
        begin = np.flatnonzero(np.diff(bundle[order], prepend=-1))
        for b in batches:
            length = b.column("dims").to_numpy(zero_copy_only=False)
            for d in np.unique(length).tolist():
                mine = np.flatnonzero(length == d)
                for s in range(0, len(mine), STRIPE):
                    some = b.take(pa.array(mine[s:s + STRIPE]))
                    x = matrix(some.column("vector")) if d > 0 else np.zeros((some.num_rows, 0))
                    bound = known.bounds(d, x)
                    start = np.argmax(bound, axis=1)
                    if home:
                        row, to, mask = np.arange(len(start)), bundle[start], bit[start]
                    else:
                        floor = some.column("floor").to_numpy(zero_copy_only=False)
                        wanted = bound + SLACK >= floor[:, None]
                        if home is not None:
                            wanted[np.arange(len(start)), start] = False
                        bits = np.bitwise_or.reduceat(np.where(wanted, bit[None, :], 0)[:, order], begin, axis=1)
                        row, at = np.nonzero(bits)
                        to, mask = bundle[order][begin][at], bits[row, at]
                    out = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to), pa.array(mask)], [*b.schema.names, "bundle", "mask"])

    return probes.mapInArrow(run, schema)


def below(x: np.ndarray) -> np.ndarray:
    """Single precision, not above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def close(probes: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(probe, row, rounded cosine) of unit vectors, not below the probe's floor; with ``k`` those that may
    be among the probe's ``k`` best.

    A score in single precision is off by ``error`` at most, so what lies further below the floor,
    or twice as far below the ``k``-th score, is left out before scores are computed exactly.
    """
    error = (rows.shape[1] + 8) * 2.0 ** -23 + SLACK
    fast, step = rows.astype(np.float32), max(32, min(STRIPE, PRODUCTS // max(1, len(rows))))
    for s in range(0, len(probes), step):
        p, least = probes[s:s + step], floor[s:s + step] - error
        score = p.astype(np.float32) @ fast.T
        hit = score >= below(least)[:, None]
        n = np.count_nonzero(hit)
        if k is not None and len(rows) > k and n > 2 * k * len(p):
            if n > hit.size // 8:
                kth = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
            else:
                i, j = np.nonzero(hit)
                value = score[i, j]
                value = value[np.lexsort((-value, i))]
                count = np.bincount(i, minlength=len(p))
                at = np.cumsum(count) - count + k - 1
                kth = np.where(count >= k, value[np.minimum(at, len(value) - 1)], -np.inf)
            least = np.maximum(least, kth.astype(np.float64) - 2 * error)
            hit = score >= below(least)[:, None]
            n = np.count_nonzero(hit)
        i, j = np.nonzero(hit)
        if n > hit.size // 16:
            value = (p @ rows.T)[i, j]
        else:
            value = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", p[i[c:c + EXACT]], rows[j[c:c + EXACT]]) for c in range(0, n, EXACT))])
        value = np.round(value, DIGITS)
        ok = value >= floor[s:s + step][i] - SLACK
        yield i[ok] + s, j[ok], value[ok]


def by_parts(probes: np.ndarray, rows: np.ndarray, mask: np.ndarray, bit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some probes and rows, as groups in which each probe needs each row's part: by equal masks, or, if those are many, by part."""
    here = np.unique(bit[rows])
    wanted = mask[probes] & (np.bitwise_or.reduce(here) if len(here) else 0)
    kinds = np.unique(wanted)
    if len(kinds) <= len(here):
        for m in kinds[kinds != 0].tolist():
            yield probes[wanted == m], rows[(bit[rows] & m) != 0]
    else:
        for m in here.tolist():
            yield probes[(wanted & m) != 0], rows[bit[rows] == m]


def kinds(x: np.ndarray) -> np.ndarray | None:
    """Equal numbers for equal rows; None if all differ."""
    _, kind, count = np.unique(x[:, 0], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[kind] > 1)                     # only these may be equal
    if not len(again):
        return None
    whole = np.ascontiguousarray(x[again]).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    kind[again] = len(x) + np.unique(whole, return_inverse=True)[1]
    return kind


def first_of_equals(rows: np.ndarray, kind: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """``rows`` without those that ``k`` of their kind precede, which score the same: no more can be among ``k`` best."""
    sort = np.lexsort((order[rows], kind[rows]))
    new = np.flatnonzero(np.diff(kind[rows][sort], prepend=-1))
    rank = np.arange(len(sort)) - np.repeat(new, np.diff(np.append(new, len(sort))))
    return np.sort(rows[sort[rank < k]])


def best_of(rows: pa.Table, probes: pa.Table, k: int, key: str, probe_key: str, carry: list[str]) -> pa.Table:
    """The ``k`` best rows of one part for each of some probes, floors and visibility applied."""
    ids, seen_by = rows.column(key).combine_chunks(), rows.column("seen_by").combine_chunks()
    _, order = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    dims = rows.column("dims")[0].as_py()
    x = matrix(rows.column("vector")) if dims > 0 else None
    profiles, profile = np.unique(probes.column("profile").to_numpy(), return_inverse=True)
    seen = np.zeros((rows.num_rows, len(profiles)), dtype=bool)
    seen[seen_by.is_null().to_numpy(zero_copy_only=False)] = True
    who, value = pc.list_parent_indices(seen_by).to_numpy(), seen_by.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(profiles, value), max(len(profiles) - 1, 0))
    ok = profiles[at] == value
    seen[who[ok], at[ok]] = True
    length, floor, mask = (probes.column(c).to_numpy() for c in ("dims", "floor", "mask"))
    bit = np.int64(1) << rows.column("bit").to_numpy()
    units = np.full(probes.num_rows, -1)                        # where a probe's unit vector is
    units[length == dims] = np.arange(np.count_nonzero(length == dims))
    p = matrix(probes.column("vector").filter(pa.array(length == dims))) if dims > 0 else None
    kind = kinds(x) if dims > 0 else None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(asked: np.ndarray, at: np.ndarray) -> None:
        sharp = asked[units[asked] >= 0] if dims > 0 else asked[:0]
        if len(sharp) and len(at):
            at = at if kind is None else first_of_equals(at, kind, order, k)
            for i, j, value in close(p[units[sharp]], x[at], floor[sharp], k):
                found.append((sharp[i], at[j], value))
        # The others score 0 everywhere, so the first rows do.
        blunt = asked[(units[asked] < 0) | (dims <= 0)]
        blunt = blunt[floor[blunt] - SLACK <= 0]
        first = at[np.argsort(order[at], kind="stable")[:k]]
        found.append((np.repeat(blunt, len(first)), np.tile(first, len(blunt)), np.zeros(len(blunt) * len(first))))

    for number in range(len(profiles)):
        for asked, at in by_parts(np.flatnonzero(profile == number), np.flatnonzero(seen[:, number]), mask, bit):
            look(asked, at)
    c, r, value = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    sort = np.lexsort((order[r], -value, c))
    r, c, value = r[sort], c[sort], value[sort]
    new = np.flatnonzero(np.diff(c, prepend=-1))
    rank = np.arange(len(c)) - np.repeat(new, np.diff(np.append(new, len(c))))
    r, c, value = r[rank < k], c[rank < k], value[rank < k]
    picked = rows.select([key, *carry]).take(pa.array(r))
    return pa.table([probes.column(probe_key).take(pa.array(c)), *picked.columns, pa.array(value)], [probe_key, key, *carry, "score"])


def meet(index: Cells, pairs: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, columns: list[str], probe_key: str,
         blocks: int, pruned: bool) -> DataFrame:
    """Rows of ``kernel(rows of a bundle, probes that need it)``, in blocks of probes of bounded size."""
    rows, parts = index.rows, index.parts
    if pruned:
        # Numbers of cells, of which there are few: the folders of the others are not read.
        met = {r["bundle"]: r["mask"] for r in pairs.groupBy("bundle").agg(F.bit_or("mask").alias("mask")).collect()}
        rows = rows.where(F.col("cell").isin(sorted({p["cell"].item() for p in parts if met.get(p["bundle"].item(), 0) >> p["bit"].item() & 1})))
    places = small_table(rows.sparkSession, [(p["part"].item(), p["bundle"].item(), p["bit"].item()) for p in parts], "part bigint, bundle bigint, bit bigint")
    rows = rows.select("part", "dims", "vector", *columns).join(places, "part").drop("part")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")) if blocks > 1 else F.lit(0).cast("bigint"))
    pairs = pairs.withColumn("_block", F.pmod(F.xxhash64(probe_key), F.lit(blocks)))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # Tiles are few and heavy: each has a task of its own, as far as hashes allow.
    tasks = min(2 * blocks * bundles_of(index), MAX_TASKS)
    rows, pairs = (side.repartition(tasks, "bundle", "_block") for side in (rows, pairs))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return kernel(left, right) if left.num_rows and right.num_rows else arrow.empty_table()

    return rows.groupBy("bundle", "_block").cogroup(pairs.groupBy("bundle", "_block")).applyInArrow(cell, schema)


def bundles_of(index: Cells) -> int:
    return len(np.unique(index.parts["bundle"]))


def _best(index: Cells, pairs: DataFrame, k: int, key: str, probe_key: str, carry: list[str], blocks: int, pruned: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in index.rows.schema.fields}
    schema = ", ".join([f"{probe_key} {pairs.schema[probe_key].dataType.simpleString()}", *[f"{c} {kinds[c]}" for c in (key, *carry)], "score double"])
    return meet(index, pairs, lambda rows, probes: best_of(rows, probes, k, key, probe_key, carry), schema, ["seen_by", key, *carry], probe_key, blocks, pruned)


def scores(rows: pa.Table, vectors: str, against: pa.Table, others: str) -> np.ndarray:
    """Rounded cosines, 0 where lengths differ or a vector has no direction. Both carry ``dims`` of the
    vectors in question; a part's rows share theirs."""
    dims = against.column("dims")[0].as_py()
    out = np.zeros((rows.num_rows, against.num_rows))
    same = np.flatnonzero(rows.column("dims").to_numpy() == dims) if dims > 0 else np.zeros(0, dtype=np.int64)
    if len(same):
        out[same] = np.round(matrix(rows.column(vectors).take(pa.array(same))) @ matrix(against.column(others)).T, DIGITS)
    return out


def _ready(probes: DataFrame, probe_key: str, lowest: float) -> DataFrame:
    return probes.select(probe_key, "vector", F.col("profile").cast("bigint").alias("profile"),
                         F.when(flat(F.col("vector")), 0).otherwise(F.size("vector")).alias("dims"), F.lit(lowest).alias("floor"))


def blocks_of(probes: DataFrame, index: Cells, probe_block: int) -> int:
    """Blocks of probes: bounded ones, and enough that all cores work where there are few bundles."""
    n, cores = probes.count(), probes.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / probe_block), min(3 * cores // max(bundles_of(index), 1), n // STRIPE))


def nearest(index: Cells, probes: DataFrame, k: int, key: str, probe_key: str, carry: list[str], min_score: float | None = None,
            probe_block: int = PROBE_BLOCK, name: str = "nearest") -> DataFrame:
    """Candidate rows (probe, row, ``carry``, score) that hold the ``k`` best rows of every probe, exactly.

    Rows carry ``seen_by`` (profiles they are visible to; null: all), probes ``vector`` and ``profile``
    (bigint). The caller ranks the candidates, some of which lie beyond the ``k``-th.
    """
    lowest = -2.0 if min_score is None else float(min_score)
    probes = cut_lineage(_ready(probes, probe_key, lowest), f"{name}-probes")
    if not len(index.parts):
        kinds = {f.name: f.dataType.simpleString() for f in index.rows.schema.fields}
        fields = [f"{probe_key} {probes.schema[probe_key].dataType.simpleString()}", *[f"{c} {kinds[c]}" for c in (key, *carry)], "score double"]
        return probes.sparkSession.createDataFrame([], ", ".join(fields))
    blocks = blocks_of(probes, index, probe_block)
    start = _best(index, needed(index, probes, True), k, key, probe_key, carry, blocks, False)
    if len(index.parts) == 1:
        return start
    start = cut_lineage(start, f"{name}-start")
    rest = needed(index, with_floors(probes, start, k, probe_key), False)
    return start.unionByName(_best(index, rest, k, key, probe_key, carry, blocks, True))


def with_floors(probes: DataFrame, start: DataFrame, k: int, probe_key: str) -> DataFrame:
    """Probes with the score that their k-th best has at least, from what they met first."""
    reached = (start.groupBy(probe_key).agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
               .where(F.col("_n") >= k).select(probe_key, "_least"))
    return probes.join(reached, probe_key, "left").withColumn("floor", F.greatest("floor", F.coalesce("_least", F.col("floor")))).drop("_least")


def scanned_share(index: Cells, probes: DataFrame, k: int, key: str, probe_key: str, min_score: float | None = None) -> float:
    """Share of all (probe, row) pairs that a search looks at."""
    lowest = -2.0 if min_score is None else float(min_score)
    if not len(index.parts):
        return 0.0
    ready = _ready(probes, probe_key, lowest)
    n, blocks = ready.count(), blocks_of(ready, index, PROBE_BLOCK)
    first = needed(index, ready, True)
    start = _best(index, first, k, key, probe_key, [], blocks, False)
    rest = needed(index, with_floors(ready, start, k, probe_key), False)
    size = {(p["bundle"].item(), p["bit"].item()): p["rows"].item() for p in index.parts}
    bits = F.explode(F.sequence(F.lit(0), F.lit(BUNDLE_PARTS - 1)))
    met = (first.select("bundle", "mask").unionByName(rest.select("bundle", "mask")).withColumn("bit", bits)
           .where("shiftright(mask, bit) & 1 = 1").groupBy("bundle", "bit").count().collect())
    return sum(size[r["bundle"], r["bit"]] * r["count"] for r in met) / max(1, n * int(index.parts["rows"].sum()))
