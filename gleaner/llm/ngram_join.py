"""N-gram Jaccard join: documents linked by the overlap of their word n-grams.

Two documents link when ``100 * intersection >= percent * union`` of their sets of n-word shingles.
Documents with equal sets form one class, known by a 64-bit hash of the set; only classes are
compared, so copies never meet each other. The plan:

1. *Rare first.* All shingles of all documents are counted in a fixed number of hash buckets, enough that
   a frequent shingle stands out from those that share a bucket by chance; a
   set is ordered by (count, hash), which is one total order for all documents whatever the counts.
2. *Prefixes.* A class emits the first ``n - ceil(percent * n / 100) + 1`` shingles of its order with
   its size and their positions; linked classes share at least one of them. A token's list is cut where
   the next larger set is too large for the one before it, so that no link crosses a cut; parts of a
   single class are dropped at once.
3. *Filters.* A pair that shares a prefix token must pass the length filter and the positional
   filter there; the survivors are made distinct, so each pair is verified once. Verification first
   compares parity sketches (bits that differ bound the elements that do), then applies the suffix
   filter (overlaps of ranges of the hash order bound the whole overlap) and then intersects.
4. *Hot groups.* A group of near copies shares its prefix tokens, so pairs within a token's list are
   never enumerated as such: in ``HUB_ROUNDS`` rounds every class meets only the hub of each of its lists
   (first the class with most shared tokens, then those with most links so far), and the components
   of the links found are settled. After that
   only lists that still hold several components matter, and only pairs across components are
   verified there, met by steps of the set size. No link between components is lost.
5. *Components* by contraction: each vertex points to its smallest neighbour, pointers are followed
   to their roots, edges are moved to the roots, until no edge is left.

Defined cases: a text with fewer words than ``k`` is one shingle (all its words); a text without
words, or null, has no shingle and links with nothing; rows with a null doc_id get their
``n_shingles`` and a null component, and link with nothing; repeated rows, also of one doc_id, each
give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.rows import mapped
from gleaner.llm.words import run_hashes, words_of
from gleaner.llm.sift import may_match, sifter
from gleaner.session import cut_lineage

BUCKETS = 1 << 22          # shingle counts kept for the order: a fixed 16 MB sent to every task
SECTION = 1 << 16          # counts that are added up as one row
MEET = 64                  # rows of a section that are added at last
NEXT = 16                  # tasks whose rows of a section are added first
FLUSH_ROWS = 1 << 16       # rows a task sends on at once
SUFFIX_PARTS = 256         # ranges of the suffix filter: sets of some hundred shingles that share three quarters still differ in them
COARSE = 4                 # neighbouring ranges summed for its first test
SKETCH_BITS = 1 << 10      # of the parity sketch: 128 bytes; unlike sets of up to some thousand shingles differ in enough of them
HUB_ROUNDS = 3


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = words_of(text)
    if len(words) == 0:
        return words
    return np.unique(run_hashes(words, min(k, len(words))))


def set_key(grams: np.ndarray) -> int:
    """A signed 64-bit number for an equal set."""
    return int(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], dtype=np.uint64).view(np.int64)[0])


def _sizes(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                                "key": pd.array([set_key(s) if len(s) else None for s in sets], dtype="Int64"),
                                **small_ranges([ranges(s) for s in sets]), "sketch": [parities(s) for s in sets]})

    return run


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _counts(k: int, buckets: int):
    """Counts of a task's texts, a row for each section of the buckets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int32)
        for b in batches:
            for t in b["text"]:
                np.add.at(total, _bucket(shingle_set(t, k), buckets), 1)
        part = TaskContext.get().partitionId() // NEXT % MEET
        for i in range(0, buckets, SECTION):
            if total[i:i + SECTION].any():
                yield pd.DataFrame({"section": [i // SECTION], "part": [part], "n": [_packed(total[i:i + SECTION])]})

    return run


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.int32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=np.int32)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SECTION, dtype=np.int64)
    for n in rows["n"]:
        total[:len(_unpacked(n))] += _unpacked(n)
    return pd.DataFrame({"section": [rows["section"].iloc[0]], "part": [0], "n": [_packed(np.minimum(total, np.iinfo(np.int32).max))]})


def bucket_counts(rows: DataFrame, k: int, buckets: int = 0) -> np.ndarray:
    """Documents by bucket of their shingles. Arrays are added up, in two steps of bounded groups, so the
    exchange carries some kilobytes for each task and section, whatever the texts."""
    buckets, schema = buckets or BUCKETS, "section int, part int, n binary"
    parts = rows.transform(mapped, _counts(k, buckets), schema).groupBy("section", "part").applyInPandas(_added, schema)
    counts = np.zeros(buckets, dtype=np.int32)
    for r in parts.groupBy("section").applyInPandas(_added, schema).collect():
        at = r["section"] * SECTION
        counts[at:at + SECTION] = _unpacked(bytes(r["n"]))[:len(counts) - at]
    return counts


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of a set of ``n`` must be looked at: of any linked pair, both share one."""
    return n - -(-percent * n // 100) + 1


def ordered_prefix(grams: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    order = np.lexsort((grams, counts[_bucket(grams, len(counts))]))
    return grams[order[:prefix_length(len(grams), percent)]]


def _postings(k: int, percent: int, counts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = counts.value
        token, key, size, pos, held = [], [], [], [], 0
        seen: set[int] = set()           # copies within a task are sent once
        for b in batches:
            for t in b["text"]:
                grams = shingle_set(t, k)
                mine = set_key(grams)
                if len(grams) == 0 or mine in seen:
                    continue
                if len(seen) >= FLUSH_ROWS:
                    seen.clear()
                seen.add(mine)
                first = ordered_prefix(grams, weight, percent)
                token.append(first.view(np.int64))
                key.append(np.full(len(first), mine))
                size.append(np.full(len(first), len(grams), dtype=np.int32))
                pos.append(np.arange(len(first), dtype=np.int32))
                held += len(first)
                if held >= FLUSH_ROWS:
                    yield pd.DataFrame({"token": np.concatenate(token), "key": np.concatenate(key), "n": np.concatenate(size), "pos": np.concatenate(pos)})
                    token, key, size, pos, held = [], [], [], [], 0
        if held:
            yield pd.DataFrame({"token": np.concatenate(token), "key": np.concatenate(key), "n": np.concatenate(size), "pos": np.concatenate(pos)})

    return run


def ranges(grams: np.ndarray) -> np.ndarray:
    """How many elements lie in each of the suffix filter's ranges of the hash order."""
    cuts = (np.arange(1, SUFFIX_PARTS, dtype=np.uint64) << np.uint64(32)) // np.uint64(SUFFIX_PARTS) << np.uint64(32)
    return np.diff(np.searchsorted(grams, cuts), prepend=0, append=len(grams)).astype(np.int32)


def small_ranges(counts: list[np.ndarray]) -> dict[str, list]:
    """Counts as bytes in a unit for each set, rounded up, so that they never bound an overlap too low."""
    units = [int(c.max()) // 127 + 1 for c in counts]
    return {"unit": units, "ranges": [(-(-c // u)).astype(np.int8) for c, u in zip(counts, units)]}


def parities(grams: np.ndarray) -> np.ndarray:
    """Which bits of the sketch an odd number of elements falls on, in signed 64-bit words."""
    odd = np.bincount((grams & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_filter(percent: int) -> str:
    """SQL over (n, sketch) and (n2, sketch2): two sets differ in no fewer elements than their sketches in bits."""
    differ = " + ".join(f"bit_count(sketch[{i}] ^ sketch2[{i}])" for i in range(SKETCH_BITS // 64))
    return f"(n + n2 - ({differ})) * {100 + percent} >= {2 * percent} * (n + n2)"


def suffix_filter(percent: int, first: str = "", x: str = "x", y: str = "y") -> str:
    """SQL over (n, ranges) and (n2, ranges2): what the ranges have in common at most is enough to link.
    ``first`` is tried first, as compiled code; without it, sums of ranges are (coarse, coarse2). ``x``
    and ``y`` are the counts that an element of the ranges stands for."""
    enough = f"* {100 + percent} >= {percent} * (n + n2)"
    few = " + ".join(f"least(coarse[{i}], coarse2[{i}])" for i in range(SUFFIX_PARTS // COARSE))
    all_ = f"aggregate(zip_with(ranges, ranges2, (x, y) -> least({x}, {y})), 0, (sum, x) -> sum + x)"
    return f"{first or f'({few}) {enough}'} AND {all_} {enough}"


def _sets(k: int, bitmap):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[may_match(bitmap.value, b["slot"].to_numpy(dtype=np.int64))]
            sets = [shingle_set(t, k) for t in b["text"]]
            sets = [s for s in sets if len(s)]
            yield pd.DataFrame({"key": pd.array([set_key(s) for s in sets], dtype="int64"), "grams": [s.tobytes() for s in sets]})

    return run


def overlap_needed(na: int, nb: int, percent: int) -> int:
    """The smallest intersection of two linked sets."""
    return -(-percent * (na + nb) // (100 + percent))


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """Exact verification of two ascending sets."""
    ga, gb = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    return len(np.intersect1d(ga, gb, assume_unique=True)) >= overlap_needed(len(ga), len(gb), percent)


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [linked(x, y, percent) for x, y in zip(b["grams_a"], b["grams_b"])]
            yield b.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


def possible(percent: int) -> str:
    """SQL over (n, pos) and (n2, pos2): length and positional filter of a shared prefix token."""
    return (f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND "
            f"(least(pos, pos2) + 1 + least(n - pos, n2 - pos2) - 1) * {100 + percent} >= {percent} * (n + n2)")


def cut_lists(posts: DataFrame, percent: int) -> DataFrame:
    """``posts`` (token, key, n, pos) with a token of its own for each part of a list, without those alone
    in a part. A part ends where the next larger size fails the length filter with the last one."""
    size, by_size = F.col("n").cast("bigint"), Window.partitionBy("token").orderBy("n")
    opens = F.coalesce(100 * F.lag(size).over(by_size) < percent * size, F.lit(True))
    ends = F.coalesce(100 * size < percent * F.lead(size).over(by_size), F.lit(True))
    part = F.sum(F.col("_opens").cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (posts.withColumns({"_opens": opens, "_ends": ends}).withColumn("_part", part).where("NOT (_opens AND _ends)")
            .select(F.when(F.col("_part") > 1, F.xxhash64("token", "_part")).otherwise(F.col("token")).alias("token"), "key", "n", "pos"))


def size_step(n: Column, percent: int) -> Column:
    """Number of a set size on a scale on which sizes that pass the length filter are at most one step
    apart; steps are a little wider than need be, so that rounding loses none."""
    return F.floor(F.log(n) / F.lit(max(math.log(100 / percent) * 1.0001, 1e-9)))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (a, b); the root is some vertex of its component."""
    both = edges.where("a <> b").select("a", "b")
    spark = edges.sparkSession
    total: DataFrame | None = None
    edges = cut_lineage(both, name)
    while not edges.isEmpty():
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("vertex"), F.least("a", "m").alias("root"))
        up = cut_lineage(up, name)
        while True:          # halve the paths until every pointer is a root's
            over = up.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
            longer = cut_lineage(up.join(over, "root").select("vertex", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), name)
            up = longer.select("vertex", "root")
            if longer.where("moved").isEmpty():
                break
        here = up.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
        if total is None:
            total = up
        else:
            total = cut_lineage(total.join(here, "root", "left").select("vertex", F.coalesce("next", "root").alias("root")), name)
        a = up.select(F.col("vertex").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").where("ra <> rb")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
    if total is None:
        return spark.createDataFrame([], "vertex bigint, root bigint")
    return total


def jaccard_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies) of every row; component_id is the smallest doc_id
    that links reach, copies the number of rows with an equal set."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = cut_lineage(docs.transform(
        mapped, _sizes(k), "doc_id bigint, n_shingles bigint, key bigint, unit int, ranges array<tinyint>, sketch array<bigint>"), "jaccard-sizes")
    rows = docs.where("doc_id IS NOT NULL")

    counts = bucket_counts(rows, k)
    shared = spark.sparkContext.broadcast(counts)

    fields = ("token", "key", "n", "pos")
    # Dealt by token once: making distinct, cutting and filtering need no further exchange.
    posts = (rows.transform(mapped, _postings(k, percent, shared), "token bigint, key bigint, n int, pos int")
             .repartition(n_parts, "token").groupBy(*fields).agg(F.count("*").alias("copies")).drop("copies"))
    posts = cut_lineage(posts.transform(cut_lists, percent), "jaccard-shared")

    first = base.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    shape = base.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("unit", "ranges", "sketch")])
    shape = cut_lineage(shape.join(posts.select("key").distinct(), "key", "left_semi"), "jaccard-ranges")
    shape2 = shape.select(*[F.col(c).alias(c + "2") for c in shape.columns])
    alike = suffix_filter(percent, sketch_filter(percent), "x * unit", "y * unit2")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``; sets are computed again, for the classes concerned only."""
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = cut_lineage(first.join(keys, "key").select("key", "doc_id"), "jaccard-wanted")
        bitmap, slot = sifter(wanted.select("doc_id"))
        sets = rows.select(slot(F.col("doc_id")).alias("slot"), "text").transform(mapped, _sets(k, bitmap), "key bigint, grams binary")
        # The bitmap lets some other sets pass.
        sets = cut_lineage(sets.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "jaccard-sets")
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("grams").alias(f"grams_{side}")), side)
        return cut_lineage(pairs.transform(mapped, _verify(percent), "a bigint, b bigint"), "jaccard-links")

    links: DataFrame | None = None
    roots: DataFrame | None = None
    tried: DataFrame | None = None
    left = posts.withColumn("root", F.col("key"))
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:
            # Of near copies, the one they were made from has no rare shingles of its own in front of the
            # shared ones, so it is first in its lists; later, the one with most links so far is.
            rank, order = left, ["pos"]
            if links is not None:
                order = ["weight", "pos"]
                degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
                rank = left.join(degree, "key", "left").withColumn("weight", -F.coalesce("degree", F.lit(0))).drop("degree")
            rank = rank.repartition(n_parts, "token")
            hub = rank.groupBy("token").agg(F.min(F.struct(*order, "key", "n", "root")).alias("h"), F.count("*").alias("c")).select(
                "token", "c", F.col("h.key").alias("key2"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2"), F.col("h.root").alias("root2"))
            met = cut_lineage(rank.join(hub, "token").where("key <> key2"), "jaccard-met")
            pairs = met.where("root <> root2").where(possible(percent))
        else:
            # Sets that link lie in the same step of sizes or in the next one. Few bytes, much work: not left
            # to the size-based choice of partitions.
            left = left.drop("n").join(shape.select("key", "n", "sketch"), "key").withColumn("step", size_step(F.col("n"), percent))
            other = left.select("token", "step", *[F.col(c).alias(c + "2") for c in left.columns if c not in ("token", "step")])
            lower = left.withColumn("step", F.explode(F.array("step", F.col("step") + 1)))
            pairs = (lower.repartition(n_parts, "token", "step").join(other.repartition(n_parts, "token", "step"), ["token", "step"])
                     .where("(n < n2 OR n = n2 AND key < key2) AND root <> root2").where(possible(percent)).where(sketch_filter(percent)))
        # A pair may meet in hundreds of lists; ranges are compared once, and sketches before them.
        pairs = (_distinct_pairs(pairs).join(shape.withColumnRenamed("key", "a"), "a").join(shape2.withColumnRenamed("key2", "b"), "b")
                 .where(alike).select("a", "b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs, "jaccard-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = verified(pairs)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = cut_lineage(connected(links), "jaccard-roots")
        if turn < HUB_ROUNDS:
            # A hub has met its whole list and leaves it. Lists that still hold several components matter.
            now = (met.where("c > 2").select(*fields).join(roots.withColumnRenamed("vertex", "key"), "key", "left")
                   .withColumn("root", F.coalesce("root", "key")).repartition(n_parts, "token"))
            mixed = now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
            left = cut_lineage(now.join(mixed, "token", "left_semi"), "jaccard-mixed")
            if left.isEmpty():
                break

    classes = first.join(roots.withColumnRenamed("vertex", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(smallest, "root").select("key", "component_id", "copies")
    none = base.where("key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("copies"))
    return base.where("key IS NOT NULL AND doc_id IS NOT NULL").join(classes, "key").select("doc_id", "n_shingles", "component_id", "copies").unionByName(none)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: of each component the row of the
    smallest doc_id (of rows that repeat that doc_id, one), and every row without doc_id or words."""
    parts = jaccard_components(docs, k, percent)
    mine, other = F.col("doc_id").cast("bigint"), "_stays"
    while other in docs.columns:
        other += "_"
    stays = parts.where("n_shingles = 0 OR doc_id = component_id").select(F.col("doc_id").alias(other)).where(F.col(other).isNotNull()).distinct()
    known = docs.join(stays, mine == F.col(other), "left_semi")
    # A doc_id that several rows share is one document; the row of the smallest text stands for it.
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    single = known.join(repeated, "doc_id", "left_anti")
    rest = F.struct(*[c for c in docs.columns if c != "doc_id"])
    doubles = (known.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("_row"))
               .select("doc_id", "_row.*"))
    return single.select(*docs.columns).unionByName(doubles.select(*docs.columns)).unionByName(docs.where(mine.isNull()))
