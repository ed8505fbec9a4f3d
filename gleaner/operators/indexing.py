"""Index building: vectors, call points, duplicates."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.replies import unit_interval
from gleaner.functions.text import or_blank, strip
from gleaner.functions.vectors import is_zero, norm
from gleaner.operators import cells
from gleaner.session import cut_lineage

# Similarity limits, name space of point ids, index size per chunk.
QA_LIMIT = 0.92
ISSUE_LIMIT = 0.94
POINT_NAMESPACE = "8e58f1c8-4c8d-5b2e-9a1f-0c3e7d2b6a01"
BYTES_PER_CHUNK = 1024 * 4
OVERHEAD = 1.15


def index_chunks(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexed chunks with their vector, one row with indexed and skipped counts); chunks without a
    vector or with an all-zero one are skipped, a missing module becomes blank."""
    joined = chunks.join(vectors, "chunk_id", "left").withColumn("_zero", F.coalesce(is_zero(F.col("embedding")), F.lit(True)))
    counts = joined.agg(F.count_if(~F.col("_zero")).alias("indexed"), F.count_if("_zero").alias("skipped"))
    return joined.where(~F.col("_zero")).drop("_zero").withColumn("module_id", or_blank(F.col("module_id"))), counts


def call_index_points(calls: DataFrame) -> DataFrame:
    """One ``rag_qa`` point per non-blank question/answer pair and one ``issue_summary`` per call.

    ``calls``: call_id, source_file_hash, problem, resolution, rag_qa array<struct<question,
    answer,category,confidence>>.
    """
    pairs = calls.select("call_id", "source_file_hash", F.posexplode("rag_qa").alias("rag_pair_index", "p"))
    text = strip(F.concat(strip(or_blank(F.col("p.question"))), F.lit(" "), strip(or_blank(F.col("p.answer")))))
    qa = pairs.select(
        "call_id", "source_file_hash", F.lit("rag_qa").alias("point_kind"), "rag_pair_index", F.col("p.category").alias("category"),
        unit_interval(F.col("p.confidence"), 0.5).alias("confidence"), text.alias("indexed_text")).where("indexed_text <> ''")
    summary = strip(F.concat(strip(or_blank(F.col("problem"))), F.lit("\n\n"), strip(or_blank(F.col("resolution")))))
    issue = calls.select(
        "call_id", "source_file_hash", F.lit("issue_summary").alias("point_kind"), F.lit(None).cast("int").alias("rag_pair_index"),
        F.lit("").alias("category"), F.lit(None).cast("double").alias("confidence"), summary.alias("indexed_text")).where("indexed_text <> ''")
    return qa.unionByName(issue)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based UUID (version 5)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
                    F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def point_ids(points: DataFrame) -> DataFrame:
    """Points with an id that is the same on every run."""
    name = F.when(F.col("point_kind") == "rag_qa", F.concat_ws(":", F.lit("rag"), "source_file_hash", "call_id", F.col("rag_pair_index").cast("string"))) \
        .otherwise(F.concat_ws(":", F.lit("issue"), "source_file_hash", "call_id"))
    return points.withColumn("point_id", uuid5(name))


def limit_for(kind: Column) -> Column:
    return F.when(kind == "issue_summary", ISSUE_LIMIT).otherwise(QA_LIMIT)


_KINDS = ("rag_qa", "issue_summary")


def _kind(column: Column) -> Column:
    """Number of a known kind; null for others, which are alike to nothing."""
    return F.when(column == _KINDS[0], F.lit(0)).when(column == _KINDS[1], F.lit(1)).cast("bigint")


def near_dup_against_index(new: DataFrame, index: DataFrame, **sizes: int) -> DataFrame:
    """New points (id, kind, probe) with their best similarity to indexed points (id, kind,
    vector) of the same kind and whether they are dropped: strictly above the kind's limit."""
    probes = new.select(F.col("id").alias("query_id"), F.col("probe").alias("vector"), _kind(F.col("kind")).alias("profile")).where("profile IS NOT NULL")
    corpus = index.select(F.col("id").alias("chunk_id"), "vector", _kind(F.col("kind")).alias("_kind")).where("_kind IS NOT NULL")
    stored = cells.build(corpus.select("chunk_id", "vector", F.array("_kind").alias("seen_by")), "chunk_id", "points",
                         **{c: n for c, n in sizes.items() if c != "probe_block"})
    best = cells.nearest(stored, probes, 1, "chunk_id", "query_id", [], probe_block=sizes.get("probe_block", cells.PROBE_BLOCK))
    top = best.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("similarity"))
    rows = new.select("id", "kind").join(top, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return rows.withColumn("dropped", F.col("similarity") > limit_for(F.col("kind")))


HEAD = 8192              # undecided points that one task settles in order


def near_dup_in_batch(points: DataFrame, name: str = "near-dup", head: int = HEAD, **sizes: int) -> DataFrame:
    """Points (id, kind, ord, probe, vector) kept by the sequential rule of one run: a point
    stays iff no earlier *kept* point of its kind is too similar.

    1. Copies: of points equal in kind, probe and vector direction, which also exceed the
       limit against themselves, only the first can stay; the others go at once, by an
       aggregate, however many they are.
    2. Rounds, each written before the next. The first ``head`` undecided points depend on no
       other undecided ones: one task settles them in order, however they are linked. Of the
       others, those without an earlier undecided neighbour stay too. Then all that
       are too similar to a point that stays go. So there are at most n / ``head`` rounds, a
       chain of links that long included, and few where points are linked at random.

    Neighbours are looked for in the cells whose angle bound reaches the limit (``cells``); a
    round emits one row per point and cell at most, never pairs. Points of other kinds than the two
    known are kept, as nothing is compared with them.
    """
    directed = points.withColumns({"_pn": norm(F.col("probe")), "_vn": norm(F.col("vector")), "_pu": _unit("probe"), "_vu": _unit("vector")})
    self_sim = F.aggregate(F.zip_with("_pu", "_vu", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    alike = (F.col("_pn") >= 1e-12) & (F.col("_vn") >= 1e-12) & (self_sim > limit_for(F.col("kind")) + 1e-6)
    split = directed.withColumn("_alike", alike)
    first = split.where("_alike").groupBy("kind", "_pu", "_vu").agg(F.min("ord").alias("ord")).select("kind", "ord")
    cols = ["id", "kind", "ord", "probe", "vector"]
    different = (split.where("_alike").join(first, ["kind", "ord"], "left_semi").select(*cols)
                 .unionByName(split.where("NOT coalesce(_alike, false)").select(*cols)))
    every = cut_lineage(different.withColumn("_limit", limit_for(F.col("kind"))).withColumn("kind", _kind(F.col("kind"))), f"{name}-points")
    kept = every.where("kind IS NULL").select("id")
    every = every.where("kind IS NOT NULL").select(*cols, "_limit", _direction("probe").alias("_p"), _direction("vector").alias("_v"))
    # A point without direction is alike to nothing and stays.
    kept = kept.unionByName(every.where("_p = 0 AND _v = 0").select("id"))
    undecided = every.where("_p > 0 OR _v > 0")
    index, left, turn = None, undecided.count(), 0
    while left:
        turn += 1
        begin = undecided.orderBy("ord", "id").limit(head)
        settled = cut_lineage(_in_order(begin), f"{name}-head-{turn}")
        stay, gone = settled.where("stays").select("id"), settled.select("id")
        if left > head:
            if index is None:
                index = cells.build(every.select("id", "kind", "ord", "vector"), "id", f"{name}-index", **sizes)
            free = undecided.join(_preceded(index, undecided, undecided.select("id")), "id", "left_anti").select("id")
            stay = cut_lineage(stay.unionByName(free).distinct(), f"{name}-kept-{turn}")
            rest = undecided.join(gone.unionByName(stay), "id", "left_anti")
            undecided = cut_lineage(rest.join(_preceded(index, rest, stay), "id", "left_anti"), f"{name}-{turn}")
            left = undecided.count()
        else:
            left = 0
        kept = kept.unionByName(stay)
    return kept


def _unit(vector: str) -> Column:
    """The vector over its length, which is bound to a variable: a column would be computed again for every entry."""
    length = F.array(norm(F.col(vector)))
    return F.element_at(F.transform(length, lambda n: F.transform(vector, lambda x: (x / n).cast("float"))), 1)


def _direction(vector: str) -> Column:
    return F.when(cells.flat(F.col(vector)), 0).otherwise(F.size(vector))


def _in_order(points: DataFrame) -> DataFrame:
    """(id, stays) of a bounded number of points, by the sequential rule, in one task."""
    def run(rows: pa.Table) -> pa.Table:
        order = np.lexsort((np.unique(rows.column("id").to_numpy(), return_inverse=True)[1], rows.column("ord").to_numpy()))
        rows = rows.take(pa.array(order))
        kind, limit, when = (rows.column(c).to_numpy() for c in ("kind", "_limit", "ord"))
        p_dims, v_dims = rows.column("_p").to_numpy(), rows.column("_v").to_numpy()
        stays = np.zeros(rows.num_rows, dtype=bool)

        def above(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
            out = np.zeros((len(mine), len(others)), dtype=bool)
            for d in np.unique(v_dims[others][v_dims[others] > 0]).tolist():
                a, b = np.flatnonzero(p_dims[mine] == d), np.flatnonzero(v_dims[others] == d)
                if len(a):
                    x, y = cells.matrix(rows.column("probe").take(pa.array(mine[a]))), cells.matrix(rows.column("vector").take(pa.array(others[b])))
                    out[np.ix_(a, b)] = np.round(x @ y.T, cells.DIGITS) > limit[mine[a]][:, None]
            return out & (kind[mine][:, None] == kind[others][None, :]) & (when[others][None, :] < when[mine][:, None])

        for at in range(0, rows.num_rows, cells.STRIPE):
            mine = np.arange(at, min(at + cells.STRIPE, rows.num_rows))
            blocked = above(mine, np.flatnonzero(stays)).any(axis=1)
            inner = above(mine, mine)
            for i in range(len(mine)):
                if not blocked[i]:
                    stays[mine[i]] = True
                    blocked |= inner[:, i]
        return pa.table([rows.column("id"), pa.array(stays)], ["id", "stays"])

    kind = points.schema["id"].dataType.simpleString()
    return points.groupBy(F.lit(0).alias("_all")).applyInArrow(run, f"id {kind}, stays boolean")


def _preceded(index: cells.Cells, points: DataFrame, earlier: DataFrame) -> DataFrame:
    """Ids of ``points`` too similar to a point of ``earlier`` (id) that precedes them."""
    among = dataclasses.replace(index, rows=index.rows.join(earlier.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left_semi")
                                .withColumnsRenamed({"id": "other", "kind": "other_kind", "ord": "other_ord"}))
    probes = points.where("_p > 0").select("id", "kind", "ord", F.col("probe").alias("vector"), F.col("_p").alias("dims"), F.col("_limit").alias("floor"))

    def hits(rows: pa.Table, some: pa.Table) -> pa.Table:
        # By unit vectors of the rows' length; a limit lies above 0, the score of all others.
        dims = rows.column("dims")[0].as_py()
        some = some.filter(pa.array((some.column("dims").to_numpy() == dims) & (dims > 0)))
        found = np.zeros(some.num_rows, dtype=bool)
        if some.num_rows:
            kind, when, limit = (some.column(c).to_numpy() for c in ("kind", "ord", "floor"))
            other_kind, other_when = (rows.column(c).to_numpy() for c in ("other_kind", "other_ord"))
            p, x = cells.matrix(some.column("vector")), cells.matrix(rows.column("vector"))
            mask, bit = some.column("mask").to_numpy(), np.int64(1) << rows.column("bit").to_numpy()
            for number in np.unique(kind).tolist():
                for mine, others in cells.by_parts(np.flatnonzero(kind == number), np.flatnonzero(other_kind == number), mask, bit):
                    for i, j, score in cells.close(p[mine], x[others], limit[mine]):
                        i, j = mine[i], others[j]
                        found[i[(score > limit[i]) & (other_when[j] < when[i])]] = True
        return pa.table([some.column("id").filter(pa.array(found))], ["id"])

    kind = points.schema["id"].dataType.simpleString()
    found = cells.meet(among, cells.needed(index, probes, None), hits, f"id {kind}", ["other_kind", "other_ord"], "id",
                       cells.blocks_of(points, index, cells.PROBE_BLOCK), False)
    return found.distinct()


def index_run_stats(points: DataFrame) -> DataFrame:
    """Per call: pairs, indexed and skipped ones, whether its issue was written.
    ``points``: source_file_hash, call_id, point_kind, dropped."""
    qa, gone = F.col("point_kind") == "rag_qa", F.col("dropped")
    return points.groupBy("source_file_hash", "call_id").agg(
        F.count_if(qa).alias("rag_total"), F.count_if(qa & ~gone).alias("rag_indexed"), F.count_if(qa & gone).alias("rag_skipped"),
        F.count_if(~qa & ~gone).alias("issue_upserted"))


def points_per_file(stats: DataFrame) -> DataFrame:
    """Points written per recording."""
    return stats.groupBy("source_file_hash").agg(F.sum(F.col("rag_indexed") + F.col("issue_upserted")).alias("points_upserted"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and the approximate size of their index in MB."""
    return chunks.agg(F.count("*").alias("total_chunks")).select(
        "total_chunks", F.bround(F.col("total_chunks") * BYTES_PER_CHUNK * OVERHEAD / 1048576, 2).alias("approximate_index_mb"))
