"""Corpus statistics, ingestion bookkeeping, tenancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import or_blank, strip
from gleaner.operators.maintenance import latest_by


def corpus_stats(doc_meta: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals, counts by type and module, source bytes, last run — long (dim, key, n, text)."""
    sized = (doc_meta.join(files, doc_meta.source_file == files.name, "left")
             .select(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"),
                     F.coalesce(F.nullif("module_id", F.lit("")), F.lit("core")).alias("module_id"),
                     F.coalesce("length", F.lit(0)).cast("bigint").alias("bytes")))
    sets = sized.groupingSets([["doc_type"], ["module_id"], []], "doc_type", "module_id").agg(
        F.grouping_id().alias("g"), F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    dims = sets.where("g IN (1, 2)").select(
        F.when(F.col("g") == 1, "doc_type").otherwise("module").alias("dim"),
        F.when(F.col("g") == 1, F.col("doc_type")).otherwise(F.col("module_id")).alias("key"),
        F.col("docs").alias("n"), F.lit(None).cast("string").alias("text"))
    totals = sets.where("g = 3").select(F.inline(F.array(
        F.struct(F.lit("total").alias("dim"), F.lit("docs").alias("key"), F.col("docs").alias("n"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("total").alias("dim"), F.lit("bytes").alias("key"), F.coalesce("bytes", F.lit(0)).alias("n"), F.lit(None).cast("string").alias("text")))))
    last = runs.agg(F.max_by("timestamp", "line_no").alias("text")).select(
        F.lit("total").alias("dim"), F.lit("last_ingestion").alias("key"), F.lit(None).cast("bigint").alias("n"), "text")
    return dims.unionByName(totals).unionByName(last)


def share_table(counts: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """Counts with their per cent of the total (one decimal)."""
    total = counts.agg(F.greatest(F.sum(F.coalesce(n, F.lit(0))), F.lit(1)).alias("t")).scalar()
    filled = F.coalesce(F.col(n), F.lit(0))
    return counts.select(key, filled.alias(n), F.format_string("%.1f%%", filled / total * 100).alias("pct"))


# Image formats listed with a document, in listing order.
MEDIA_EXTENSIONS = ("png", "jpg", "jpeg", "webp")


def list_documents(doc_meta: DataFrame, media: DataFrame) -> DataFrame:
    """Documents with their image files, one row per image (one without file if there are none).

    ``ext_no`` then ``file_name`` is the listing order; nothing is gathered per document, so
    one with very many images stays spread over tasks.
    """
    ext = F.regexp_extract("file_name", r"\.([^.]*)$", 1)
    order = F.array_position(F.array(*[F.lit(e) for e in MEDIA_EXTENSIONS]), ext)
    pics = media.select("doc_id", "file_name", order.alias("ext_no")).where("ext_no > 0")
    return doc_meta.join(pics, "doc_id", "left")


def search_documents(docs: DataFrame, media: DataFrame, needle: str) -> DataFrame:
    """Documents with images whose id, file, type or module contains ``needle``."""
    wanted = needle.strip().lower()
    texts = F.array(*[or_blank(F.col(c).cast("string")) for c in ("doc_id", "source_file", "doc_type", "module_id")])
    found = docs.where(F.exists(texts, lambda t: F.contains(F.lower(t), F.lit(wanted)))) if wanted else docs
    return found.join(media, "doc_id", "left_semi")


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row: processed, skipped and failed files, chunks, per cent done, status."""
    err = F.col("error").isNotNull()
    made = ~err & (F.col("chunks") > 0)
    counts = results.agg(
        F.count("*").alias("total_files"), F.count_if(made).alias("processed"),
        F.count_if(~err & (F.col("chunks") <= 0)).alias("skipped"), F.count_if(err).alias("failed_count"),
        F.coalesce(F.sum(F.when(made, F.col("chunks"))), F.lit(0)).cast("bigint").alias("chunks_created"),
        F.count_if(err | made | (F.col("chunks") <= 0)).alias("_done"))
    return counts.select(
        "total_files", "processed", "skipped", "failed_count", "chunks_created",
        F.when(F.col("total_files") > 0, F.bround(F.col("_done") / F.col("total_files") * 100, 1)).otherwise(0.0).alias("progress_pct"),
        F.when(F.col("failed_count") > 0, "completed_with_errors").otherwise("completed").alias("status"))


def recent_results(results: DataFrame, failures: int = 50, successes: int = 30) -> DataFrame:
    """Last failures and last successes in processing order (top-k, no full sort)."""
    bad = results.where(F.col("error").isNotNull()).orderBy(F.desc("seq")).limit(failures)
    good = results.where(F.col("error").isNull() & (F.col("chunks") > 0)).orderBy(F.desc("seq")).limit(successes)
    return (bad.select(F.lit("failed").alias("kind"), "seq", "path", "error")
            .unionByName(good.select(F.lit("succeeded").alias("kind"), "seq", "path", "error")))


def failed_checkpoint(old: DataFrame, results: DataFrame) -> DataFrame:
    """Failure log by path: the newest failure replaces, a later success removes.

    ``old``: path, error, seq; ``results``: path, error (null = success), seq.
    """
    both = old.select("path", "error", "seq").unionByName(results.select("path", "error", "seq"))
    return latest_by(both, ["path"], ["seq"]).where(F.col("error").isNotNull())


def resume_set(failed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failed paths that still exist, paths pruned because they are gone)."""
    there = files.select("path").distinct()
    return failed.join(there, "path", "left_semi"), failed.join(there, "path", "left_anti")


# The settings a tenant may overlay.
OVERLAY_KEYS = ("erp_version", "contracted_modules", "has_robot_integration", "preferred_lang", "benchmark_lang")


def normalize_overlay_patch(patches: DataFrame) -> DataFrame:
    """Clean (tenant_id, key, value, seq) patches: the legacy version name is mapped, unless the
    same patch (``seq``) names the current one; languages are trimmed, the benchmark's lower-cased."""
    mapped = patches.withColumn("legacy", F.col("key") == "legacy_erp_version").withColumn(
        "key", F.when(F.col("legacy"), "erp_version").otherwise(F.col("key")))
    value = F.when(F.col("key") == "benchmark_lang", F.lower(strip(F.col("value")))) \
        .when(F.col("key") == "preferred_lang", strip(F.col("value"))).otherwise(F.col("value"))
    rows = mapped.where(F.col("key").isin(*OVERLAY_KEYS) & F.col("value").isNotNull()).withColumn("value", value)
    return latest_by(rows, ["tenant_id", "key", "seq"], [~F.col("legacy")]).drop("legacy")


def tenant_overlay(overlay: DataFrame, patches: DataFrame) -> DataFrame:
    """Key-wise merge of (tenant_id, key, value, seq) patches; a null value removes the key.
    A tenant without keys has no rows."""
    return latest_by(overlay.unionByName(patches), ["tenant_id", "key"], ["seq"]).where(F.col("value").isNotNull())
