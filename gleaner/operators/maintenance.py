"""Keeping tables up to date: replace, upsert, patch, cascade, skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.dims import GLOBAL_TENANT
from gleaner.functions.text import or_blank, strip


def latest_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the last in ``order``.

    An aggregate, not a window: partial maxima are taken before the shuffle, so a key
    that repeats in a third of the rows costs one row per task.
    """
    names = df.columns
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*names), at).alias("_row"))
    return top.select(*[F.col(f"_row.`{n}`").alias(n) for n in names])


def latest_price_version(prices: DataFrame) -> DataFrame:
    """Rows of the lexicographically last price list."""
    return prices.where(F.col("version") == prices.agg(F.max("version")).scalar())


def replace_by_key(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``base`` with all rows of the keys in ``new`` exchanged for those of ``new``."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_by_key(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace on ``keys``; the last change in ``order`` wins over all else."""
    both = (base.withColumn("_new", F.lit(0))
            .unionByName(changes.withColumn("_new", F.lit(1))))
    return latest_by(both, keys, ["_new", *order]).drop("_new")


PATCHABLE = ("tenant_id", "term", "aliases", "expansion", "enabled")


def _clean_aliases(c: Column) -> Column:
    return F.filter(F.transform(c, lambda a: strip(a)), lambda a: a != "")


def patch_glossary(base: DataFrame, patches: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Apply creates, updates and deletes; returns (glossary, rejected patches with reason).

    ``patches``: op (create/update/delete), id, the patchable columns (null = unchanged).
    A blank tenant means every tenant; a create or update to a blank term is rejected;
    update and delete of an unknown id are reported. At most one patch per id.
    """
    clean = (patches
             .withColumn("tenant_id", F.when(F.col("tenant_id").isNull(), None)
                         .otherwise(F.coalesce(F.nullif(strip(F.col("tenant_id")), F.lit("")), F.lit(GLOBAL_TENANT))))
             .withColumn("term", strip(F.col("term")))
             .withColumn("expansion", strip(F.col("expansion")))
             .withColumn("aliases", _clean_aliases(F.col("aliases"))))
    known = base.select("id", F.lit(True).alias("_known"))
    tagged = clean.join(known, "id", "left").withColumn(
        "reason",
        F.when((F.col("op") == "create") & (or_blank(F.col("term")) == ""), F.lit("term is required"))
        .when((F.col("op") == "update") & (F.col("term") == ""), F.lit("term is required"))
        .when((F.col("op") != "create") & F.col("_known").isNull(), F.lit("unknown id"))
        .when((F.col("op") == "create") & F.col("_known").isNotNull(), F.lit("id exists")))
    rejected = tagged.where(F.col("reason").isNotNull()).select("id", "op", "reason")
    good = tagged.where(F.col("reason").isNull())
    change = good.where("op = 'update'").select(
        "id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in PATCHABLE])
    kept = base.join(good.where("op = 'delete'").select("id"), "id", "left_anti").join(change, "id", "left")
    any_change = F.coalesce(*[F.col(f"_{c}").isNotNull() | F.lit(None) for c in PATCHABLE], F.lit(False))
    updated = kept.select(
        "id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in PATCHABLE],
        F.when(any_change, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))
    created = good.where("op = 'create'").select(
        "id", F.coalesce("tenant_id", F.lit(GLOBAL_TENANT)).alias("tenant_id"), "term",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        or_blank(F.col("expansion")).alias("expansion"), F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.lit(now).alias("updated_at"))
    return updated.unionByName(created), rejected


def delete_calls(points: DataFrame, calls: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove calls: (points left, catalog left, touched files with the calls they still have)."""
    doomed = calls.join(ids, "id", "left_semi")
    by_call = doomed.select("call_id", "source_file_hash").distinct()
    points_left = points.join(by_call, ["call_id", "source_file_hash"], "left_anti")
    calls_left = calls.join(ids, "id", "left_anti")
    siblings = calls_left.groupBy("source_file_hash").agg(F.count("*").alias("siblings_remaining"))
    files = (doomed.select("source_file_hash").distinct().join(siblings, "source_file_hash", "left")
             .withColumn("siblings_remaining", F.coalesce("siblings_remaining", F.lit(0)).cast("bigint"))
             .withColumn("orphaned", F.col("siblings_remaining") == 0))
    return points_left, calls_left, files


def skip_existing(items: DataFrame, done: DataFrame, key: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items still to index, items whose catalog row is refreshed) — the latter are all of them."""
    return (items if force else items.join(done.select(key).distinct(), key, "left_anti")), items
