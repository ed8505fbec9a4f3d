"""Folds by doc_id and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key as text, modulo ``folds``, is ``fold``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y) of the rows outside the held-out fold whose label is 0 or 1 and not contradicted."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~in_fold(F.col("doc_id"), folds, held))
    return (rows.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most"))
            .where("y = _most").select("doc_id", F.col("y").cast("int").alias("y")))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, spread evenly by a hash of doc_id: the same rows in every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
