"""Sinks: append-only logs and partitioned chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def write_chunks(chunks: DataFrame, path: str, doc_meta: DataFrame | None = None, meta_path: str | None = None) -> None:
    """Chunks partitioned by document type, document metadata as one table beside them.

    Rows are written where they are: there is no shuffle by type, so a type holding most
    chunks is still written by all tasks.
    """
    chunks.write.mode("overwrite").partitionBy("doc_type").parquet(path)
    if doc_meta is not None and meta_path:
        doc_meta.write.mode("overwrite").parquet(meta_path)
