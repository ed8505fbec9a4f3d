"""The batch pipeline from files to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import or_blank, strip
from gleaner.operators.chunking import chunk_documents
from gleaner.operators.classify import classify_documents
from gleaner.operators.documents import insert_captions
from gleaner.operators.maintenance import skip_existing


def ingest_documents(texts: DataFrame, done: DataFrame, rules: DataFrame, parsed_replies: DataFrame | None = None,
                     captions: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of converted documents (doc_id, path, text).

    Documents already done are skipped unless forced; empty conversions become error rows -
    any other text yields a chunk -; discarded documents leave without an error.
    """
    fresh, _all = skip_existing(texts, done, "doc_id", force)
    blank = strip(or_blank(F.col("text"))) == ""
    empty = fresh.where(blank).select("doc_id", F.lit("empty conversion result").alias("error"))
    meta = classify_documents(fresh.where(~blank), parsed_replies).where("NOT discard")
    if captions is not None:
        meta = insert_captions(meta, captions)
    chunks, _none = chunk_documents(meta, rules)
    return chunks, empty
