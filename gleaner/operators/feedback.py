"""Feedback and its reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import or_blank, strip

# Review actions.
FEEDBACK_ACTIONS = ("open", "acknowledged", "resolved", "dismissed")
PAIR_ACTIONS = ("accept", "reject")


def latest_review(reviews: DataFrame) -> DataFrame:
    """Last review per feedback id; blank ids are dropped."""
    rows = reviews.withColumn("feedback_id", strip(or_blank(F.col("feedback_id")))).where("feedback_id <> ''")
    rest = [c for c in reviews.columns if c != "feedback_id"]
    return (rows.groupBy("feedback_id").agg(F.max_by(F.struct(*rest), "line_no").alias("r"))
            .select("feedback_id", *[F.col(f"r.{c}").alias(c) for c in rest]))


def feedback_with_reviews(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Feedback with the status of its last review (``open`` without one)."""
    fid = F.coalesce(F.nullif("feedback_id", F.lit("")),
                     F.concat_ws(":", or_blank(F.col("query_id")), or_blank(F.col("timestamp_text")), F.col("line_no").cast("string")))
    last = latest_review(reviews).select("feedback_id", F.col("action").alias("review_status"), F.col("timestamp_text").alias("reviewed_at"))
    return (feedback.withColumn("feedback_id", fid).join(last, "feedback_id", "left")
            .withColumn("review_status", F.coalesce("review_status", F.lit("open"))))


def feedback_page(rows: DataFrame, rating: str | None = None, status: str | None = None,
                  offset: int = 0, limit: int = 20) -> DataFrame:
    """One page, newest first (earlier lines first among equals), with the total before paging."""
    keep: Column = F.lit(True)
    if rating:
        keep = keep & (F.col("rating") == rating)
    if status:
        keep = keep & (F.col("review_status") == status)
    found = rows.where(keep)
    total = found.agg(F.count("*")).scalar()
    page = found.orderBy(F.desc(or_blank(F.col("timestamp_text"))), "line_no").offset(offset).limit(limit)
    return page.withColumn("total", total)


def validate_reviews(reviews: DataFrame, allowed: tuple[str, ...] = FEEDBACK_ACTIONS) -> tuple[DataFrame, DataFrame]:
    """(accepted reviews with a clean action, rejected ones)."""
    clean = reviews.withColumn("action", F.lower(strip(or_blank(F.col("action")))))
    good = F.col("action").isin(*allowed)
    return clean.where(good), clean.where(~good)
