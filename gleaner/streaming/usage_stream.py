"""Usage roll-ups over an unbounded cost log (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.usage import usage_by_day
from gleaner.schemas import COST_EVENT
from gleaner.session import scratch_path


def add_batch(batch: DataFrame, number: int, out_path: str) -> None:
    """A micro-batch's own sums per day, in a folder named by its number: a batch that is
    retried overwrites that folder, so every event counts once."""
    usage_by_day(batch).write.mode("overwrite").parquet(f"{out_path}/n={number}")


def run_usage_stream(spark, log_path: str, out_path: str, checkpoint: str) -> None:
    """Process what the log holds now and stop (one trigger of a continuous job).

    No state is kept between batches and no watermark closes a day: an event counts however
    late it comes, and one without a time stamp counts for the day ``unknown``, as in the
    batch roll-up.
    """
    stream = spark.readStream.schema(COST_EVENT).json(log_path)

    query = (stream.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(lambda batch, number: add_batch(batch, number, out_path)).start())
    query.awaitTermination()


def day_totals(spark, out_path: str) -> DataFrame:
    """Cost and events per day over all batches so far."""
    parts = spark.read.parquet(out_path)
    return parts.groupBy("date").agg(F.sum("cost").alias("cost"), F.sum("events").alias("events"))


def replay_usage_by_day(events: DataFrame) -> DataFrame:
    """Write a cost log, run the streaming job over it, read the days back."""
    spark = events.sparkSession
    log, out, state = (scratch_path(spark, n) for n in ("cost-log", "cost-days", "cost-state"))
    names = [f.split()[0] for f in COST_EVENT.split(", ")]
    events.select(*names).write.json(log)
    run_usage_stream(spark, log, out, state)
    return day_totals(spark, out)
