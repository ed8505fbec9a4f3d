"""The request limit as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.usage import DEFAULT_LIMIT, HEAVY_LIMIT, WINDOW_S
from gleaner.schemas import REQUEST
from gleaner.session import scratch_path

OUTPUT_SCHEMA = "client bigint, heavy boolean, event_id bigint, denied boolean"


def rate_limit_stream(requests: DataFrame, limit: int = DEFAULT_LIMIT, heavy_limit: int = HEAVY_LIMIT,
                      window_s: int = WINDOW_S) -> DataFrame:
    """Requests of a stream with ``denied``, decided in time order per client and class.

    State per key is the time stamps of accepted requests within the window, ``limit`` at
    most. Requests are ordered within a micro-batch; batches are taken in arrival order.
    """
    width = window_s * 1_000_000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        allowed = heavy_limit if key[1] else limit
        denied = []
        for t in rows["t"]:
            accepted = [a for a in accepted if a >= t - width]
            denied.append(len(accepted) >= allowed)
            if not denied[-1]:
                accepted.append(int(t))
        state.update((accepted,))
        yield pd.DataFrame({"client": key[0], "heavy": key[1], "event_id": rows["event_id"].to_numpy(), "denied": denied})

    at = requests.select("client", "heavy", "event_id", F.unix_micros("ts").alias("t"))
    return at.groupBy("client", "heavy").applyInPandasWithState(
        decide, OUTPUT_SCHEMA, "accepted array<bigint>", "append", GroupStateTimeout.NoTimeout)


def replay_rate_limit(requests: DataFrame, **limits: int) -> DataFrame:
    """Write a request log, run the stateful stream over it, read its decisions."""
    spark = requests.sparkSession
    log, out, state = (scratch_path(spark, n) for n in ("request-log", "decisions", "limit-state"))
    requests.select("client", F.col("ts").cast("timestamp").alias("ts"), "event_id", "heavy").write.parquet(log)
    stream = spark.readStream.schema(REQUEST).parquet(log)
    query = (rate_limit_stream(stream, **limits).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", state).trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out)
