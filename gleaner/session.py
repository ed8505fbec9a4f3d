"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or, where the
    session names none (tests on one machine), a fresh temporary folder set once."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    local = spark.conf.get("spark.gleaner.scratch", None)
    if local is None:
        if not conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        local = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.gleaner.scratch", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, below the shared folder."""
    return os.path.join(shared_dir(spark), "gleaner", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that an iterative plan
    neither grows nor depends on blocks that die with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)      # disk of the shared folder is scarcer than time
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, if its estimated size means fewer scan tasks than cores.

    For work that is heavy per row (parsing, folding, matching) on inputs that come in a few
    files or row groups. Larger inputs are returned as they are: no shuffle is added.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size >= cores * split:
        return df
    return df.repartition(cores, *keys)


ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (of ``rows`` rows) by ``keys`` over as many tasks as hold ``ROWS_PER_TASK`` rows each.

    For chains of sorts and windows, whose memory in a task follows from its rows: a number that
    does not grow with the input gives each task more of them.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)), *keys)
