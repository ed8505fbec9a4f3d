"""Registered queries and their comparison SQL.

SQL here may name inputs as ``@name``: a driver table (``@documents``) or one of the
projections in :mod:`gleaner.plans.inputs` (``@f_chunks``). The same projection text
serves Spark and the comparison engine, so both sides read equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans.inputs import PROJECTIONS, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_REF = re.compile(r"@(\w+)")

# The few constructs whose spelling differs: (Spark, comparison engine).
DIALECT = {
    "one_to_five": ("explode(sequence(1L, 5L))", "unnest(range(1, 6))"),
    "array": ("array", "list_value"),
}


class Source:
    """The given tables and projections of one scale factor, lazily as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in PROJECTIONS:
            return self.sql(PROJECTIONS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(self._resolve(text))

    def _resolve(self, text: str) -> str:
        def ref(m: re.Match) -> str:
            name = m.group(1)
            if name in DIALECT:
                return DIALECT[name][0]
            if name in TABLES:
                return f"parquet.`{self.sf_dir}/{name}.parquet`"
            return f"({self._resolve(PROJECTIONS[name])})"

        return _REF.sub(ref, text)


def comparison_sql(text: str) -> str:
    def ref(m: re.Match) -> str:
        name = m.group(1)
        if name in DIALECT:
            return DIALECT[name][1]
        return name if name in TABLES else f"({comparison_sql(PROJECTIONS[name])})"

    return _REF.sub(ref, text).strip()


def query(name: str, sql: str | None = None):
    """Register ``fn(src) -> DataFrame`` under ``name``, with its comparison SQL."""

    def wrap(fn: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = comparison_sql(sql)
        return fn

    return wrap
