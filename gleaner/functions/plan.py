"""Steering where Spark computes columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *computed: str) -> DataFrame:
    """Compute the named columns here, once.

    A filter on a computed column is otherwise moved towards the scan by putting the whole
    expression in its place, which then runs twice; conditions on generated columns stay put.
    """
    rest = [c for c in df.columns if c not in computed]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*computed)))).select(*df.columns)
