"""Cheap filter in front of a join: rows whose id cannot match are dropped before work is done on them.

The ids to keep set bits of a bitmap of fixed size, which is sent to every task. A bit that is set
by chance lets a row pass that the exact join behind drops; with more ids than bits all rows pass,
and the join does the whole work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22             # half a megabyte; at most as many slot numbers reach the driver


def _slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column.cast("bigint")), F.lit(BITS)).cast("int")


def sifter(ids: DataFrame) -> tuple[Broadcast, Callable[[Column], Column]]:
    """(bitmap of ``ids`` (one bigint column), slot column of an id). Tasks test ``may_match``."""
    slots = ids.select(_slot(F.col(ids.columns[0])).alias("slot")).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)
    bits = np.zeros(BITS, dtype=bool)
    bits[slots] = True
    return ids.sparkSession.sparkContext.broadcast(np.packbits(bits)), _slot


def may_match(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """False where an id is certainly not among those of the bitmap."""
    at = slots.astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
