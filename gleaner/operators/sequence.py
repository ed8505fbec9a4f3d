"""Ordered computations per key that stay spread over tasks.

A plain window puts all rows of a key into one task. Here rows are cut into slots of the
order (hours, page ranges): each (key, slot) is worked on by itself, the slots' summaries
- a few values per slot - are combined per key, and the carried value is joined back.
``slot`` must never decrease along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_struct(order: list[str]) -> Column:
    return F.struct(*order)


def previous(df: DataFrame, keys: list[str], slot: str, order: list[str], cols: list[str]) -> DataFrame:
    """``prev_<col>``: value of ``col`` in the row before, null in the first row of a key."""
    inside = Window.partitionBy(*keys, slot).orderBy(*order)
    last = (df.groupBy(*keys, slot).agg(F.max_by(F.struct(*cols), _order_struct(order)).alias("_last")))
    across = Window.partitionBy(*keys).orderBy(slot)
    carried = last.withColumn("_carry", F.lag("_last").over(across)).drop("_last")
    rows = df.withColumn("_prev", F.lag(F.struct(*cols)).over(inside)).join(carried, [*keys, slot])
    return rows.select(*df.columns, *[F.coalesce(F.col(f"_prev.{c}"), F.when(F.col("_prev").isNull(), F.col(f"_carry.{c}"))).alias(f"prev_{c}")
                                      for c in cols])


def running_sums(df: DataFrame, keys: list[str], slot: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """``values``: name of a new column to the column it sums, up to and including each row."""
    inside = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, slot).agg(*[F.sum(value).alias(f"_s_{out}") for out, value in values.items()])
    carried = sums.select(*keys, slot, *[F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0)).alias(f"_s_{out}") for out in values])
    rows = df.withColumns({out: F.sum(value).over(inside) for out, value in values.items()}).join(carried, [*keys, slot])
    return rows.select(*df.columns, *[(F.col(out) + F.col(f"_s_{out}")).alias(out) for out in values])


def running_sum(df: DataFrame, keys: list[str], slot: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    return running_sums(df, keys, slot, order, {out: value})


def carry_last(df: DataFrame, keys: list[str], slot: str, order: list[str], value: str, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row."""
    inside = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), _order_struct(order))
    lasts = df.groupBy(*keys, slot).agg(F.max_by(value, at).alias("_v"))
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_carry", F.last("_v", ignorenulls=True).over(before)).drop("_v")
    rows = df.withColumn("_local", F.last(value, ignorenulls=True).over(inside)).join(carried, [*keys, slot])
    return rows.withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry")


def with_halo(df: DataFrame, at: str, slot_width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows in their own slot of ``at`` (``_own`` = ``_slot``) and, as context, in the slots that
    lie within ``back`` after or ``ahead`` before them."""
    first, last = F.floor((F.col(at) - ahead) / slot_width), F.floor((F.col(at) + back) / slot_width)
    return df.withColumn("_own", F.floor(F.col(at) / slot_width)).withColumn("_slot", F.explode(F.sequence(first, last)))
