"""Running sums and ordinals over keys of any size, in two levels.

A running sum over a key is the sum over the blocks before plus the running sum within the block.
Blocks are a coarse form of the order (a stretch of time, a range of numbers), so no task sorts a
whole key: what is sorted per key is one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with the running sum of ``value`` per ``keys`` in ``order``; ``block`` must grow with the order and not be null.

    Rows that tie in the order get their sums in no particular order of each other. Null values
    count as 0; null keys are a key.
    """
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, block)], F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    condition = F.lit(True)
    for c in (*keys, block):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    total = whole if inclusive else whole - F.coalesce(value, F.lit(0))
    return df.join(sums, condition).withColumn(name, total).drop("_before", *[f"_k_{c}" for c in (*keys, block)])


def ordinals(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str], name: str = "ord") -> DataFrame:
    """``df`` with each row's place, from 0, in its key's order."""
    return running_sum(df, keys, block, order, F.lit(1).cast("bigint"), name, inclusive=False)


def lagged(df: DataFrame, keys: Sequence[str], block: str, order: str, column: str, name: str) -> DataFrame:
    """``df`` with the value that ``column`` has in the key's row before, null for a key's first row.

    ``order`` must be unique within a key. As in :func:`running_sum`, a key is sorted block by block;
    a block's first row gets the last value of the block before it.
    """
    last = df.groupBy(*keys, block).agg(F.max_by(F.struct(F.col(column).alias("v")), order).alias("_l"))
    last = last.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, block)], F.lag("_l").over(Window.partitionBy(*keys).orderBy(block)).alias("_before"))
    condition = F.lit(True)
    for c in (*keys, block):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*keys, block).orderBy(order)
    within = F.lag(F.struct(F.col(column).alias("v"))).over(inside)
    return df.join(last, condition).withColumn(name, F.coalesce(within, F.col("_before"))["v"]).drop("_before", *[f"_k_{c}" for c in (*keys, block)])
