"""Overlapping and gapped intervals: continuous periods per key, and the gaps between them.

A sweep line: every interval becomes a +1 event at its start and a -1 event at its end, events at
one instant are added up, and the running sum tells where a covered period begins and ends.

A key may hold a large part of all rows, so the sweep is made in two levels. Events are summed per
(key, instant) before the shuffle; the running sum is a sum over blocks of time plus a sum within
a block, so that no task sorts a whole key; and the few periods that cross a block's border are
joined by their block's first and last boundary only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole_ms(seconds: Column) -> Column:
    """Seconds as a whole number of milliseconds, null where missing, not a number or not finite."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e15))
    return F.when(ok, F.floor(F.when(ok, seconds) * F.lit(1000.0) + F.lit(0.5)).cast("bigint"))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, block_ms: int = 3_600_000) -> DataFrame:
    """Maximal periods covered by intervals and the gaps between consecutive ones, per key.

    ``start`` and ``end`` name whole-number columns (see :func:`whole_ms`). Rows with a null bound or
    with an end that isn't after its start are ignored; nothing is clipped, negative instants count.
    Touching intervals make one period; repeated rows change nothing. A null key is a key like any
    other. An empty table gives an empty result. Other columns are ignored, whatever their names.

    Returns ``keys``, ``kind`` ('period' or 'gap'), ``start_ms`` and ``end_ms``. ``block_ms`` is the
    length of time that one task sweeps at a time; it doesn't change the result.
    """
    # One column for all keys, which is never null itself: joins and windows on it share one partitioning.
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k") if keys else F.struct(F.lit(0).alias("k0")).alias("_k")
    ranges = df.select(key, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e")).where(F.col("_e") > F.col("_s"))
    events = (
        ranges.select("_k", F.explode(F.array(F.struct(F.col("_s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("at"), F.lit(-1).alias("d")))).alias("_v"))
        .select("_k", F.col("_v.at").alias("_at"), F.col("_v.d").cast("bigint").alias("_d"))
        # Never null, as the planner should know: else it filters one of two equal inputs, and computes both.
        .withColumn("_b", F.expr(f"COALESCE(_at div {block_ms} - IF(_at % {block_ms} < 0, 1, 0), 0)"))
        .groupBy("_k", "_b", "_at")
        .agg(F.sum("_d").alias("_d"))
    )
    # How many intervals are open when a block begins: blocks are few, whatever the number of rows.
    in_order = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opened = events.groupBy("_k", "_b").agg(F.sum("_d").alias("_n")).select("_k", "_b", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_open"))
    within = Window.partitionBy("_k", "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.join(opened, ["_k", "_b"]).withColumn("_after", F.col("_open") + F.sum("_d").over(within)).withColumn("_before", F.col("_after") - F.col("_d"))
    # Boundaries alternate: a period begins, ends, begins ... A begin at the instant of an end has been summed away.
    edges = counted.where((F.col("_before") == 0) != (F.col("_after") == 0)).select("_k", "_b", "_at", (F.col("_after") > 0).alias("_begins"))
    block = Window.partitionBy("_k", "_b").orderBy("_at")
    paired = edges.withColumn("_next", F.lead("_at").over(block)).withColumn("_first", F.lag("_at").over(block).isNull())
    inside = paired.where(F.col("_next").isNotNull()).select("_k", "_begins", "_at", "_next")
    # Each block's last boundary goes on to the first boundary of the key's next block that has any.
    blocks = Window.partitionBy("_k").orderBy("_at")
    ends = paired.where(F.col("_first") | F.col("_next").isNull())
    across = ends.withColumn("_over", F.lead("_at").over(blocks)).where(F.col("_next").isNull() & F.col("_over").isNotNull()).select("_k", "_begins", "_at", F.col("_over").alias("_next"))
    return inside.unionByName(across).select(
        *[F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)],
        F.when(F.col("_begins"), F.lit("period")).otherwise(F.lit("gap")).alias("kind"),
        F.col("_at").alias("start_ms"),
        F.col("_next").alias("end_ms"),
    )
