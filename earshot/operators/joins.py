"""Joins of utterances with time ranges, and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``; give an order without ties for a repeatable result.

    Only the first row of each key in a task goes through the shuffle, for the filter on the row number is a limit per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: A range that touches more slices than this isn't cut into all of them.
MOST_SLICES = 1024
#: The slice in which points that touch more than MOST_SLICES meet their key's ranges.
_WIDE = -(2**62)


def _slice(at: Column, size: int) -> Column:
    return F.floor(at / size).cast("bigint")


def _slices(a: Column, b: Column, size: int) -> Column:
    return F.sequence(_slice(a, size), F.greatest(_slice(a, size), _slice(b, size)))


def sliced(ranges: DataFrame, key: str, occupied: DataFrame, slice_ms: int, name: str = "_sl", also: int | None = None) -> DataFrame:
    """A row for each slice of time that a range (``key``, a_ms, b_ms) touches.

    A range that touches more than :data:`MOST_SLICES` has rows only for those slices that are
    ``occupied`` (distinct rows of ``key`` and ``name``), so no range makes more rows than there are
    slices with anything in them, however far away its end is. Every range also has a row for the
    slice ``also``, if that is given; then the keys of ``occupied`` must have it too.
    """
    low, high = _slice(F.col("a_ms"), slice_ms), _slice(F.col("b_ms"), slice_ms)
    known = ranges.where("a_ms IS NOT NULL AND b_ms IS NOT NULL").withColumn("_narrow", high - low < MOST_SLICES)
    there = occupied.select(F.col(key).alias("_o_key"), F.col(name).alias("_o_slice"))
    touched = (F.col("_o_slice") >= low) & (F.col("_o_slice") <= high)
    if also is not None:
        touched = touched | (F.col("_o_slice") == also)
    joined = known.join(there, ~F.col("_narrow") & (F.col(key) == F.col("_o_key")) & touched, "left")
    own = _slices(F.col("a_ms"), F.col("b_ms"), slice_ms)
    if also is not None:
        own = F.concat(own, F.array(F.lit(also)))
    every = F.when(F.col("_narrow"), own).when(F.col("_o_slice").isNotNull(), F.array("_o_slice"))
    return joined.withColumn(name, F.explode(every)).drop("_narrow", "_o_key", "_o_slice")


def interval_join(points: DataFrame, ranges: DataFrame, key: str, how: str, slice_ms: int = 300_000, times: DataFrame | None = None) -> DataFrame:
    """Pairs of a point's row and a range's row of one key that meet by ``how``:

    'containment': start >= a and end <= b; 'start_in': a <= start < b; 'overlap': start < b and
    end > a, touching ends don't count.

    ``points`` has start_ms and end_ms, ``ranges`` a_ms and b_ms (other columns of the two must have
    different names). Both meet in slices of time, so a key with many rows is many small keys and a
    range meets only rows near it; a pair that shares several slices is found in one of them. What
    is far too long for that, as a mistaken end makes it, meets the slices that have any rows, or for
    a point its key's ranges. ``times`` may give the points' key, start_ms and end_ms more cheaply
    than ``points`` do (more rows don't matter). Rows with a null bound or key meet nothing.
    """
    known = "start_ms IS NOT NULL AND end_ms IS NOT NULL"
    rows, cheap = points.where(known), (points if times is None else times).where(known).select(key, "start_ms", "end_ms")
    at = _slice(F.col("start_ms"), slice_ms)
    # The pair counts in the first slice that both have.
    first = F.col("_p") == F.greatest(at, _slice(F.col("a_ms"), slice_ms))
    if how == "overlap":
        short = _slice(F.col("end_ms"), slice_ms) - at < MOST_SLICES
        own = F.when(short, _slices(F.col("start_ms"), F.col("end_ms"), slice_ms))
        rows = rows.withColumn("_p", F.explode(F.coalesce(own, F.array(F.lit(_WIDE)))))
        cheap = cheap.withColumn("_p", F.explode(F.concat(F.coalesce(own, F.array().cast("array<bigint>")), F.array(F.lit(_WIDE)))))
        meets = (F.col("start_ms") < F.col("b_ms")) & (F.col("end_ms") > F.col("a_ms")) & (first | (F.col("_p") == _WIDE))
    else:
        rows, cheap = (df.withColumn("_p", at) for df in (rows, cheap))
        meets = {
            "containment": (F.col("start_ms") >= F.col("a_ms")) & (F.col("end_ms") <= F.col("b_ms")),
            "start_in": (F.col("start_ms") >= F.col("a_ms")) & (F.col("start_ms") < F.col("b_ms")),
        }[how]
    spans = sliced(ranges, key, cheap.select(key, F.col("_p").alias("_sl")).distinct(), slice_ms, also=_WIDE if how == "overlap" else None).withColumnRenamed(key, "_key")
    return rows.join(spans, (F.col(key) == F.col("_key")) & (F.col("_p") == F.col("_sl")) & meets).drop("_key", "_p", "_sl")
