"""Lengths of time recorded in different units and notations, brought to milliseconds.

The readings of each text come from :mod:`earshot.functions.units`. Where the notation leaves the
unit open, the reading is taken that fits the rest of the row: the size of the audio file, which at
a known range of bit rates gives a range of lengths, or else a length mentioned in the row's text.
Where the row has neither, a source's habit decides, if it is clear, else the notation's usual unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import best, mentioned, readings
from ..session import checkpointed

_RESULT = [
    T.StructField("_ms", T.LongType()),
    T.StructField("_unit", T.StringType()),
    T.StructField("_told", T.BooleanType()),
    T.StructField("_shape", T.StringType()),
    T.StructField("_others", T.MapType(T.StringType(), T.LongType())),
]


def _shape(text: str) -> str:
    return "clock" if ":" in text or "：" in text else "whole" if re.fullmatch(r"\s*\d+\s*", text) else "decimal"


def _number(x: object) -> float | None:
    try:
        v = float(str(x).strip())
    except (TypeError, ValueError):
        return None
    return v if v == v else None


def _read(kept: Sequence[str], kbit: tuple[float, float], least_bytes: int, usual_ms: tuple[int, int]):
    low, high = kbit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Each different text is read once; only what it leaves open is looked at row by row.
            texts = batch.column("_text").dictionary_encode()
            found = [readings(t) for t in texts.dictionary.to_pylist()] + [()]
            at = texts.indices.fill_null(len(found) - 1).to_numpy(zero_copy_only=False)
            settled = [o[0] if len(o) == 1 and o[0].unit == "written" else None for o in found]
            ms = pa.array([r and r.ms for r in settled], pa.int64()).take(pa.array(at)).to_pylist()
            written = np.array([r is not None for r in settled])[at]
            unit = np.where(written, "written", None)
            told, shape, others = np.where(written, True, None), np.full(len(at), None), np.full(len(at), None)
            rows = np.flatnonzero(np.array([r is None and bool(o) for r, o in zip(settled, found, strict=True)])[at])
            some = batch.take(pa.array(rows))
            for i, t, b, c in zip(rows.tolist(), *(some.column(n).to_pylist() for n in ("_text", "_size", "_context")), strict=True):
                options, n = found[at[i]], _number(b)
                has = n is not None and n >= least_bytes
                chosen, sure = best(options, n * 8 / high if has else None, n * 8 / low if has else None, mentioned(c) if not has and len(options) > 1 and isinstance(c, str) else (), usual_ms=usual_ms)
                ms[i], unit[i], told[i] = chosen.ms, chosen.unit, True
                if chosen.unit != "written":
                    told[i], shape[i] = sure, _shape(t)
                    others[i] = None if sure else list({r.unit: r.ms for r in reversed(options) if usual_ms[0] <= r.ms <= usual_ms[1]}.items())
            columns = [pa.array(ms, pa.int64()), pa.array(unit, pa.string()), pa.array(told, pa.bool_()), pa.array(shape, pa.string()), pa.array(list(others), pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], names=[*kept, *(f.name for f in _RESULT)])

    return run


def lengths(
    df: DataFrame,
    text: str,
    size: str,
    context: str,
    source: str,
    keep: Sequence[str],
    kbit: tuple[float, float] = (64.0, 128.0),
    least_bytes: int = 1000,
    usual_ms: tuple[int, int] = (20_000, 21_600_000),
    habit_rows: int = 3,
    habit_share: float = 0.8,
) -> DataFrame:
    """The length in milliseconds that the text column states, with the unit it was read in.

    ``size`` is the audio's size in bytes (a number in any type; null, unreadable and less than
    ``least_bytes`` tell nothing), ``context`` a text that may mention the length, ``source`` the
    column whose rows share a habit of writing. Returns ``keep`` with ``length_ms`` and
    ``length_unit``: 'written' where the notation names the unit, else 'ms', 's', 'min', 'h', 'm:s'
    or 'h:m'. Both are null for a null, empty, unreadable, zero or negative text. A source's habit
    counts if at least ``habit_rows`` of its rows of the same shape (whole figure, decimal figure,
    two-part clock) were told by their own evidence and ``habit_share`` of them in one unit, and if it makes the
    length one of ``usual_ms``.
    Repeated rows each get their result; other columns, whatever their names, are ignored.
    """
    kept = [*[f"_k_{k}" for k in keep], "_source"]
    inputs = df.select(*[F.col(k).alias(f"_k_{k}") for k in keep], F.col(source).alias("_source"), *[F.col(c).cast("string").alias(n) for c, n in ((text, "_text"), (size, "_size"), (context, "_context"))])
    schema = T.StructType([*[f for f in inputs.schema.fields if f.name in kept], *_RESULT])
    # Read once and written down: habits are counted from it before it is judged by them.
    rows = checkpointed(inputs.mapInArrow(_read(kept, kbit, least_bytes, usual_ms), schema))
    # A source's counts are summed before the shuffle: one row for each source, shape and unit.
    seen = rows.where("_told AND _shape IS NOT NULL").groupBy("_source", "_shape", "_unit").agg(F.count(F.lit(1)).alias("_n"))
    habit = (
        seen.groupBy("_source", "_shape")
        .agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "_unit")).alias("_top"))
        .where((F.col("_top._n") >= habit_rows) & (F.col("_top._n") >= habit_share * F.col("_all")))
        .select(F.col("_source").alias("_h_source"), F.col("_shape").alias("_h_shape"), F.col("_top._unit").alias("_h_unit"))
    )
    joined = rows.join(habit, (F.col("_source") == F.col("_h_source")) & (F.col("_shape") == F.col("_h_shape")) & ~F.col("_told"), "left")
    by_habit = F.try_element_at(F.col("_others"), F.col("_h_unit"))
    return joined.select(
        *[F.col(f"_k_{k}").alias(k) for k in keep],
        F.coalesce(by_habit, F.col("_ms")).alias("length_ms"),
        F.when(by_habit.isNotNull(), F.col("_h_unit")).otherwise(F.col("_unit")).alias("length_unit"),
    )
