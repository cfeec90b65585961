"""Greedy splitting of long texts for a store with a size limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space at the ends of a piece.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def greedy_pieces(text: str, limit: int = 5000, least: int = 3500) -> list[str]:
    """A text within the limit as it is; else pieces cut after the last full stop and blank that begins
    at or before the limit and after ``least``, else at the last blank there, else hard at the limit.
    Pieces of a longer text have no white space at their ends."""
    if len(text) <= limit:
        return [text]
    out, rest = [], text
    while rest:
        if len(rest) <= limit:
            out.append(rest)
            break
        at = rest.rfind(". ", 0, limit + 2)
        if at > least:
            at += 1
        else:
            at = rest.rfind(" ", 0, limit + 1)
            if at <= least:
                at = limit
        out.append(rest[:at].strip(BLANKS))
        rest = rest[at:].strip(BLANKS)
    return out


def split_greedy(df: DataFrame, text: str, keep: Sequence[str], limit: int = 5000, least: int = 3500) -> DataFrame:
    """``keep``, ``piece`` (from 0), ``pieces`` (of the text) and ``text``; null texts give no row."""
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("piece", T.LongType()), T.StructField("pieces", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                index, number, total, texts = [], [], [], []
                for i, t in enumerate(part.column("_text").to_pylist()):
                    found = greedy_pieces(t, limit, least)
                    index += [i] * len(found)
                    number += range(len(found))
                    total += [len(found)] * len(found)
                    texts += found
                take = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in keep), pa.array(number, pa.int64()), pa.array(total, pa.int64()), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
