"""Oversized texts cut into pieces under a limit, at natural boundaries, with an overlap.

Sizes are prefix sums over a text's units (code points, or token counts given by the caller), and
the places where it may be cut are one sorted array per kind of boundary: ends of paragraphs, of
sentences, of clauses, of words. The next cut is found by binary search: the last boundary of the
best kind whose piece is under the limit and not less than a least size; a hard cut if there is
none. The next piece begins at the first boundary of a word at least ``overlap`` units before the cut.

:func:`covered_texts` builds the texts that time ranges cover, of oversized ranges only: lengths
are found first, from a join on slices of time that moves numbers and no text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import sliced
from ..session import checkpointed
from .encode import _in_parts
from .sentences import sentences

_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r|\u2028|\u2029|\x85)+")
_CLAUSE = re.compile(r"[,;:،、，；：·–—)\]」』»”]+(?=\s|[\u3000-鿿＀-￯])")
_WORD = re.compile(r"\s+")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted places where a text may be cut, the best kind first: after paragraphs, sentences, clauses, words."""
    ends = np.array([b for _, b in sentences(text)], np.int64)
    return [
        np.fromiter((m.end() for m in _PARAGRAPH.finditer(text)), np.int64),
        ends,
        np.fromiter((m.end() for m in _CLAUSE.finditer(text)), np.int64),
        np.fromiter((m.end() for m in _WORD.finditer(text)), np.int64),
    ]


def cuts(text: str, limit: int, overlap: int = 0, least: float = 0.5, sizes: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Pieces of a text as (start, end, kind of the boundary at the end), none larger than ``limit``.

    ``sizes`` has the size of each code point (1 each by default). A piece ends at the best boundary
    that leaves it at least ``least`` times the limit, the last of that kind; without any it is cut
    hard, but not between the halves of a composed character. Consecutive pieces share at most
    ``overlap`` units (whole words if possible), and each goes on beyond the one before it. A text
    within the limit is one piece, an empty one none. A single code point larger than the limit is a
    piece of its own. Pieces cover the text without a gap.
    """
    n = len(text)
    if not n:
        return []
    offsets = np.arange(n + 1) if sizes is None else np.concatenate(([0], np.cumsum(sizes)))
    if offsets[-1] <= limit:
        return [(0, n, "whole")]
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("the overlap must be less than the limit")
    kinds = boundaries(text)
    words = kinds[-1]
    names = ("paragraph", "sentence", "clause", "word")
    found: list[tuple[int, int, str]] = []
    start, done = 0, 0
    while True:
        if offsets[n] - offsets[start] <= limit:
            found.append((start, n, "whole"))
            return found
        # The furthest end, and the nearest that is large enough and goes beyond the last piece.
        far = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        near = max(int(np.searchsorted(offsets, offsets[start] + least * limit, "left")), done + 1, start + 1)
        end, kind = 0, "hard"
        for places, name in zip(kinds, names, strict=True):
            i = int(np.searchsorted(places, far, "right")) - 1
            if i >= 0 and places[i] >= near:
                end, kind = int(places[i]), name
                break
        if not end:
            end = max(far, start + 1)
            step = end
            while step > start + 1 and _joined(text, step):
                step -= 1
            if step > max(start, done) and not _joined(text, step):
                end = step
        found.append((start, end, kind))
        done = end
        if overlap:
            back = int(np.searchsorted(offsets, offsets[end] - overlap, "left"))
            i = int(np.searchsorted(words, back, "left"))
            start = int(words[i]) if i < len(words) and words[i] < end else back
            start = min(max(start, found[-1][0] + 1), end)
            while start < end and _joined(text, start):
                start += 1
        else:
            start = end


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a composed character."""
    return at < len(text) and (unicodedata.combining(text[at]) != 0 or unicodedata.category(text[at]) in ("Mn", "Me", "Mc") or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d" or "🏻" <= text[at] <= "🏿")


def split_texts(df: DataFrame, text: str, keep: Sequence[str], limit: int = 4000, overlap: int = 200, only_oversized: bool = True, part_bytes: int = 4 << 20) -> DataFrame:
    """The pieces of each row's text: ``keep``, ``piece`` (from 0), ``start_char``, ``end_char``, ``cut`` and ``text``.

    ``cut`` is the kind of boundary at the piece's end: 'paragraph', 'sentence', 'clause', 'word',
    'hard', or 'whole' for the last. With ``only_oversized`` texts within the limit give no row,
    else one; null and empty texts never give any. Repeated rows give their pieces each time.
    """
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    if only_oversized:
        rows = rows.where(F.char_length("_text") > limit)
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*kept, T.StructField("piece", T.IntegerType(), False), T.StructField("start_char", T.LongType(), False), T.StructField("end_char", T.LongType(), False), T.StructField("cut", T.StringType(), False), T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch, "_text", part_bytes):
                index, out = [], []
                for i, t in enumerate(part.column("_text").to_pylist()):
                    for j, (a, b, kind) in enumerate(cuts(t or "", limit, overlap)):
                        index.append(i)
                        out.append((j, a, b, kind, t[a:b]))
                take = pa.array(index, pa.int64())
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name).take(take) for f in kept), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def covered_texts(utterances: DataFrame, ranges: DataFrame, limit: int = 4000, slice_ms: int = 300_000, most_sent: int = 200_000) -> DataFrame:
    """The joined texts of the ranges whose text is longer than ``limit``: ``range_id`` and ``text``.

    ``utterances``: group_id, utterance_id, start_ms, end_ms, text; ``ranges``: group_id, range_id,
    start_ms, end_ms. A range covers the utterances of its group that start at or after its start
    and end at or before its end; each utterance_id counts once (its copies are equal) and each row
    without one by itself, null and empty texts don't count, texts are joined by one blank in the order of start, end and utterance_id. Ranges with a null bound or
    an end not after the start are none; a range_id that occurs again is the same range.

    Utterances and ranges meet in slices of time, so a group with a large part of all rows is many
    small keys; a range has rows only for slices that exist (see :func:`sliced`). Lengths are summed
    first, without text. What is left, the slices of ranges that prove too long, is written down; if
    that is at most ``most_sent`` rows they are sent to where the text is, so that only covered texts are
    shuffled, and beyond that both are shuffled by group and slice.
    """
    spans = ranges.where("group_id IS NOT NULL AND end_ms > start_ms").select("group_id", "range_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms")).dropDuplicates()
    # A row without an identifier is nobody's copy.
    own = F.when(F.col("utterance_id").isNull(), F.monotonically_increasing_id())
    said = utterances.where("group_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND text <> ''").withColumn("slice", F.expr(f"CAST(floor(start_ms / {slice_ms}) AS BIGINT)")).withColumn("own", own)
    single = said.groupBy("group_id", "slice", "utterance_id", "own").agg(F.min("start_ms").alias("start_ms"), F.min("end_ms").alias("end_ms"), F.min(F.char_length("text")).alias("n"))
    slices = sliced(spans, "group_id", said.select("group_id", "slice").distinct(), slice_ms, "slice").select(F.col("group_id").alias("g"), F.col("slice").alias("sl"), "range_id", F.col("a_ms").alias("a"), F.col("b_ms").alias("b"))
    inside = (F.col("g") == F.col("group_id")) & (F.col("sl") == F.col("slice")) & (F.col("start_ms") >= F.col("a")) & (F.col("end_ms") <= F.col("b"))
    # By range and slice, so that what is needed of each slice is known without cutting ranges again.
    parts = single.join(slices, inside).groupBy("range_id", "g", "a", "b", "sl").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("range_id", "g", "a", "b")
    needed = checkpointed(parts.withColumn("length", F.sum("n").over(whole) + F.sum("k").over(whole) - 1).where(F.col("length") > limit).select("range_id", "g", "a", "b", "sl"))
    few = needed.limit(most_sent + 1).count() <= most_sent
    texts = said.join(F.broadcast(needed) if few else needed, inside).groupBy("range_id", "g", "a", "b", "utterance_id", "own").agg(F.min(F.struct("start_ms", "end_ms", "utterance_id", "text")).alias("u"))
    return texts.groupBy("range_id", "g", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda u: u["text"]), " ").alias("text")).select("range_id", "text")
