"""Operations on an episode's utterances: labels, samples, timelines, runs and chunks.

Utterances are rows of episode_id, ord (their order is data), label, text, start_ms and end_ms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compat import clamp, clock_ms, cut, half_up, line_of, minutes_label, present
from .scans import lagged, ordinals, running_sum

STRETCH_MS = 1_800_000


def utterances(segments: DataFrame, text: bool = True, label: bool = True, ordered: bool = True, raw: bool = False) -> DataFrame:
    """Transcript rows as utterances: each segment_id once (the first ingested), numbered by start, end and id (``ord``).

    Rows without a segment_id are an utterance each. Leave out what isn't needed: without ``text`` no
    text is read and moved, without ``ordered`` utterances aren't numbered. ``raw`` adds the columns as
    stored: start_time, end_time, transcript and speaker_label.
    """
    columns = ["episode_id", "start_time", "end_time", *["transcript"] * (text or raw), *["speaker_label"] * (label or raw)]
    own = F.when(F.col("segment_id").isNull(), F.monotonically_increasing_id())
    single = segments.groupBy("segment_id", own.alias("_own")).agg(F.min(F.struct("ingested_at", *columns)).alias("r")).select("segment_id", "r.*").drop("ingested_at")
    rows = single.withColumn("start_ms", clock_ms(F.col("start_time"))).withColumn("end_ms", clock_ms(F.col("end_time")))
    made = ["episode_id", "segment_id", "start_ms", "end_ms"]
    if text:
        rows, made = rows.withColumn("text", F.coalesce("transcript", F.lit(""))), [*made, "text"]
    if label:
        rows, made = rows.withColumn("label", F.coalesce(present(F.trim("speaker_label")), F.lit("unknown"))), [*made, "label"]
    rows = rows.select(*made, *["start_time", "end_time", "transcript", "speaker_label"] * raw)
    if not ordered:
        return rows
    block = F.coalesce(F.floor(F.col("start_ms") / STRETCH_MS).cast("bigint"), F.lit(2**40))
    return ordinals(rows.withColumn("_block", block), ["episode_id"], "_block", [F.col("start_ms").asc_nulls_last(), F.col("end_ms").asc_nulls_last(), "segment_id"]).drop("_block")


def times(segments: DataFrame) -> DataFrame:
    """Where the rows of a transcript are, copies too: episode_id, start_ms and end_ms."""
    return segments.select("episode_id", clock_ms(F.col("start_time")).alias("start_ms"), clock_ms(F.col("end_time")).alias("end_ms"))


def labels_in_order(rows: DataFrame) -> DataFrame:
    """Each episode's distinct labels in the order of their first utterance: episode_id, label, first_ord, place (from 0)."""
    first = rows.groupBy("episode_id", "label").agg(F.min("ord").alias("first_ord"))
    return first.withColumn("place", (F.row_number().over(Window.partitionBy("episode_id").orderBy("first_ord")) - 1).cast("bigint"))


def default_speakers(labels: DataFrame) -> DataFrame:
    """Names and roles for labels nobody has named: spk_0 is the host, the others are numbered."""
    number = F.regexp_replace("label", "spk_", "")
    host = F.col("label") == "spk_0"
    return labels.withColumn("name", F.when(host, F.lit("Host")).otherwise(F.concat(F.lit("Speaker "), number))).withColumn("role", F.when(host, F.lit("host")).otherwise(F.lit("unknown")))


def fill_speakers(labels: DataFrame, known: DataFrame) -> DataFrame:
    """The known speakers of an episode, and numbered ones for its labels that are missing from them.

    ``known``: episode_id, label, name, role; a label listed twice keeps its last row by ``place``.
    """
    last = known.groupBy("episode_id", "label").agg(F.max_by(F.struct("name", "role"), "place").alias("s")).select("episode_id", "label", "s.name", "s.role", F.lit(True).alias("listed"))
    missing = labels.join(last, ["episode_id", "label"], "left_anti").select("episode_id", "label", F.concat(F.lit("Speaker "), F.regexp_replace("label", "spk_", "")).alias("name"), F.lit("unknown").alias("role"), F.lit(False).alias("listed"))
    return last.unionByName(missing)


def samples(rows: DataFrame, k: int = 5, size: int = 200) -> DataFrame:
    """Each speaker's first ``k`` utterances in order, cut to ``size`` characters."""
    w = Window.partitionBy("episode_id", "label").orderBy("ord")
    return rows.withColumn("sample", F.row_number().over(w).cast("bigint")).where(F.col("sample") <= k).select("episode_id", "label", "sample", cut(F.col("text"), size).alias("text"))


def durations(rows: DataFrame) -> DataFrame:
    """Each episode's length: the latest end of an utterance."""
    return rows.groupBy("episode_id").agg(F.max("end_ms").alias("duration_ms"))


def targets(lengths: DataFrame) -> DataFrame:
    """How many chapters (one in four minutes, 5 to 15) and segments (40 an hour, 20 to 60) an episode should have."""
    minutes, hours = F.col("duration_ms") / 60_000.0, F.col("duration_ms") / 3_600_000.0
    return lengths.select("episode_id", "duration_ms", clamp(half_up(minutes / 4), 5, 15).cast("bigint").alias("chapters"), clamp(half_up(hours * 40), 20, 60).cast("bigint").alias("segments"))


def part_of_target(start_ms: Column, end_ms: Column, duration_ms: Column, target: Column) -> Column:
    """A chapter's part of the episode's target, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), half_up((end_ms - start_ms) / duration_ms * target))


def named(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Utterances with their speaker's name; the label stands in for a missing or empty one."""
    return rows.join(speakers.select("episode_id", "label", F.col("name").alias("_name")), ["episode_id", "label"], "left").withColumn("name", F.coalesce(present(F.col("_name")), F.col("label"))).drop("_name")


def _in_order(text: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), text.alias("t")))), lambda x: x["t"]), glue)


def timeline(rows: DataFrame, block_ms: int = 30_000, size: int = 300) -> DataFrame:
    """One line per block of time with speech: ``[m:ss] text``, the block's utterances joined and cut. Rows need a name."""
    block = F.floor(F.col("start_ms") / block_ms).cast("bigint")
    blocks = rows.where("start_ms >= 0").groupBy("episode_id", block.alias("block")).agg(_in_order(line_of(F.col("name"), F.col("text")), " ").alias("text"))
    return blocks.select("episode_id", "block", minutes_label(F.col("block") * (block_ms // 1000)).alias("label"), cut(F.col("text"), size).alias("text"))


def excerpts(pairs: DataFrame, key: str, text: Column | None = None, glue: str = " ") -> DataFrame:
    """The joined text of each range's utterances, from the pairs of an interval join."""
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_utterances"), _in_order(F.col("text") if text is None else text, glue).alias("excerpt"))


def actual_ranges(ranges: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """From the first utterance's start to the last one's end, by order and not by time; (0, 0) for a range without any."""
    found = pairs.groupBy(key).agg(F.min_by("start_ms", "ord").alias("s"), F.max_by("end_ms", "ord").alias("e"))
    return ranges.select(key).distinct().join(found, key, "left").select(key, F.coalesce("s", F.lit(0)).alias("actual_start_ms"), F.coalesce("e", F.lit(0)).alias("actual_end_ms"))


_CHUNK = T.StructType([T.StructField("episode_id", T.StringType()), T.StructField("first_ord", T.LongType()), T.StructField("label", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("text", T.StringType())])


def speaker_chunks(rows: DataFrame, limit: int = 4000, block: int = 10_000) -> DataFrame:
    """Consecutive utterances of one speaker as chunks of ``label: text`` lines, about ``limit`` characters at most.

    A new chunk begins with the first utterance, with another speaker, and where the chunk's length
    and the line's together exceed the limit (the line break isn't counted in that check); so a
    single longer line is a chunk of its own. The fold starts anew with each speaker, so runs of one
    speaker are what is distributed, and within a task rows are folded as they stream by; the runs
    themselves are found in blocks of ``block`` utterances.
    """
    blocks = rows.withColumn("_block", F.floor(F.col("ord") / block))
    before = lagged(blocks, ["episode_id"], "_block", "ord", "label", "_previous")
    change = (~F.col("_previous").eqNullSafe(F.col("label"))).cast("bigint")
    runs = running_sum(before, ["episode_id"], "_block", ["ord"], change, "_run")
    ordered = runs.select("episode_id", "_run", "ord", "label", "text", "start_ms", "end_ms").repartition(F.col("episode_id"), F.col("_run")).sortWithinPartitions("episode_id", "_run", "ord")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        head: list = []
        lines: list[str] = []
        size = 0
        done: list[tuple] = []

        def close() -> None:
            if lines:
                done.append((*head, len(lines), "\n".join(lines)))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for episode, run, order, label, text, start, end in zip(*columns, strict=True):
                line = f"{label}: {text}"
                if key != (episode, run) or size + len(line) > limit:
                    close()
                    key, head, lines, size = (episode, run), [episode, order, label, start, end], [line], len(line)
                else:
                    lines.append(line)
                    size += 1 + len(line)
                    head[4] = end
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=_CHUNK.names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=_CHUNK.names)

    return ordered.mapInArrow(fold, _CHUNK)


def survivors(chunks: DataFrame, order: str, dropped: Column) -> DataFrame:
    """Ordinals of the chunks that aren't dropped: chunk_index counts those kept before, total_chunks is all less those dropped so far."""
    w = Window.partitionBy("episode_id").orderBy(order)
    out = F.coalesce(dropped, F.lit(False)).cast("int")
    marked = chunks.withColumn("_out", out)
    counted = marked.withColumn("chunk_index", F.coalesce(F.sum(1 - F.col("_out")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    counted = counted.withColumn("total_chunks", (F.count(F.lit(1)).over(Window.partitionBy("episode_id")) - F.sum("_out").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("bigint"))
    return counted.where("_out = 0").drop("_out")
