"""Records for a knowledge graph: segments with their context, transcript and metadata, in pieces, and chunks of one speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import ellipsize, minutes_label
from .jobs import created_at, doubled_label
from .models import chunk_context, segment_context
from .texts import split_greedy

#: A segment's measures.
METRICS = ["lucidity", "polarity", "arousal", "subjectivity", "humor"]
#: How a chunk's message tells where it comes from.
CHUNK_SOURCE = 'Podcast transcript chunk %d/%d from "%s" (%s). Time: %s - %s. Context: %s'


def _clock(ms: Column) -> Column:
    return minutes_label(ms / 1000)


def segment_records(segments: DataFrame, group: str, now: Column, limit: int = 5000) -> DataFrame:
    """One row per piece of each segment's text: episode_id, record_id, piece, type, name, data, group_id, created_at, source_description and metadata (JSON).

    ``segments``: segment_id, segment_type, chapter_id, start_ms, the metrics, series_id, series_title,
    episode_id, episode_title, published_at, context (a model's answer, or null), transcript (lines
    with speakers' names, null for none), audio (its utterances as stored, in order, null for none),
    actual_start_ms and actual_end_ms (null for none, which counts as 0). Segments without a title of
    series or episode count as untitled. Only the first piece carries the utterances.
    """
    title = lambda c: F.coalesce(F.col(c), F.lit("Untitled"))
    rows = segments.withColumn("_series", title("series_title")).withColumn("_episode", title("episode_title"))
    rows = rows.withColumn("_a", F.coalesce("actual_start_ms", F.lit(0))).withColumn("_b", F.coalesce("actual_end_ms", F.lit(0)))
    context = segment_context(F.col("context"), F.col("_series"), F.col("_episode"), F.col("segment_type"), _clock(F.col("start_ms")))
    data = F.concat(F.lit("<document>\n<context>"), context, F.lit("</context>\n<transcript>\n"), F.coalesce("transcript", F.lit("")), F.lit("\n</transcript>\n</document>"))
    kept = [c for c in rows.columns if c not in ("context", "transcript")]
    pieces = split_greedy(rows.select(*kept, data.alias("_data")), "_data", kept, limit, limit * 7 // 10)
    own = F.when(F.col("pieces") > 1, F.concat_ws("-", "segment_id", F.lit("chunk"), "piece")).otherwise(F.col("segment_id"))
    span = F.concat_ws(" - ", _clock(F.col("_a")), _clock(F.col("_b")))
    said = F.when(F.col("piece") == 0, F.coalesce("audio", F.array().cast(rows.schema["audio"].dataType))).otherwise(F.array().cast(rows.schema["audio"].dataType))
    metadata = F.struct(
        "series_id", F.col("_series").alias("series_title"), "episode_id", F.col("_episode").alias("episode_title"), own.alias("segment_id"), "segment_type", "chapter_id",
        (F.col("_a") / 1000).alias("episode_start_sec"), (F.col("_b") / 1000).alias("episode_end_sec"), *METRICS, said.alias("audio_segments"),
    )
    return pieces.select(
        "episode_id", own.alias("record_id"), "piece", F.lit("json").alias("type"),
        F.concat_ws(" - ", ellipsize(F.col("_series"), 12), ellipsize(F.col("_episode"), 15), F.concat_ws("-", _clock(F.col("_a")), _clock(F.col("_b")))).alias("name"),
        F.col("text").alias("data"), F.lit(group).alias("group_id"), created_at(F.col("published_at"), now).alias("created_at"),
        F.concat_ws(", ", "_series", "_episode", F.concat(F.lit("segment "), own), span).alias("source_description"),
        F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"),
    )


def chunk_messages(chunks: DataFrame, group: str, now: Column) -> DataFrame:
    """One message per chunk of a speaker: content, role, timestamp, source_description and metadata (JSON).

    ``chunks``: label, text, start_ms, end_ms, chunk_index, total_chunks, series_id, series_title,
    episode_id, episode_title and context (a model's answer, or null).
    """
    context = chunk_context(F.col("context"), F.col("series_title"), F.col("episode_title"), F.col("label"))
    told = F.format_string(CHUNK_SOURCE, F.col("chunk_index") + 1, F.col("total_chunks"), F.col("episode_title"), F.col("series_title"), _clock(F.col("start_ms")), _clock(F.col("end_ms")), context)
    metadata = F.struct(
        "series_id", "series_title", "episode_id", "episode_title", F.col("label").alias("speaker_label"), (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"),
        "chunk_index", "total_chunks", context.alias("context_summary"),
    )
    return chunks.select("episode_id", "chunk_index", F.lit(group).alias("group_id"), doubled_label(F.col("label"), F.col("text")).alias("content"), F.lit("user").alias("role_type"), F.col("label").alias("role"), now.alias("timestamp"), told.alias("source_description"), F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"))
