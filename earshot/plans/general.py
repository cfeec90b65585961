"""Queries of the general data problems (1, 2 and 5), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import periods_and_gaps, whole_ms
from ..operators.once import canonical_id, fold_batch, read_surplus, remove
from ..operators.units import lengths
from ..session import checkpointed, shared_folder
from ..sources.tables import table


def p1_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Every feed item with its length in milliseconds and the unit it was read in."""
    return lengths(table(spark, folder, "feed_items"), "itunes_duration", "enclosure_length", "content_snippet", "series_id", ["item_row_id", "itunes_duration"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items whose length is stated otherwise than by a plain whole number of seconds."""
    plain = F.col("itunes_duration").rlike(r"^[0-9]+\z") & (F.col("length_unit") == "s")
    return p1_lengths(spark, folder).where(F.col("length_ms").isNotNull() & ~plain).select("item_row_id", F.col("length_ms").alias("duration_ms"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Covered periods and gaps of every episode's chapters and segments, in one sweep over both tables."""
    parts = [
        table(spark, folder, f"{layer}_results").select(F.lit(layer).alias("layer"), "episode_id", whole_ms(F.col("start_sec")).alias("s"), whole_ms(F.col("end_sec")).alias("e"))
        for layer in ("chapter", "segment")
    ]
    return periods_and_gaps(parts[0].unionByName(parts[1]), ["layer", "episode_id"], "s", "e").select("layer", "kind", "episode_id", "start_ms", "end_ms")


P2_FOUND = """
WITH r AS (
  SELECT layer, episode_id, CAST(floor(a * 1000.0 + 0.5) AS BIGINT) s, CAST(floor(b * 1000.0 + 0.5) AS BIGINT) e FROM (
    SELECT 'chapter' layer, episode_id, start_sec a, end_sec b FROM chapter_results
    UNION ALL SELECT 'segment', episode_id, start_sec, end_sec FROM segment_results)
  WHERE a IS NOT NULL AND b IS NOT NULL AND isfinite(a) AND isfinite(b)
), m AS (
  SELECT *, max(e) OVER (PARTITION BY layer, episode_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) last_e FROM r WHERE e > s
), g AS (
  SELECT *, sum(CASE WHEN last_e IS NULL OR s > last_e THEN 1 ELSE 0 END) OVER (PARTITION BY layer, episode_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM m
), p AS (
  SELECT layer, episode_id, i, min(s) s, max(e) e FROM g GROUP BY ALL
), n AS (
  SELECT *, lead(s) OVER (PARTITION BY layer, episode_id ORDER BY s) next_s FROM p
)
SELECT layer, 'period' kind, episode_id, s start_ms, e end_ms FROM n
UNION ALL SELECT layer, 'gap', episode_id, e, next_s FROM n WHERE next_s IS NOT NULL
"""


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("queue_name") == "processing", F.col("audio_media_id")).otherwise(F.col("episode_id"))
    return table(spark, folder, "queue_messages").select("delivery_id", "queue_name", canonical_id(raw).alias("message"), "received_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surplus deliveries: those that the table of single copies didn't keep.

    The table is made as it would be day by day: the first batch (deliveries of the earlier three
    quarters of the time span) founds it, the second is folded in by the identifier index. It is
    removed when its surplus has been written down.
    """
    rows = _deliveries(spark, folder)
    home = f"{shared_folder(spark).rstrip('/')}/once-{uuid.uuid4().hex}"
    t = F.col("received_at").cast("timestamp").cast("double")
    low, high = table(spark, folder, "queue_messages").agg(F.min(t), F.max(t)).first()
    split = None if low is None else low + 0.75 * (high - low)
    late = F.coalesce(t > F.lit(split), F.lit(False))
    for batch in (rows.where(~late), rows.where(late)):
        fold_batch(spark, home, batch, ["queue_name", "message"], ["received_at", "delivery_id"], "date_format(received_at, 'yyyy-MM')")
    found = checkpointed(read_surplus(spark, home).select("delivery_id"))
    remove(spark, home)
    return found


P5_FOUND = """
WITH d AS (
  SELECT delivery_id, queue_name, received_at,
    lower(regexp_replace(CASE WHEN queue_name = 'processing' THEN audio_media_id ELSE episode_id END, '^\\s+|\\s+$', '', 'g')) raw
  FROM queue_messages
), k AS (
  SELECT *, CASE WHEN regexp_full_match(regexp_replace(regexp_replace(raw, '^(urn:)?(uuid:)?', ''), '[{}()\\-\\s]', '', 'g'), '[0-9a-f]{32}')
    THEN regexp_replace(regexp_replace(raw, '^(urn:)?(uuid:)?', ''), '[{}()\\-\\s]', '', 'g') WHEN raw <> '' THEN raw END id FROM d
)
SELECT delivery_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY queue_name, id ORDER BY received_at NULLS LAST, delivery_id) n
  FROM k WHERE id IS NOT NULL AND queue_name IS NOT NULL) WHERE n > 1
"""

QUERIES = {"p1_found": p1_found, "p1_lengths": p1_lengths, "p2_found": p2_found, "p5_found": p5_found}
SQL = {"p2_found": P2_FOUND, "p5_found": P5_FOUND}
