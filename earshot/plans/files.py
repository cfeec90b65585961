"""Queries that write files as an outside system would, scan them and remove them, with the SQL of what they must give."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feeds as E
from ..operators import jobs as J
from ..operators.once import remove
from ..session import checkpointed, shared_folder
from ..sources import media
from ..sources.sinks import publish
from ..sources.tables import table
from ..streaming import pipelines as P


def _scanned(spark: SparkSession, write: Callable[[str], None], scan: Callable[[str], DataFrame]) -> DataFrame:
    """What ``scan`` reads of the files that ``write`` makes in a folder of their own, which is removed afterwards."""
    place = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    try:
        write(place)
        return checkpointed(scan(place))
    finally:
        remove(spark, place)


def transcript_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts written as one JSON file for each episode and read back, without their word lists, in the files' order."""
    rows = table(spark, folder, "transcript_segments").where("episode_id IS NOT NULL").select("episode_id", "segment_id", "start_time", "end_time", "transcript", "speaker_label", "ingested_at")
    one = F.struct("ingested_at", F.col("segment_id").alias("id"), "start_time", "end_time", "transcript", "speaker_label", F.array(F.lit(1), F.lit(2)).alias("items"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("ingested_at"))
    files = rows.groupBy("episode_id").agg(F.to_json(F.struct(F.struct(listed.alias("audio_segments")).alias("results"))).alias("value"))

    def write(place: str) -> None:
        files.withColumn("processed", F.col("episode_id")).select("processed", "value").write.partitionBy("processed").text(place)

    def scan(place: str) -> DataFrame:
        found = media.transcript_files(spark, f"{place}/*/*.txt", r"processed=([^/]+)/")
        small = found.withColumn("u", F.element_at(J.without_items(F.array(F.struct("id", "start_time", "end_time", "transcript", "speaker_label"))), 1))
        return small.select(F.col("media_id").alias("episode_id"), "ord", "u.id", "u.start_time", "u.end_time", "u.transcript", "u.speaker_label", "error")

    return _scanned(spark, write, scan)


TRANSCRIPT_FILES = """SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY ingested_at NULLS FIRST, segment_id NULLS FIRST, start_time NULLS FIRST, end_time NULLS FIRST, transcript NULLS FIRST, speaker_label NULLS FIRST) - 1 AS ord,
  segment_id AS id, start_time, end_time, transcript, speaker_label, NULL AS error FROM transcript_segments WHERE episode_id IS NOT NULL"""


def queue_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries published as JSON lines by queue, read back as a stream; a line that isn't JSON keeps its text."""
    rows = table(spark, folder, "queue_messages").select("queue_name", F.col("delivery_id").alias("deliveryId"), F.col("episode_id").alias("episodeId"), F.col("audio_media_id").alias("audioMediaId"))

    def write(place: str) -> None:
        publish(rows.where("queue_name IS NOT NULL"), ["deliveryId", "episodeId", "audioMediaId"], f"{place}/in")
        spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{place}/in/queue_name=broken")

    def scan(place: str) -> DataFrame:
        stream = P.queue(spark, f"{place}/in/*", "deliveryId bigint, episodeId string, audioMediaId string", files_per_batch=4)
        sink = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")
        stream.writeStream.option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema("deliveryId bigint, episodeId string, audioMediaId string, raw string").parquet(f"{place}/out/*")
        return found.select(F.col("deliveryId").alias("delivery_id"), F.col("episodeId").alias("episode_id"), F.col("audioMediaId").alias("audio_media_id"), F.when(F.col("deliveryId").isNull(), F.col("raw")).alias("unreadable"))

    return _scanned(spark, write, scan)


QUEUE_JSON = "SELECT delivery_id, episode_id, audio_media_id, NULL AS unreadable FROM queue_messages WHERE queue_name IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, '{broken'"


def event_bus_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Events of two services' jobs that a rule lets through: of each service those in its terminal states."""
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, F.lit("transcode")).otherwise(F.lit("transcribe")).alias("source"), F.upper("event_type").alias("status"))
    return P.matching(rows, "transcode", ["PURCHASE", "ERROR"]).unionByName(P.matching(rows, "transcribe", ["CLICK"]))


EVENT_BUS = "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'transcode' ELSE 'transcribe' END AS source, upper(event_type) AS status FROM events WHERE (user_id % 2 = 0 AND event_type IN ('purchase', 'error')) OR (user_id % 2 = 1 AND event_type = 'click')"


def feed_header_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds written as XML files, header and an item with a title of its own, and their headers read back as rows of series."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), escape(c), F.lit(f"</{name}>"))).otherwise(F.lit(""))
    series = table(spark, folder, "podcast_series").where("series_id IS NOT NULL")
    xml = F.concat(
        F.lit('<rss xmlns:itunes="x"><channel>'), tag("title", F.col("title")), tag("description", F.col("description")), tag("language", F.col("lang_code")), tag("itunes:author", F.col("author")), tag("itunes:type", F.col("series_type")),
        F.lit("<itunes:explicit>yes</itunes:explicit><image><url>"), escape(F.coalesce("image_url", F.lit(""))), F.lit('</url></image><itunes:category text="Arts"><itunes:category text="Books"/></itunes:category><itunes:owner><itunes:name>'),
        escape(F.coalesce("author", F.lit(""))), F.lit("</itunes:name></itunes:owner><item><title>An item</title><description>of its own</description></item></channel></rss>"),
    )

    def write(place: str) -> None:
        series.select(F.col("series_id").alias("feed"), xml.alias("value")).write.partitionBy("feed").text(place)

    def scan(place: str) -> DataFrame:
        h = media.feed_headers(spark, f"{place}/*/*.txt")
        feed = {
            "title": F.trim("title"), "description": F.trim("description"), "summary": F.col("`itunes:summary`"), "itunes_image": F.col("`itunes:image`._href"), "image_url": F.col("image.url"), "author": F.trim("`itunes:author`"),
            "owner_name": F.trim("`itunes:owner`.`itunes:name`"), "language": F.trim("language"), "series_type": F.col("`itunes:type`"), "explicit": F.col("`itunes:explicit`"), "categories": E.category_names(F.col("xml")),
        }
        made = h.select(F.regexp_extract("file", r"feed=([^/]+)/", 1).alias("series_id"), *E.series_row(feed, F.lit("an old title")))
        return made.withColumn("categories", F.array_join("categories", ">"))

    return _scanned(spark, write, scan)


FEED_HEADERS = """SELECT series_id, coalesce(nullif(trim(title), ''), 'an old title') AS title, nullif(trim(description), '') AS description, nullif(image_url, '') AS image_url, 'Arts>Books' AS categories, true AS explicit,
  CASE WHEN series_type = 'serial' THEN 'serial' ELSE 'episodic' END AS series_type, nullif(trim(author), '') AS author, nullif(trim(author), '') AS owner_name, nullif(trim(lang_code), '') AS language FROM podcast_series WHERE series_id IS NOT NULL"""

QUERIES = {"transcript_file_scan": transcript_file_scan, "queue_json_scan": queue_json_scan, "event_bus_filter": event_bus_filter, "feed_header_scan": feed_header_scan}
SQL = {"transcript_file_scan": TRANSCRIPT_FILES, "queue_json_scan": QUEUE_JSON, "event_bus_filter": EVENT_BUS, "feed_header_scan": FEED_HEADERS}
