"""Queries that run a stream to its end over several files of a table, one in each batch, and return what it left.

Their SQL is that of the batch: a stream must leave the same. The folders of a stream are removed
when its result has been written down.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.once import canonical_id, read_surplus, remove
from ..session import checkpointed, shared_folder
from ..sources.tables import table
from ..streaming import pipelines as P
from .general import P5_FOUND


#: Files that a table is parted into for a stream.
_FILES = 4


def _run(spark: SparkSession, folder: str, name: str, order: str, start: Callable[[DataFrame, str], StreamingQuery], result: Callable[[str], DataFrame]) -> DataFrame:
    """Parts a table by ``order`` into files that arrive one after the other, and runs a stream over them, a file in each batch.

    ``start`` gets the stream and its folder, ``result`` the folder when the stream has come to its end.
    """
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    try:
        rows = table(spark, folder, name)
        low, high = rows.agg(F.min(order), F.max(order)).first()
        part = F.lit(0) if low is None else F.coalesce(F.least(F.floor((F.col(order) - F.lit(low)) * _FILES / F.lit(max(high - low, 1))), F.lit(_FILES - 1)), F.lit(0))
        for i in range(_FILES):  # in this order, which is that of the files' ages
            rows.where(part == i).coalesce(1).write.mode("append").parquet(f"{place}/in")
        start(P.tables(spark, f"{place}/in", rows.schema, files_per_batch=1), place).awaitTermination()
        return checkpointed(result(place))
    finally:
        remove(spark, place)


def _written(stream: DataFrame, place: str) -> StreamingQuery:
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start()


def streaming_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last event, from a stream of the events; every batch writes its keys' new states, and the last written counts."""

    def start(stream: DataFrame, place: str) -> StreamingQuery:
        return _written(P.latest(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", ["ts", "event_id"]), place)

    def result(place: str) -> DataFrame:
        return spark.read.schema("user_id bigint, event_type string, epoch bigint").parquet(f"{place}/out").groupBy("user_id").agg(F.max_by("event_type", "epoch").alias("event_type"))

    return _run(spark, folder, "events", "event_id", start, result)


_STATUS = {"signup": "pending", "view": "downloading", "click": "processing", "purchase": "complete", "error": "failed"}
_ALLOWED = {"pending": ["downloading"], "downloading": ["processing"], "processing": ["complete"], "complete": ["pending"], "failed": ["pending"]}


def streaming_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's state by a machine that ignores what it doesn't allow, from a stream of the events in order."""
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])

    def start(stream: DataFrame, place: str) -> StreamingQuery:
        events = stream.select(F.col("user_id").cast("string").alias("key"), F.try_element_at(status, F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
        return _written(P.transitions(events, _ALLOWED, "pending"), place)

    def result(place: str) -> DataFrame:
        written = spark.read.schema("key string, status string, n_ignored bigint, n_late bigint, epoch bigint").parquet(f"{place}/out")
        return written.groupBy("key").agg(F.max_by(F.struct("status", "n_ignored", "n_late"), "epoch").alias("s")).select("key", "s.*")

    return _run(spark, folder, "events", "event_id", start, result)


_MOVES = " OR ".join(f"(m.status = '{a}' AND n.status = '{b}')" for a, to in _ALLOWED.items() for b in to)
MACHINE = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT user_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
m AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS status, 0::BIGINT AS n_ignored FROM n
  UNION ALL
  SELECT m.user_id, n.i, CASE WHEN n.status = 'failed' OR {_MOVES} THEN n.status ELSE m.status END, m.n_ignored + CASE WHEN n.status = 'failed' OR {_MOVES} THEN 0 ELSE 1 END FROM m JOIN n ON n.user_id = m.user_id AND n.i = m.i + 1)
SELECT user_id::VARCHAR AS key, arg_max(status, i) AS status, arg_max(n_ignored, i) AS n_ignored, 0 AS n_late FROM m GROUP BY ALL"""


def streaming_once(spark: SparkSession, folder: str) -> DataFrame:
    """The surplus deliveries, from a stream that keeps one copy of each message."""
    raw = F.when(F.col("queue_name") == "processing", F.col("audio_media_id")).otherwise(F.col("episode_id"))

    def start(stream: DataFrame, place: str) -> StreamingQuery:
        sink = P.keep_once(f"{place}/once", ["queue_name", "message"], ["received_at", "delivery_id"], "date_format(received_at, 'yyyy-MM')")
        rows = stream.select("delivery_id", "queue_name", canonical_id(raw).alias("message"), "received_at")
        return rows.writeStream.option("checkpointLocation", f"{place}/state").foreachBatch(sink).trigger(availableNow=True).start()

    return _run(spark, folder, "queue_messages", "delivery_id", start, lambda place: read_surplus(spark, f"{place}/once").select("delivery_id"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events in windows of a day of event time (the batch form of the stream)."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.windowed(events, "ts", "event_type", "1 day", "1 hour", F.lit(1)).select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n")


QUERIES = {"streaming_status": streaming_status, "streaming_machine": streaming_machine, "streaming_once": streaming_once, "event_windows": event_windows}
SQL = {
    "streaming_status": "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY ALL",
    "streaming_machine": MACHINE,
    "streaming_once": P5_FOUND,
    "event_windows": "SELECT floor(epoch(ts))::BIGINT // 86400 * 86400 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
