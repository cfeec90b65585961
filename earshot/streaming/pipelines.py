"""Streams of messages and events: parsing, the latest state per key, exactly-once tables and time windows.

Every stream has a batch counterpart over the same rows that gives the same final state; that of
:func:`transitions` only if events come in order from batch to batch, and it counts those that don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.once import fold_batch
from ..session import ship


def queue(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Messages that arrive as files of JSON lines; a line that isn't JSON has nulls, and ``raw`` holds it."""
    ship(spark)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m"), F.col("value").alias("raw")).select("m.*", "raw")


def tables(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder, or the one file that ``path`` names."""
    ship(spark)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(path.rpartition("/")[0])
    return reader.parquet(path)


def matching(events: DataFrame, source: str, statuses: Sequence[str]) -> DataFrame:
    """Events of one source in one of some states."""
    return events.where((F.col("source") == source) & F.col("status").isin(*statuses))


def latest(events: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Each key's value by its last event in ``order``; the same for a stream (update or complete mode) and a table.

    The state is one value per key. The order must tell any two events apart, or a repeated event
    must be equal; then a replayed batch changes nothing.
    """
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def transitions(events: DataFrame, allowed: dict[str, Sequence[str]], start: str, terminal: Sequence[str] = ("failed",)) -> DataFrame:
    """Each key's state by a machine: an event moves it only if the machine allows that, or to a terminal state.

    ``events`` has key, status, ts and seq. Events of a key are taken in order within a batch; one
    that isn't newer than the key's last moves nothing, so replays change nothing, and is counted as
    late unless it is that last event itself. State per key: its status, the last event's place and
    the counts. Returns key, status, n_ignored (not allowed) and n_late, in update mode.
    """
    out, state = "key string, status string, n_ignored bigint, n_late bigint", "status string, ts double, seq bigint, n bigint, late bigint"
    moves = {k: set(v) for k, v in allowed.items()}
    ends = set(terminal)

    def step(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        status, ts, seq, ignored, late = group.get if group.exists else (start, float("-inf"), -1, 0, 0)
        rows = pd.concat([part[["ts", "seq", "status"]] for part in parts], ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        for t, s, x in zip(rows["ts"], rows["seq"].tolist(), rows["status"].tolist(), strict=True):
            place = (t.timestamp(), s)
            if place <= (ts, seq):
                late += place < (ts, seq)
                continue
            ts, seq = place
            if x in ends or x in moves.get(status, ()):
                status = x
            else:
                ignored += 1
        group.update((status, ts, seq, ignored, late))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "n_ignored": [ignored], "n_late": [late]})

    return events.groupBy("key").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def keep_once(history: str, keys: Sequence[str], order: Sequence[str], partition: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that keeps one copy of each message; a batch that runs again changes nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        fold_batch(batch.sparkSession, history, batch, keys, order, partition)

    return sink


def windowed(events: DataFrame, time: str, key: str, size: str, late: str, value: Column) -> DataFrame:
    """Counts and sums in tumbling windows of event time; events later than ``late`` are dropped by a stream."""
    w = F.window(time, size)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), key, "n", "total")
