"""Sinks: messages, blobs and keyed tables; and the settings a job needs."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Names of the places a job reads and writes; a missing required one is an error, a missing optional one None."""

    store: str
    graph: str | None = None

    @staticmethod
    def read(environment: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment
        if not env.get("EARSHOT_STORE"):
            raise ValueError("EARSHOT_STORE isn't set")
        return Settings(env["EARSHOT_STORE"], env.get("EARSHOT_GRAPH") or None)


def publish(messages: DataFrame, columns: Sequence[str], path: str, null_fields: bool = False) -> None:
    """Messages as files of JSON lines, a folder for each queue (column queue_name); with ``null_fields`` nulls are written, else left out."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": str(not null_fields).lower()})
    messages.select("queue_name", body.alias("value")).write.mode("append").partitionBy("queue_name").text(path)


def write_blobs(df: DataFrame, root: str, key: str = "key", content: str = "content") -> DataFrame:
    """Writes each row's content to ``root``/key where the rows are, and returns the keys with their sizes (lazily).

    A row that is written again overwrites itself. Null contents are written nowhere and have a null
    size. ``root`` is a path or an address that Arrow's file systems know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            sizes = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None or k is None:
                    sizes.append(None)
                    continue
                path = f"{base}/{k}"
                store.create_dir(path.rpartition("/")[0])
                with store.open_output_stream(path) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "bytes"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "key string, bytes bigint")
