import json
import os
import time

from pyspark.sql import functions as F

from earshot.operators.once import read_once
from earshot.streaming import pipelines as P

SCHEMA = "key string, status string, ts timestamp, seq bigint"


def drain(df, tmp_path, sink, mode="update"):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def write(folder, name, rows):
    """Files arrive in the order of their times, so each is a second younger than the one before."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    at = time.time() - 1000 + len(list(folder.iterdir()))
    os.utime(folder / name, (at, at))


def event(key, status, second, seq):
    return {"key": key, "status": status, "ts": f"2024-01-01T00:00:{second:02}Z", "seq": seq}


def test_machine_and_replay(spark, tmp_path):
    data = tmp_path / "in"
    first = [event("a", "downloading", 1, 1), event("a", "complete", 2, 2), event("a", "processing", 3, 3), event("b", "failed", 1, 4)]
    write(data, "1.json", first)
    write(data, "2.json", first)  # delivered again
    write(data, "3.json", [event("a", "complete", 9, 5), event("b", "downloading", 0, 0)])
    seen = {}
    stream = P.queue(spark, str(data), SCHEMA, files_per_batch=1).drop("raw")
    allowed = {"pending": ["downloading"], "downloading": ["processing"], "processing": ["complete"]}
    drain(P.transitions(stream, allowed, "pending"), tmp_path, lambda batch, _: seen.update({r.key: (r.status, r.n_ignored, r.n_late) for r in batch.collect()}))
    assert seen == {"a": ("complete", 1, 2), "b": ("failed", 0, 1)}


def test_latest_is_that_of_the_table(spark, tmp_path):
    data = tmp_path / "in"
    rows = [event(k, s, t, i) for i, (k, s, t) in enumerate([("a", "x", 5), ("a", "y", 3), ("b", "z", 1), ("a", "w", 5), ("b", "v", 0)])]
    for i, r in enumerate(rows):
        write(data, f"{i}.json", [r])
    (data / "junk.json").write_text("{broken")
    seen = {}
    stream = P.queue(spark, str(data), SCHEMA, files_per_batch=2).where("key IS NOT NULL")
    drain(P.latest(stream, "key", "status", ["ts", "seq"]), tmp_path, lambda batch, _: seen.update({r.key: r.status for r in batch.collect()}))
    table = spark.read.schema(SCHEMA).json([str(data / f"{i}.json") for i in range(5)])
    assert seen == {r.key: r.status for r in P.latest(table, "key", "status", ["ts", "seq"]).collect()} == {"a": "w", "b": "z"}


def test_once(spark, tmp_path):
    data = tmp_path / "in"
    for i in range(3):
        write(data, f"{i}.json", [event(k, "s", 9 - i, 10 * i + j) for j, k in enumerate("abc")])
    home = str(tmp_path / "once")
    drain(P.queue(spark, str(data), SCHEMA, files_per_batch=1).drop("raw"), tmp_path, P.keep_once(home, ["key"], ["ts", "seq"], "date_format(ts, 'mm')"), "append")
    assert sorted((r.key, r.seq) for r in read_once(spark, home).collect()) == [("a", 20), ("b", 21), ("c", 22)]


def test_windows_and_late_rows(spark, tmp_path):
    data = tmp_path / "in"
    write(data, "1.json", [event("a", "s", 1, 1), event("a", "s", 11, 2), event("b", "s", 12, 3)])
    stream = P.queue(spark, str(data), SCHEMA)
    seen = {}
    drain(P.windowed(stream, "ts", "key", "10 seconds", "5 seconds", F.col("seq")), tmp_path, lambda batch, _: seen.update({(r.key, r.window_start.second): (r.n, r.total) for r in batch.collect()}))
    assert seen == {("a", 0): (1, 1), ("a", 10): (1, 2), ("b", 10): (1, 3)}


def test_matching(spark):
    df = spark.createDataFrame([("x", "DONE"), ("x", "RUNNING"), ("y", "DONE")], "source string, status string")
    assert P.matching(df, "x", ["DONE", "FAILED"]).count() == 1
