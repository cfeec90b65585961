"""Messages delivered more than once: one copy of each is kept.

:func:`surplus` works on one table of deliveries. :func:`fold_batch` is the incremental form over a
history in partitions of time. An identifier index tells which partitions hold earlier copies of a
batch's messages; only those are read, combined with the incoming messages, given new winners and
written anew, and all of it is put in place at once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def canonical_id(raw: Column) -> Column:
    """One spelling of an identifier: UUIDs in any notation (case, braces, ``urn:uuid:``, without
    dashes, surrounded by blanks) become 32 lower-case digits; other texts lose outer white space
    and their case. Null where nothing is left."""
    bare = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}\x00-\x1f\x{feff}\x{200b}]+|[\s\p{Z}\x00-\x1f\x{feff}\x{200b}]+$", ""))
    inner = F.regexp_replace(F.regexp_replace(bare, r"^(?:urn:)?(?:uuid:)?", ""), r"[{}()\-\s]", "")
    return F.when(inner.rlike("^[0-9a-f]{32}$"), inner).when(bare != "", bare)


def _winner(order: Sequence[str], row: Sequence[str]) -> Column:
    # A null instant comes after every other, so that min() prefers a known one.
    parts = [x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c).alias(f"_o_{c}"))]
    return F.min(F.struct(*parts, *[F.col(c).alias(f"_r_{c}") for c in row if c not in order]))


def surplus(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    """The rows that are further copies of a message.

    ``keys`` identify a message, ``order`` is its order of preference (smallest first, nulls last),
    ``row_id`` is a unique column. A row with a null in any key is a copy of nothing. Winners come
    from a map-side minimum per message, so a message delivered any number of times is no hot task;
    the join back is on the message's keys, where AQE splits a hot one. Returns ``df``'s columns.
    """
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.groupBy(*keys).agg(_winner(order, [row_id]).alias("_w"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    field = f"_o_{row_id}" if row_id in order else f"_r_{row_id}"
    best = best.select(*[F.col(k).alias(f"_b_{i}") for i, k in enumerate(keys)], F.col(f"_w.{field}").alias("_kept"))
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & (known[k] == best[f"_b_{i}"])
    return known.join(best, condition).where(~F.col(row_id).eqNullSafe(F.col("_kept"))).select(*df.columns)


def first_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per message: the first by ``order``; rows with a null key are all kept.

    The winner is chosen by a map-side minimum over whole rows, without a sort. Rows that tie in
    everything are one row.
    """
    rest = [c for c in df.columns if c not in order]
    known, unknown = df, df
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    known, unknown = df.where(~missing), df.where(missing)
    best = known.groupBy(*[F.col(k).alias(f"_g_{i}") for i, k in enumerate(keys)]).agg(_winner(order, rest).alias("_w"))
    kept = best.select(*[F.col(f"_w._o_{c}" if c in order else f"_w._r_{c}").alias(c) for c in df.columns])
    return kept.unionByName(unknown)


#: Pieces that a message's copies fall into before a winner is chosen, so that none of them is a hot task.
_SALTS = 64
_INDEX = StructType([StructField("_id", LongType()), StructField("_in", StringType())])


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, history: str) -> tuple[int, dict]:
    """The number and the content of the newest manifest; (0, {}) for a new table.

    The content has "partitions" (each partition's folders), "surplus" (folders), "replaced" (folders
    that only an earlier manifest has) and "schema".
    """
    files, path = _files(spark, history), spark._jvm.org.apache.hadoop.fs.Path
    if not files.exists(path(history)):
        return 0, {}
    numbers = [int(m[1]) for s in files.listStatus(path(history)) if (m := re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()))]
    if not numbers:
        return 0, {}
    newest = max(numbers)
    text = "".join(r[0] for r in spark.read.text(f"{history}/manifest-{newest}.json").collect())  # one line
    if not text.endswith("}"):
        raise RuntimeError("another batch is being added at this time")
    return newest, json.loads(text)


def _read(spark: SparkSession, history: str, schema: StructType, folders: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{history}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read_once(spark: SparkSession, history: str) -> DataFrame:
    """The single copies that :func:`fold_batch` keeps at ``history``."""
    _, content = _manifest(spark, history)
    return _read(spark, history, StructType.fromJson(content["schema"]), [f for folders in content["partitions"].values() for f in folders])


def read_surplus(spark: SparkSession, history: str) -> DataFrame:
    """The further copies that :func:`fold_batch` found, each once, in whatever batches they came."""
    _, content = _manifest(spark, history)
    return _read(spark, history, StructType.fromJson(content["schema"]), content["surplus"]).dropDuplicates()


def _places(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``_kept``: true for a message's one winner, false for its other copies; equal rows are one.

    Copies are placed within salted pieces of their message, and then the pieces' winners among
    themselves, so that a message with a third of all deliveries is no hot task.
    """
    every = [*[F.col(c).asc_nulls_last() for c in order], *[c for c in columns if c not in order]]
    # Without an identifier a row is a copy only of equal rows.
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    message = [*keys, "_whole"]
    rows = rows.withColumn("_whole", F.when(missing, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))).withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(_SALTS)).cast("int"))
    piece = Window.partitionBy(*message, "_salt").orderBy(*every)
    rows = rows.withColumn("_n", F.row_number().over(piece)).withColumn("_r", F.rank().over(piece))
    # Winners of pieces meet under a null salt; the others stay where they are.
    rows = rows.withColumn("_salt", F.when(F.col("_n") > 1, F.col("_salt")))
    whole = Window.partitionBy(*message, "_salt").orderBy(*every)
    first = F.col("_n") == 1
    rows = rows.withColumn("_place", F.row_number().over(whole))
    # A row equal to the winner is dropped, any other is surplus.
    kept = F.when(first & (F.col("_place") == 1), True).when(first | (F.col("_r") > 1), False)
    return rows.withColumn("_kept", kept).where("_kept IS NOT NULL").drop("_whole", "_salt", "_n", "_r", "_place")


def fold_batch(spark: SparkSession, history: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], partition: str) -> list[str]:
    """Adds a batch of deliveries to the table of single copies at ``history``; returns the partitions written anew.

    ``keys`` identify a message, ``order`` is its order of preference (smallest first, nulls last, then
    by the other columns), ``partition`` an SQL expression for the partition of a row, best one of its
    time. The identifier index are two columns of the partitions' files, ``_id`` (a hash of the keys) and
    ``_in`` (the partition), which are read alone: it tells which partitions hold copies of the batch's messages. Those are read whole and
    combined with the batch, winners are computed again, and each winner goes to its own partition.
    Partitions with copies are replaced, others only get new files beside their old ones.

    One manifest, created only if no other writer has created it, puts everything in place, so a
    reader sees the table before the batch or after it, and a job that dies leaves the table as it
    was. Replaced files stay for the readers of the manifest before and are removed by the next
    batch. Adding a batch twice changes nothing. Rows with a null key identify no message: they are
    all kept, equal rows once. The first batch founds the table, if it is empty too; any other empty
    batch writes nothing. The schema must stay the same for one table; names that begin with "_" aren't allowed.
    """
    columns = batch.columns
    number, content = _manifest(spark, history)
    identity = F.xxhash64(*keys)
    marked = batch.withColumn("_part", F.coalesce(F.expr(partition).cast("string"), F.lit("none")))
    old: dict[str, list[str]] = content.get("partitions", {})
    touched: list[str] = []
    if old:
        index = _read(spark, history, _INDEX, [f for folders in old.values() for f in folders])
        held = index.join(batch.select(identity.alias("_id")).distinct(), "_id", "left_semi")
        touched = sorted(r[0] for r in held.select("_in").distinct().collect())  # at most as many as partitions
    rows = marked
    if touched:
        earlier = _read(spark, history, batch.schema, [f for part in touched for f in old[part]])
        rows = marked.unionByName(earlier.withColumn("_part", F.coalesce(F.expr(partition).cast("string"), F.lit("none"))))
    name = f"data/{uuid.uuid4().hex}"
    placed = _places(rows, keys, order, columns).withColumn("_id", identity).withColumn("_in", F.col("_part"))
    # Partitions of any size are written by as many tasks as they need.
    placed.hint("rebalance", "_kept", "_part").write.partitionBy("_kept", "_part").parquet(f"{history}/{name}")
    files, path = _files(spark, history), spark._jvm.org.apache.hadoop.fs.Path
    below = lambda kept: [s.getPath().getName() for s in files.listStatus(path(f"{history}/{name}/_kept={kept}"))] if files.exists(path(f"{history}/{name}/_kept={kept}")) else []
    written = below("true")
    lost = [f"{name}/_kept=false/{f}" for f in below("false")]
    if number and not written and not lost:
        return []
    now = {part: folders for part, folders in old.items() if part not in touched}
    for folder in written:
        part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.partition("=")[2])
        now.setdefault(part, [])
        now[part] = [*now[part], f"{name}/_kept=true/{folder}"]
    replaced = [f for part in touched for f in old[part]]
    done = {"partitions": now, "surplus": [*content.get("surplus", []), *lost], "replaced": replaced, "schema": json.loads(batch.schema.json())}
    try:
        out = files.create(path(f"{history}/manifest-{number + 1}.json"), False)
    except Py4JJavaError as e:
        raise RuntimeError("another batch was added at the same time; add this one again") from e
    out.write(bytearray(json.dumps(done).encode()))
    out.close()
    for folder in content.get("replaced", []):
        files.delete(path(f"{history}/{folder}"), True)
    return touched


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system and all below it."""
    _files(spark, folder).delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
