"""Scans of feeds, transcript files, queues and blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.feeds import HEADER, ITEM
from ..session import ship

TRANSCRIPT = T.StructType(
    [
        T.StructField("results", T.StructType([T.StructField("audio_segments", T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("id", "start_time", "end_time", "transcript", "speaker_label")], T.StructField("items", T.ArrayType(T.IntegerType()))])))])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of feed files, one row each, with the attributes of elements as ``_name``."""
    ship(spark)
    return spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "false").schema(ITEM).load(path)


def parse_item(xml: Column) -> Column:
    """One item's XML as a struct."""
    return F.from_xml(xml, ITEM.json(), {"ignoreNamespace": "false"})


def feed_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header of feed files: one row each, without the items, and ``xml``, the channel's text, for what nests to any depth."""
    ship(spark)
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml"))
    # What belongs to an item is no part of the header.
    header = F.regexp_replace("xml", r"(?s)<item[\s>].*?</item>", "")
    return raw.select("file", header.alias("xml")).withColumn("c", F.from_xml(F.regexp_extract("xml", r"(?s)(<channel[\s>].*</channel>)", 1), HEADER.json(), {"ignoreNamespace": "false"})).select("file", "c.*", "xml")


def transcript_files(spark: SparkSession, path: str, medium: str = r"processed/([^/]+)/") -> DataFrame:
    """Utterances of transcript files with their file, media_id and place (their order is data).

    ``medium`` is the pattern of the medium in a file's path. A file that is no transcript gives one
    row with a null utterance and ``error``.
    """
    ship(spark)
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    parsed = raw.select("file", F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    error = F.when(F.col("d.results.audio_segments").isNull(), F.lit("no transcript"))
    rows = parsed.select("file", F.regexp_extract("file", medium, 1).alias("media_id"), error.alias("error"), F.posexplode_outer("d.results.audio_segments").alias("ord", "u"))
    return rows.select("file", "media_id", "error", F.col("ord").cast("bigint").alias("ord"), "u.id", "u.start_time", "u.end_time", "u.transcript", "u.speaker_label")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content: path, length, modificationTime, content."""
    return spark.read.format("binaryFile").load(path)


def blob_with_fallback(wanted: DataFrame, available: DataFrame, key: str = "media_id", kind: str = "format") -> DataFrame:
    """Each wanted picture's base file: ``path``, and ``error`` where there is none.

    ``wanted`` has a medium (``key``) and the format that is wanted, ``available`` the store's ``path``s.
    webp has no base of its own and is made from jpg; a missing jpg falls back to png; a missing png
    is an error. One join on the medium, whose files are told apart by name.
    """
    pattern = r"processed/([^/]+)/base\.(jpg|png)$"
    name, have = F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)
    files = available.where(name != "").groupBy(name.alias("_m")).agg(*[F.min(F.when(have == k, F.col("path"))).alias(f"_{k}") for k in ("jpg", "png")])
    joined = wanted.join(files, F.col(key) == F.col("_m"), "left")
    path = F.when(F.col(kind) == "png", F.col("_png")).otherwise(F.coalesce("_jpg", "_png"))
    return joined.withColumn("path", path).withColumn("error", F.when(F.col("path").isNull(), F.lit("no such picture"))).drop("_m", "_jpg", "_png")


def messages(body: Column, schema: str) -> Column:
    """A queue message's JSON body; null fields where it isn't readable."""
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})
