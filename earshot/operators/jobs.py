"""Jobs for outside services: requests, names, completion events, graph identifiers and answers to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import base64_line, first_part, first_present

# What a transcoding and a transcription job ask for.
TRANSCODE = {"segment_seconds": 10, "bitrate": 128_000, "sample_rate": 48_000, "codec": "AAC"}
TRANSCRIBE = {"language": "en-US", "max_speakers": 10}
TERMINAL = ["COMPLETE", "COMPLETED", "ERROR", "FAILED", "CANCELED"]


def job_name(prefix: str, identifier: Column, at_ms: Column) -> Column:
    """A job's name: what it is, the identifier's first part and the time of the request, which the caller gives."""
    return F.concat_ws("-", F.lit(prefix), first_part(identifier), at_ms.cast("string"))


def job_requests(messages: DataFrame, at_ms: Column) -> DataFrame:
    """Two requests, independent of each other, for each message with episode_id and audio_media_id: to transcode and to transcribe."""
    settings = lambda d: F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv])
    source = F.concat(F.lit("raw/"), F.col("audio_media_id"))
    one = lambda kind, d: F.struct(F.lit(kind).alias("kind"), job_name(kind, F.col("episode_id"), at_ms).alias("name"), source.alias("input"), F.concat(F.lit("processed/"), F.col("audio_media_id"), F.lit("/")).alias("output"), settings(d).alias("settings"))
    return messages.where("episode_id IS NOT NULL AND audio_media_id IS NOT NULL").select("episode_id", F.explode(F.array(one("transcode", TRANSCODE), one("transcribe", TRANSCRIBE))).alias("r")).select("episode_id", "r.*")


def completion(events: DataFrame, strict: bool = False) -> DataFrame:
    """Each episode's state from its jobs' terminal events (episode_id, job, status, ts, seq).

    By default the last event tells: a transcription that completes makes the episode complete, any
    failure makes it failed, a transcoding that completes changes nothing, and a later event
    overwrites an earlier one. With ``strict`` an episode is complete only if both jobs' last events
    are, failed if either's isn't, and waiting while one is missing.
    """
    ended = events.where(F.upper("status").isin(*TERMINAL))
    done = F.upper("status").isin("COMPLETE", "COMPLETED")
    place = F.struct("ts", "seq")
    if not strict:
        told = ended.where(~(done & (F.col("job") == "transcode")))
        return told.groupBy("episode_id").agg(F.max_by(F.when(done, F.lit("complete")).otherwise(F.lit("failed")), place).alias("status"))
    last = ended.groupBy("episode_id").pivot("job", ["transcode", "transcribe"]).agg(F.max_by(done, place))
    both = F.col("transcode") & F.col("transcribe")
    return last.select("episode_id", F.when(both, F.lit("complete")).when(F.col("transcode").isNull() & F.coalesce("transcribe", F.lit(True)) | F.col("transcribe").isNull() & F.coalesce("transcode", F.lit(True)), F.lit("waiting")).otherwise(F.lit("failed")).alias("status"))


def graph_id(answer: Column, kind: str, own: Column) -> Column:
    """The identifier that a store gave a record: its job's, its own, else one from ours."""
    return first_present(answer["job_id"], answer["id"], F.concat(F.lit(f"{kind}-"), own.cast("string")))


def ids_in_order(records: DataFrame, key: str, order: str, identifier: str) -> DataFrame:
    """Each key's identifiers in order, as one array; for groups that are small, as an episode's records are."""
    return records.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(identifier).alias("i")))), lambda x: x["i"]).alias("ids"))


def without_items(utterances: Column) -> Column:
    """Utterances of a transcript without their word lists, for a smaller payload."""
    return F.transform(utterances, lambda u: F.struct(*[u[n].alias(n) for n in ("id", "start_time", "end_time", "transcript", "speaker_label")]))


def doubled_label(label: Column, text: Column) -> Column:
    """The first version's content, which names the speaker once more before lines that name them already."""
    return F.concat(label, F.lit(": "), text)


def created_at(published: Column, now: Column) -> Column:
    """When a record counts as made: when its episode was published, else now, which the caller gives."""
    return F.coalesce(published, now)


def response(request: Column, content: Column, content_type: Column) -> Column:
    """The answer to a request for a picture (see ``image_request``): status, headers and the body in base64."""
    status = F.when(request["status"] != 200, request["status"]).when(content.isNull(), 404).otherwise(200)
    ok = status == 200
    headers = F.when(ok, F.create_map(F.lit("Content-Type"), content_type, F.lit("Cache-Control"), F.lit("public, max-age=31536000, immutable")))
    return F.struct(status.alias("status"), headers.alias("headers"), F.when(ok, base64_line(content)).alias("body"), ok.alias("is_base64"))
