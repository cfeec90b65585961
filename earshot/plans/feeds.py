"""Queries over feeds, episodes, queues and events, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat as K
from ..operators import feeds as E
from ..operators import jobs as J
from ..operators.chapters import stable_id
from ..operators.joins import first_match
from ..operators.models import palette_roles as roles
from ..operators.once import canonical_id
from ..sources.media import blob_with_fallback, messages, parse_item
from ..sources.tables import table


def _item(c=F.col) -> dict:
    return {
        "guid": c("guid"), "link": c("link"), "title": c("title"), "description": c("content_snippet"), "enclosure_url": c("enclosure_url"), "enclosure_type": c("enclosure_type"), "enclosure_length": c("enclosure_length"),
        "image_url": c("itunes_image_href"), "duration": c("itunes_duration"), "pub_date": c("pub_date"), "episode": c("itunes_episode"), "season": c("itunes_season"), "episode_type": c("itunes_episode_type"), "explicit": c("itunes_explicit"),
    }


_EPOCH = "epoch(try_strptime(replace(replace({0}, 'GMT', '+0000'), 'Z', '+0000'), ['%a, %d %b %Y %H:%M:%S %z', '%Y-%m-%dT%H:%M:%S%z']))::BIGINT"
_INT = "try_cast(nullif(regexp_extract({0}, '^\\s*([+-]?[0-9]{{1,18}})', 1), '') AS BIGINT)"
_DURATION = f"""CASE WHEN regexp_full_match(itunes_duration, '[0-9]{{1,18}}') THEN itunes_duration::BIGINT
  WHEN len(string_split(itunes_duration, ':')) = 3 THEN {_INT.format("split_part(itunes_duration, ':', 1)")} * 3600 + {_INT.format("split_part(itunes_duration, ':', 2)")} * 60 + {_INT.format("split_part(itunes_duration, ':', 3)")}
  WHEN len(string_split(itunes_duration, ':')) = 2 THEN {_INT.format("split_part(itunes_duration, ':', 1)")} * 60 + {_INT.format("split_part(itunes_duration, ':', 2)")} END"""


def feed_item_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items as episodes' metadata."""
    rows = table(spark, folder, "feed_items").select("item_row_id", *E.episode_row(_item()))
    return rows.withColumn("published_at", F.unix_timestamp("published_at"))


ITEMS = f"""SELECT item_row_id, coalesce(nullif(guid, ''), nullif(link, ''), nullif(title, ''), '') AS guid, coalesce(nullif(title, ''), 'Untitled Episode') AS title, nullif(content_snippet, '') AS description,
  nullif(enclosure_url, '') AS enclosure_url, nullif(enclosure_type, '') AS enclosure_type, {_INT.format("enclosure_length")} AS enclosure_length, nullif(link, '') AS link, nullif(itunes_image_href, '') AS image_url,
  {_DURATION} AS duration_sec, {_EPOCH.format("pub_date")} AS published_at, {_INT.format("itunes_episode")} AS episode_number, {_INT.format("itunes_season")} AS season_number,
  coalesce(nullif(itunes_episode_type, ''), 'full') AS episode_type, coalesce(itunes_explicit = 'yes', false) AS explicit FROM feed_items"""


def feed_xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Feed items written as XML and read back, attributes and all."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), escape(c), F.lit(f"</{name}>"))).otherwise(F.lit(""))
    i = _item()
    attribute = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), escape(c), F.lit('"'))).otherwise(F.lit(""))
    xml = F.concat(
        F.lit("<item>"), tag("guid", i["guid"]), tag("link", i["link"]), tag("title", i["title"]), tag("pubDate", i["pub_date"]), tag("description", i["description"]),
        F.lit("<enclosure"), attribute("url", i["enclosure_url"]), attribute("type", i["enclosure_type"]), attribute("length", i["enclosure_length"]), F.lit("/>"),
        tag("itunes:duration", i["duration"]), tag("itunes:explicit", i["explicit"]), F.lit("</item>"),
    )
    x = table(spark, folder, "feed_items").select("item_row_id", parse_item(xml).alias("x"))
    return x.select("item_row_id", F.trim("x.guid").alias("guid"), F.trim("x.title").alias("title"), K.present(F.trim("x.pubDate")).alias("pub_date"), F.col("x.enclosure._url").alias("enclosure_url"), F.col("x.enclosure._length").alias("enclosure_length"), F.trim("`x`.`itunes:explicit`").alias("explicit"))


XML = "SELECT item_row_id, trim(guid) AS guid, trim(title) AS title, nullif(trim(pub_date), '') AS pub_date, enclosure_url, enclosure_length, trim(itunes_explicit) AS explicit FROM feed_items"


def series_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Series as their feeds have them."""
    feed = {n: F.col(c) for n, c in {"title": "title", "description": "description", "image_url": "image_url", "author": "author", "language": "lang_code", "series_type": "series_type"}.items()}
    return table(spark, folder, "podcast_series").select("series_id", *E.series_row(feed, F.lit("an old title")))


SERIES = "SELECT series_id, coalesce(nullif(title, ''), 'an old title') AS title, nullif(description, '') AS description, nullif(image_url, '') AS image_url, nullif(author, '') AS author, nullif(lang_code, '') AS language, CASE WHEN series_type = 'serial' THEN 'serial' ELSE 'episodic' END AS series_type FROM podcast_series"


def _cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "podcast_series").select("series_id", F.try_to_timestamp("episode_cutoff_date", F.lit("yyyy-MM-dd")).alias("cutoff"))


def feed_cutoff_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Items not before their series' cutoff; items and series without a date pass."""
    items = table(spark, folder, "feed_items").select("item_row_id", "series_id", K.feed_date(F.col("pub_date")).alias("published"))
    return items.join(_cutoffs(spark, folder), "series_id").where(E.after_cutoff(F.col("published"), F.col("cutoff"))).select("item_row_id", F.unix_timestamp("published").alias("published"))


CUTOFF = f"""SELECT item_row_id, published FROM (SELECT item_row_id, series_id, {_EPOCH.format("pub_date")} AS published FROM feed_items) JOIN podcast_series USING (series_id)
WHERE published IS NULL OR episode_cutoff_date IS NULL OR published >= epoch(episode_cutoff_date::TIMESTAMP)"""


def validation_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Where each feed item goes: to processing, or to the errors with the reason."""
    published = K.feed_date(F.col("pub_date"))
    reason = F.when(K.present(F.col("enclosure_url")).isNull(), F.lit("no enclosure")).when(K.present(F.trim("pub_date")).isNotNull() & published.isNull(), F.lit("unreadable date"))
    rows = table(spark, folder, "feed_items").withColumn("reason", F.coalesce(reason, F.lit("ok")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("series_id").alias("n_series"))


ROUTES = f"""SELECT reason, count(*) AS n, count(DISTINCT series_id) AS n_series FROM (SELECT series_id, CASE WHEN nullif(enclosure_url, '') IS NULL THEN 'no enclosure'
  WHEN nullif(trim(pub_date), '') IS NOT NULL AND {_EPOCH.format("pub_date")} IS NULL THEN 'unreadable date' ELSE 'ok' END AS reason FROM feed_items) GROUP BY ALL"""


def _latest_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return first_match(table(spark, folder, "episodes"), ["episode_id"], [F.col("updated_at").desc(), F.col("processing_status").asc_nulls_first(), F.col("title").asc_nulls_first(), F.col("duration_sec").asc_nulls_first()])


_LATEST = "le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY updated_at DESC, processing_status NULLS FIRST, title NULLS FIRST, duration_sec NULLS FIRST) n FROM episodes) WHERE n = 1)"


def episode_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each episode's status by its latest version."""
    return _latest_episodes(spark, folder).select("episode_id", "series_id", "processing_status")


STATUS = f"WITH {_LATEST} SELECT episode_id, series_id, processing_status FROM le"


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    keyed = lambda df: df.where("series_id IS NOT NULL AND guid IS NOT NULL AND guid <> ''")
    old = first_match(keyed(_latest_episodes(spark, folder)), ["series_id", "guid"], ["episode_id"]).select("series_id", "guid", "episode_id", "title", "enclosure_url", "enclosure_length", "processing_status", "image_media_id")
    newest = first_match(keyed(table(spark, folder, "feed_items")), ["series_id", "guid"], [F.col("fetched_at").desc(), F.col("item_row_id").desc()])
    new = newest.select("series_id", "guid", K.first_present(F.col("title"), F.lit(E.UNTITLED)).alias("title"), F.col("enclosure_url"), K.leading_int(F.col("enclosure_length")).alias("enclosure_length"))
    inserted = {"episode_id": stable_id(F.col("_n_series_id"), F.col("_n_guid")), "processing_status": F.lit("pending")}
    return E.upsert(old, new, ["series_id", "guid"], ["title", "enclosure_length"], ["enclosure_url"], inserted)


def episode_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes after the feed's newest items are put in: metadata replaced, the status kept, new ones pending."""
    return _upserted(spark, folder)


_UPSERT = f"""{_LATEST}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, guid ORDER BY episode_id) k FROM le WHERE series_id IS NOT NULL AND guid <> '') WHERE k = 1),
i AS (SELECT series_id, guid, coalesce(nullif(title, ''), 'Untitled Episode') AS title, enclosure_url, {_INT.format("enclosure_length")} AS enclosure_length
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id, guid ORDER BY fetched_at DESC, item_row_id DESC) k FROM feed_items WHERE series_id IS NOT NULL AND guid <> '') WHERE k = 1),
m AS (SELECT coalesce(o.series_id, i.series_id) AS series_id, coalesce(o.guid, i.guid) AS guid, coalesce(o.episode_id, sha256(i.series_id || '|' || i.guid)) AS episode_id, coalesce(i.title, o.title) AS title,
  CASE WHEN i.guid IS NOT NULL THEN i.enclosure_url ELSE o.enclosure_url END AS enclosure_url, coalesce(i.enclosure_length, o.enclosure_length) AS enclosure_length,
  CASE WHEN o.guid IS NOT NULL THEN o.processing_status ELSE 'pending' END AS processing_status, o.image_media_id,
  CASE WHEN o.guid IS NULL THEN 'inserted' WHEN i.guid IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN i ON o.series_id = i.series_id AND o.guid = i.guid)"""
UPSERT = f"WITH {_UPSERT} SELECT * FROM m"


def enqueue_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that follow the upsert: audio to download, as JSON."""
    rows = _upserted(spark, folder).where(F.col("action") != "kept")
    wanted = rows.where(K.present(F.col("enclosure_url")).isNotNull() & ((F.col("action") == "inserted") | F.coalesce(F.col("processing_status") == "pending", F.lit(False))))
    return wanted.select(F.lit("audio-download").alias("queue_name"), F.to_json(F.struct(F.col("episode_id").alias("episodeId"))).alias("body"))


ENQUEUE = f"""WITH {_UPSERT} SELECT 'audio-download' AS queue_name, '{{"episodeId":"' || episode_id || '"}}' AS body FROM m WHERE action <> 'kept' AND nullif(enclosure_url, '') IS NOT NULL AND (action = 'inserted' OR processing_status = 'pending')"""


def image_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages for pictures to download: of series and of upserted episodes that have an address for one but no medium yet."""
    body = lambda kind, key, url: F.to_json(F.struct(F.lit(kind).alias("type"), F.col(key).alias("id"), F.col(url).alias("imageUrl")))
    series = table(spark, folder, "podcast_series").where("image_url <> '' AND coalesce(image_media_id, '') = ''")
    keyed = table(spark, folder, "feed_items").where("series_id IS NOT NULL AND guid IS NOT NULL AND guid <> ''")
    newest = first_match(keyed, ["series_id", "guid"], [F.col("fetched_at").desc(), F.col("item_row_id").desc()]).select("series_id", "guid", "itunes_image_href")
    episodes = _upserted(spark, folder).where("action <> 'kept' AND coalesce(image_media_id, '') = ''").join(newest, ["series_id", "guid"]).where("itunes_image_href <> ''")
    queue = F.lit("image-download").alias("queue_name")
    return series.select(queue, body("series", "series_id", "image_url").alias("body")).unionByName(episodes.select(queue, body("episode", "episode_id", "itunes_image_href").alias("body")))


_BODY = """'{{"type":"{0}","id":' || to_json({1})::VARCHAR || ',"imageUrl":' || to_json({2})::VARCHAR || '}}'"""
IMAGE_MESSAGES = f"""WITH {_UPSERT}, h AS (SELECT series_id, guid, itunes_image_href FROM (SELECT *, row_number() OVER (PARTITION BY series_id, guid ORDER BY fetched_at DESC, item_row_id DESC) k FROM feed_items WHERE series_id IS NOT NULL AND guid <> '') WHERE k = 1)
SELECT 'image-download' AS queue_name, {_BODY.format("series", "series_id", "image_url")} AS body FROM podcast_series WHERE image_url <> '' AND coalesce(image_media_id, '') = ''
UNION ALL SELECT 'image-download', {_BODY.format("episode", "m.episode_id", "itunes_image_href")} FROM m JOIN h USING (series_id, guid) WHERE action <> 'kept' AND coalesce(m.image_media_id, '') = '' AND itunes_image_href <> ''"""


def series_update(spark: SparkSession, folder: str) -> DataFrame:
    """Series after their feeds' headers are put in: what the feed has replaces, what it lacks stays, the picture's medium is kept."""
    old = table(spark, folder, "podcast_series").where("series_id IS NOT NULL").select("series_id", "title", "description", "image_url", "author", "image_media_id")
    # A feed that was fetched again: every third series, with a new title, no description and another picture.
    fetched = old.where(F.ascii("series_id") % 3 == 0)
    feed = {"title": F.concat(F.lit("New "), F.col("title")), "description": F.lit("").cast("string"), "image_url": F.concat(F.lit("https://new.example/"), F.col("series_id")), "author": F.col("author")}
    new = fetched.select("series_id", *E.series_row(feed, F.col("title")))
    return E.upsert(old, new, ["series_id"], ["title", "description", "image_url", "author"], [], {})


SERIES_UPDATE = """SELECT series_id, CASE WHEN u THEN coalesce('New ' || title, title) ELSE title END AS title, description, CASE WHEN u THEN 'https://new.example/' || series_id ELSE image_url END AS image_url,
  CASE WHEN u THEN coalesce(nullif(author, ''), author) ELSE author END AS author, image_media_id, CASE WHEN u THEN 'updated' ELSE 'kept' END AS action FROM (SELECT *, ascii(series_id) % 3 = 0 AS u FROM podcast_series WHERE series_id IS NOT NULL)"""


def image_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for pictures of series and feed items: name by kind and identifier, type by the address."""
    series = table(spark, folder, "podcast_series").where("image_url <> ''").select(F.lit("series").alias("kind"), F.col("series_id").alias("id"), F.col("image_url").alias("url"))
    items = table(spark, folder, "feed_items").where("itunes_image_href <> ''").select(F.lit("episode").alias("kind"), F.col("item_row_id").cast("string").alias("id"), F.col("itunes_image_href").alias("url"))
    rows = series.unionByName(items).withColumn("ext", K.file_extension(F.col("url"), F.lit(None).cast("string"), "image"))
    return rows.select("kind", "id", F.concat("kind", F.lit("-"), F.left("id", F.lit(8)), F.lit("."), F.col("ext")).alias("name"), "ext", K.image_mime(F.col("ext")).alias("mime"))


_IMAGE_PATH = "lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^.]*)$', 1))"
IMAGE_ROWS = f"""WITH r AS (SELECT 'series' AS kind, series_id AS id, image_url AS url FROM podcast_series WHERE image_url <> '' UNION ALL SELECT 'episode', item_row_id::VARCHAR, itunes_image_href FROM feed_items WHERE itunes_image_href <> ''),
x AS (SELECT *, CASE WHEN {_IMAGE_PATH} = 'jpeg' THEN 'jpg' WHEN {_IMAGE_PATH} IN ('jpg', 'png', 'gif', 'webp', 'svg') THEN {_IMAGE_PATH} ELSE 'jpg' END AS ext FROM r)
SELECT kind, id, kind || '-' || left(id, 8) || '.' || ext AS name, ext, CASE ext WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'svg' THEN 'image/svg+xml' ELSE 'image/jpeg' END AS mime FROM x"""


def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What a run of the upsert did."""
    return _upserted(spark, folder).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("image_media_id").isNull()).alias("n_without_image"))


COUNTERS = f"WITH {_UPSERT} SELECT action, count(*) AS n, count(*) FILTER (WHERE image_media_id IS NULL) AS n_without_image FROM m GROUP BY ALL"


def media_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for the episodes' audio files: name, type and size."""
    extension = K.file_extension(F.col("enclosure_url"), F.col("enclosure_type"))
    rows = _latest_episodes(spark, folder).where(F.col("audio_media_id").isNotNull()).withColumn("ext", extension)
    return rows.select("episode_id", F.concat(F.left(F.coalesce(K.present(F.col("title")), F.concat(F.lit("audio-"), F.left("episode_id", F.lit(8)))), F.lit(100)), F.lit("."), F.col("ext")).alias("name"), "ext", K.first_present(F.col("enclosure_type"), F.lit("audio/mpeg")).alias("mime"), F.round(F.col("enclosure_length") / 1024.0, 3).alias("size_kb"))


_PATH = "lower(regexp_extract(regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^.]*)$', 1))"
_EXT = f"coalesce(CASE WHEN {_PATH} IN ('mp3', 'm4a', 'wav', 'ogg', 'aac', 'flac') THEN {_PATH} END, CASE {{1}} WHEN 'audio/mpeg' THEN 'mp3' WHEN 'audio/mp3' THEN 'mp3' WHEN 'audio/mp4' THEN 'm4a' WHEN 'audio/x-m4a' THEN 'm4a' WHEN 'audio/wav' THEN 'wav' WHEN 'audio/ogg' THEN 'ogg' WHEN 'audio/aac' THEN 'aac' WHEN 'audio/flac' THEN 'flac' END, 'mp3')"
_MIME = "coalesce(nullif(enclosure_type, ''), 'audio/mpeg')"
MEDIA = f"""WITH {_LATEST}, x AS (SELECT *, {_EXT.format("enclosure_url", "enclosure_type")} AS ext FROM le WHERE audio_media_id IS NOT NULL)
SELECT episode_id, left(coalesce(nullif(title, ''), 'audio-' || left(episode_id, 8)), 100) || '.' || ext AS name, ext, {_MIME} AS mime, round(enclosure_length / 1024.0::DOUBLE, 3) AS size_kb FROM x"""


def url_extension_mime(spark: SparkSession, folder: str) -> DataFrame:
    """File type of every enclosure, by its address and content type."""
    rows = table(spark, folder, "feed_items").withColumn("ext", K.file_extension(F.col("enclosure_url"), F.col("enclosure_type")))
    return rows.select("item_row_id", "ext", K.first_present(F.col("enclosure_type"), F.lit("audio/mpeg")).alias("mime"))


URLS = f"SELECT item_row_id, ext, {_MIME} AS mime FROM (SELECT item_row_id, {_EXT.format('enclosure_url', 'enclosure_type')} AS ext, enclosure_type FROM feed_items)"


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries with the episode they are about: by their own identifier, else by the audio's."""
    rows = table(spark, folder, "queue_messages").select("delivery_id", "queue_name", canonical_id(F.col("episode_id")).alias("own"), canonical_id(F.col("audio_media_id")).alias("media"))
    by_media = first_match(_latest_episodes(spark, folder).where("audio_media_id IS NOT NULL").select(canonical_id(F.col("audio_media_id")).alias("media"), canonical_id(F.col("episode_id")).alias("by_media")), ["media"], ["by_media"])
    return rows.join(by_media, "media", "left").select("delivery_id", "queue_name", F.coalesce("own", "by_media").alias("episode"))


def job_event_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The episode of each delivery; those about none are dropped."""
    return _resolved(spark, folder).where("episode IS NOT NULL")


_CANON = "CASE WHEN regexp_full_match(regexp_replace(regexp_replace({0}, '^(urn:)?(uuid:)?', ''), '[{{}}()\\-\\s]', '', 'g'), '[0-9a-f]{{32}}') THEN regexp_replace(regexp_replace({0}, '^(urn:)?(uuid:)?', ''), '[{{}}()\\-\\s]', '', 'g') ELSE nullif({0}, '') END"
_CLEAN = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_RESOLVED = f"""{_LATEST}, q AS (SELECT delivery_id, queue_name, {_CANON.format(_CLEAN.format("episode_id"))} AS own, {_CANON.format(_CLEAN.format("audio_media_id"))} AS media FROM queue_messages),
b AS (SELECT {_CANON.format(_CLEAN.format("audio_media_id"))} AS media, min({_CANON.format(_CLEAN.format("episode_id"))}) AS by_media FROM le WHERE audio_media_id IS NOT NULL GROUP BY ALL),
rs AS (SELECT delivery_id, queue_name, coalesce(own, by_media) AS episode FROM q LEFT JOIN b USING (media))"""
RESOLUTION = f"WITH {_RESOLVED} SELECT * FROM rs WHERE episode IS NOT NULL"


def message_entity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries with their episode's state; an episode that has its audio is forwarded, an unknown one is skipped."""
    episodes = _latest_episodes(spark, folder).select(canonical_id(F.col("episode_id")).alias("episode"), "series_id", "audio_media_id")
    route = F.when(F.col("series_id").isNull() & F.col("found").isNull(), F.lit("skip")).when(F.col("audio_media_id").isNotNull(), F.lit("forward")).otherwise(F.lit("download"))
    rows = _resolved(spark, folder).where("queue_name = 'audio-download'").join(episodes.withColumn("found", F.lit(True)), "episode", "left")
    return rows.select("delivery_id", route.alias("route"))


ENTITY = f"""WITH {_RESOLVED}, e AS (SELECT {_CANON.format(_CLEAN.format("episode_id"))} AS episode, audio_media_id FROM le)
SELECT delivery_id, CASE WHEN e.episode IS NULL THEN 'skip' WHEN audio_media_id IS NOT NULL THEN 'forward' ELSE 'download' END AS route FROM rs LEFT JOIN e USING (episode) WHERE queue_name = 'audio-download'"""


def entity_lookup_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first episode with each feed item's guid in its series, null where there is none."""
    episodes = first_match(table(spark, folder, "episodes").where("guid IS NOT NULL").select("series_id", "guid", "episode_id"), ["series_id", "guid"], ["episode_id"])
    return table(spark, folder, "feed_items").select("item_row_id", "series_id", "guid").join(episodes, ["series_id", "guid"], "left").select("item_row_id", "episode_id")


LOOKUP = "SELECT item_row_id, e.episode_id FROM feed_items f LEFT JOIN (SELECT series_id, guid, min(episode_id) AS episode_id FROM episodes WHERE guid IS NOT NULL GROUP BY ALL) e ON e.series_id = f.series_id AND e.guid = f.guid"


def episode_series_join(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes with their series; those whose series is unknown are left out."""
    series = table(spark, folder, "podcast_series").select("series_id", F.col("title").alias("series_title"))
    return _latest_episodes(spark, folder).join(series, "series_id").select("episode_id", "series_id", "series_title")


SERIES_JOIN = f"WITH {_LATEST} SELECT episode_id, series_id, s.title AS series_title FROM le JOIN podcast_series s USING (series_id)"


def children_census(spark: SparkSession, folder: str) -> DataFrame:
    """How many chapters and segments each episode has, of those that have any."""
    counts = [table(spark, folder, t).groupBy("episode_id").agg(F.countDistinct(k).alias(n)) for t, k, n in (("chapter_results", "chapter_row_id", "n_chapters"), ("segment_results", "result_segment_id", "n_segments"))]
    both = _latest_episodes(spark, folder).select("episode_id").join(counts[0], "episode_id", "left").join(counts[1], "episode_id", "left")
    return both.select("episode_id", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("n_segments", F.lit(0)).alias("n_segments")).where("n_chapters <> 0 OR n_segments <> 0")


CENSUS = f"""WITH {_LATEST}, c AS (SELECT episode_id, count(DISTINCT chapter_row_id) n FROM chapter_results GROUP BY ALL), s AS (SELECT episode_id, count(DISTINCT result_segment_id) n FROM segment_results GROUP BY ALL)
SELECT episode_id, coalesce(c.n, 0) AS n_chapters, coalesce(s.n, 0) AS n_segments FROM le LEFT JOIN c USING (episode_id) LEFT JOIN s USING (episode_id) WHERE coalesce(c.n, 0) <> 0 OR coalesce(s.n, 0) <> 0"""


def status_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Per series, how many episodes are complete, failed or neither."""
    status = F.col("processing_status")
    return _latest_episodes(spark, folder).groupBy("series_id").agg(F.count_if(status == "complete").alias("n_complete"), F.count_if(status == "failed").alias("n_failed"), F.count_if(~F.coalesce(status.isin("complete", "failed"), F.lit(False))).alias("n_other"))


TALLY = f"WITH {_LATEST} SELECT series_id, count(*) FILTER (WHERE processing_status = 'complete') AS n_complete, count(*) FILTER (WHERE processing_status = 'failed') AS n_failed, count(*) FILTER (WHERE coalesce(processing_status, '') NOT IN ('complete', 'failed')) AS n_other FROM le GROUP BY ALL"


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters that are left after those of unfinished episodes are deleted."""
    gone = _latest_episodes(spark, folder).where(F.coalesce(F.col("processing_status") != "complete", F.lit(True))).select("episode_id")
    return table(spark, folder, "chapter_results").join(gone, "episode_id", "left_anti").select("chapter_row_id", "episode_id").distinct()


CASCADE = f"WITH {_LATEST} SELECT DISTINCT chapter_row_id, episode_id FROM chapter_results WHERE episode_id IS NULL OR episode_id NOT IN (SELECT episode_id FROM le WHERE coalesce(processing_status, '') <> 'complete')"


def requeue_all(spark: SparkSession, folder: str) -> DataFrame:
    """A message for every episode that has audio; the same each time it is made."""
    rows = _latest_episodes(spark, folder).where("audio_media_id IS NOT NULL")
    return rows.select(stable_id(F.lit("processing"), F.col("audio_media_id")).alias("message_id"), F.to_json(F.struct(F.col("episode_id").alias("episodeId"), F.col("audio_media_id").alias("audioMediaId"))).alias("body"))


REQUEUE = f"""WITH {_LATEST} SELECT sha256('processing|' || audio_media_id) AS message_id, '{{"episodeId":"' || episode_id || '","audioMediaId":"' || audio_media_id || '"}}' AS body FROM le WHERE audio_media_id IS NOT NULL"""


def event_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's state by their last event, by time and then by number."""
    rows = table(spark, folder, "events")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count(F.lit(1)).alias("n_events"))


EVENT_STATUS = "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY ALL"


def event_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events' JSON properties as columns, and terminal events told from those in progress."""
    k = messages(F.col("props"), "k bigint")["k"]
    rows = table(spark, folder, "events").withColumn("k", k)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.max(F.col("event_type").isin("purchase", "error")).alias("terminal"))


EVENT_JSON = "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k, event_type IN ('purchase', 'error') AS terminal FROM events GROUP BY ALL"


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The text functions over every document."""
    t = F.col("text")
    return table(spark, folder, "documents").where(t.isNotNull()).select(
        "doc_id", K.ellipsize(t, 40).alias("short"), K.cut(t, 200).alias("head"), F.md5(K.trimmed(t)).alias("trimmed"), K.utf16_length(t).cast("bigint").alias("units"),
        K.first_part(F.coalesce("episode_id", F.lit(""))).alias("first_part"), F.md5(K.base64_line(t.cast("binary"))).alias("base64"), F.char_length(t).cast("bigint").alias("n_chars"),
    )


_B = r"[\x09-\x0d\x{85} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TEXTS = rf"""SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 39) || '…' END AS short, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS head,
  md5(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g')) AS trimmed, length(text) + length(regexp_replace(text, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')) AS units, split_part(coalesce(episode_id, ''), '-', 1) AS first_part,
  md5(base64(encode(text))) AS base64, length(text) AS n_chars FROM documents WHERE text IS NOT NULL"""


def math_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding, clamping, prefix parsing and scaling over the order table."""
    rows = table(spark, folder, "orders")
    w, h = K.fit_inside((F.col("o_custkey") % 3000 + 1).cast("double"), (F.col("o_orderkey") % 2000 + 1).cast("double"), F.lit(640.0), F.when(F.col("o_orderkey") % 2 == 0, F.lit(480.0)))
    return rows.select(
        "o_orderkey", "o_custkey", K.half_up(F.col("o_totalprice") / 7 - 1000).alias("rounded"), K.clamp(F.col("o_totalprice"), 1000.0, 100000.0).alias("clamped"),
        K.minutes_label(F.col("o_custkey") * 7).alias("label"), K.leading_int(F.col("o_orderpriority")).alias("priority"), w.alias("width"), h.alias("height"),
    )


_SCALE = "least(1.0::DOUBLE, 640.0::DOUBLE / (o_custkey % 3000 + 1), CASE WHEN o_orderkey % 2 = 0 THEN 480.0::DOUBLE / (o_orderkey % 2000 + 1) ELSE 1.0::DOUBLE END)"
MATH = f"""SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice / 7 - 1000 + 0.5) AS BIGINT) AS rounded, least(greatest(o_totalprice, 1000.0), 100000.0) AS clamped,
  (o_custkey * 7 // 60)::VARCHAR || ':' || lpad((o_custkey * 7 % 60)::VARCHAR, 2, '0') AS label, {_INT.format("o_orderpriority")} AS priority,
  CAST(floor((o_custkey % 3000 + 1) * {_SCALE} + 0.5) AS BIGINT) AS width, CAST(floor((o_orderkey % 2000 + 1) * {_SCALE} + 0.5) AS BIGINT) AS height FROM orders"""


def image_request_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for pictures of every series, good and bad ones."""
    series = table(spark, folder, "podcast_series").where("image_media_id IS NOT NULL").select("image_media_id")
    forms = [("/image/{}.jpg", "100", "200"), ("/image/{}.JPEG", "0", "x"), ("/image/{}.png", "-1", None), ("/image/{}.webp", "4001", "5"), ("/image/{}.gif", "10", "10"), ("/img/{}.png", None, None), ("/image/{}.png", "4000", "1")]
    text = lambda v: F.lit(v).cast("string")
    rows = series.select("image_media_id", F.inline(F.array(*[F.struct(text(p).alias("path"), text(w).alias("w"), text(h).alias("h")) for p, w, h in forms])))
    r = K.image_request(F.replace("path", F.lit("{}"), F.col("image_media_id")), F.col("w"), F.col("h"))
    return rows.select("image_media_id", "path", "w", r.alias("r")).select("image_media_id", "path", "w", "r.status", "r.id", "r.format", "r.width", "r.height")


IMAGES = """WITH f(path, w, h) AS (VALUES ('/image/{}.jpg', '100', '200'), ('/image/{}.JPEG', '0', 'x'), ('/image/{}.png', '-1', NULL), ('/image/{}.webp', '4001', '5'), ('/image/{}.gif', '10', '10'), ('/img/{}.png', NULL, NULL), ('/image/{}.png', '4000', '1')),
x AS (SELECT image_media_id, path, w, lower(regexp_extract(replace(path, '{}', image_media_id), '(?i)^/image/([0-9a-f-]+)\\.(jpg|jpeg|png|webp)$', 2)) k, nullif(try_cast(w AS BIGINT), 0) a, nullif(try_cast(h AS BIGINT), 0) b FROM podcast_series, f WHERE image_media_id IS NOT NULL),
y AS (SELECT *, CASE WHEN k = '' THEN 404 WHEN a < 1 OR a > 4000 OR b < 1 OR b > 4000 THEN 400 ELSE 200 END AS status FROM x)
SELECT image_media_id, path, w, status, CASE WHEN status <> 404 THEN image_media_id END AS id, CASE WHEN status <> 404 THEN replace(k, 'jpeg', 'jpg') END AS format, CASE WHEN status = 200 THEN a END AS width, CASE WHEN status = 200 THEN b END AS height FROM y"""


def palette_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Colours of parts, some swatches missing."""
    names = ["vibrant", "light_vibrant", "dark_vibrant", "muted", "light_muted", "dark_muted"]
    swatch = lambda n: F.when(F.shiftright(F.col("p_partkey"), names.index(n)) % 2 == 1, F.concat(F.lit(f"#{n[:3]}"), F.col("p_partkey").cast("string")))
    return table(spark, folder, "part").select("p_partkey", *roles(swatch))


def _swatch(i: int, n: str) -> str:
    return f"CASE WHEN (p_partkey >> {i}) % 2 = 1 THEN '#{n[:3]}' || p_partkey END"


_S = {n: _swatch(i, n) for i, n in enumerate(["vibrant", "light_vibrant", "dark_vibrant", "muted", "light_muted", "dark_muted"])}
PALETTE = f"SELECT p_partkey, coalesce({_S['vibrant']}, {_S['light_vibrant']}, {_S['dark_vibrant']}) AS primary_color, coalesce({_S['dark_muted']}, {_S['light_muted']}, {_S['muted']}) AS background_color, coalesce({_S['muted']}, {_S['light_vibrant']}, {_S['dark_vibrant']}) AS secondary_color FROM part"


def category_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Nested categories of every nation's region, a parent before its children."""
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    leaf = lambda name: F.struct(name.alias("_text"), F.lit(None).cast("string").alias("_VALUE"))
    nested = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array(F.struct(F.col("r_name").alias("_text"), F.lit(None).cast("string").alias("_VALUE"), F.array(leaf(F.col("n_name")), leaf(F.lit("")), leaf(F.lit("Other"))).alias("category"))).alias("c"))
    return nested.select("n_nationkey", F.array_join(E.flatten_categories(F.col("c"), 2), ">").alias("names"))


CATEGORIES = "SELECT n_nationkey, r_name || '>' || n_name || '>Other' AS names FROM nation JOIN region ON n_regionkey = r_regionkey"


_FORMATS = ["jpg", "png", "webp"]


def blob_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The base file of every series' picture in each format; of some series the store has jpg, png, both or nothing, and of some a webp that is no base."""
    series = table(spark, folder, "podcast_series").where("image_media_id IS NOT NULL").select("image_media_id").distinct()
    n = F.ascii(F.substring("image_media_id", 1, 1)) % 4
    stored = series.select("image_media_id", F.explode(F.filter(F.array(F.when(n <= 1, F.lit("jpg")), F.when((n == 1) | (n == 2), F.lit("png")), F.when(n == 3, F.lit("webp"))), lambda x: x.isNotNull())).alias("kind"))
    available = stored.select(F.concat(F.lit("processed/"), F.col("image_media_id"), F.lit("/base."), F.col("kind")).alias("path"))
    wanted = series.select("image_media_id", F.explode(F.array(*[F.lit(f) for f in _FORMATS])).alias("format"))
    return blob_with_fallback(wanted, available, "image_media_id")


BLOBS = """WITH m AS (SELECT DISTINCT image_media_id, ascii(image_media_id[1]) % 4 AS n FROM podcast_series WHERE image_media_id IS NOT NULL),
b AS (SELECT image_media_id, format, CASE WHEN format = 'png' THEN CASE WHEN n IN (1, 2) THEN 'png' END WHEN n <= 1 THEN 'jpg' WHEN n = 2 THEN 'png' END AS k FROM m, (VALUES ('jpg'), ('png'), ('webp')) f(format))
SELECT image_media_id, format, 'processed/' || image_media_id || '/base.' || k AS path, CASE WHEN k IS NULL THEN 'no such picture' END AS error FROM b"""


def category_any_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Names of categories that nest as deep as a nation's number, from a feed's text."""
    nations = table(spark, folder, "nation")
    deep = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_nationkey")), lambda i: F.concat(F.lit('<itunes:category text="C'), i.cast("string"), F.lit(' &amp; so">'))), "")
    closing = F.repeat(F.lit("</itunes:category>"), F.col("n_nationkey") + 1)
    xml = F.concat(F.lit("<channel>"), deep, closing, F.lit("<itunes:category text='Last'/></channel>"))
    return nations.select("n_nationkey", F.array_join(E.category_names(xml), ">").alias("names"))


DEEP = "SELECT n_nationkey, (SELECT string_agg('C' || i || ' & so', '>' ORDER BY i) FROM range(n_nationkey + 1) t(i)) || '>Last' AS names FROM nation"


def query_values(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers and titles of feed items as values of a query string, and numbers as text with decimals."""
    rows = table(spark, folder, "feed_items")
    return rows.select("item_row_id", K.query_value(F.col("guid")).alias("guid"), K.query_value(F.col("title")).alias("title"), K.fixed(K.leading_number(F.col("itunes_duration")) / 7, 2).alias("fixed"))


_ENCODED = "replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"
QUERY_VALUES = rf"""SELECT item_row_id, {_ENCODED.format("guid")} AS guid, {_ENCODED.format("title")} AS title,
  printf('%.2f', try_cast(nullif(regexp_extract(itunes_duration, '^[ \t\n\x0b\f\r]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) / 7) AS fixed FROM feed_items"""


def speaker_map(spark: SparkSession, folder: str) -> DataFrame:
    """Each episode's speakers as one map, the last of a repeated label winning, rendered in order."""
    last = table(spark, folder, "episode_speakers").groupBy("episode_id", "speaker_id").agg(F.max_by(F.struct(F.col("speaker_name").alias("name"), F.col("speaker_role").alias("role")), F.coalesce("speaker_name", F.lit(""))).alias("s"))
    maps = last.groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker_id", "s")))).alias("m"))
    line = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["name"], F.lit("")), F.lit("/"), F.coalesce(e["value"]["role"], F.lit("")))
    return maps.select("episode_id", F.size("m").cast("bigint").alias("n"), F.array_join(F.transform(F.map_entries("m"), line), "; ").alias("speakers"))


SPEAKER_MAP = """WITH l AS (SELECT episode_id, speaker_id, arg_max(struct_pack(name := speaker_name, role := speaker_role), coalesce(speaker_name, '')) s FROM episode_speakers GROUP BY ALL)
SELECT episode_id, count(*) AS n, string_agg(speaker_id || '=' || coalesce(s.name, '') || '/' || coalesce(s.role, ''), '; ' ORDER BY speaker_id) AS speakers FROM l GROUP BY ALL"""

_NOW_MS = 1_700_000_000_000


def job_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to transcode and to transcribe the audio of every episode."""
    rows = J.job_requests(_latest_episodes(spark, folder), F.lit(_NOW_MS))
    return rows.select("episode_id", "kind", "name", "input", "output", F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("settings"))


JOBS = f"""WITH {_LATEST}, k(kind, settings) AS (VALUES ('transcode', 'segment_seconds=10;bitrate=128000;sample_rate=48000;codec=AAC'), ('transcribe', 'language=en-US;max_speakers=10'))
SELECT episode_id, kind, kind || '-' || split_part(episode_id, '-', 1) || '-{_NOW_MS}' AS name, 'raw/' || audio_media_id AS input, 'processed/' || audio_media_id || '/' AS output, settings FROM le, k WHERE audio_media_id IS NOT NULL"""


def _job_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    job = F.when(kind.isin("click", "error"), F.lit("transcode")).otherwise(F.lit("transcribe"))
    status = F.when(kind == "error", F.lit("ERROR")).when(kind.isin("click", "purchase"), F.lit("COMPLETE")).otherwise(F.lit("PROGRESSING"))
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("episode_id"), job.alias("job"), status.alias("status"), "ts", F.col("event_id").alias("seq"))


def completion_last(spark: SparkSession, folder: str) -> DataFrame:
    """States by the last terminal event."""
    return J.completion(_job_events(spark, folder))


def completion_strict(spark: SparkSession, folder: str) -> DataFrame:
    """States by the last terminal event of both jobs."""
    return J.completion(_job_events(spark, folder), strict=True)


COMPLETION_LAST = "SELECT user_id::VARCHAR AS episode_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'failed' END, struct_pack(a := ts, b := event_id)) AS status FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL"
COMPLETION_STRICT = """WITH l AS (SELECT user_id::VARCHAR AS episode_id, arg_max(event_type = 'click', struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type IN ('click', 'error')) AS a, arg_max(true, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'purchase') AS b
  FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY ALL)
SELECT episode_id, CASE WHEN a AND b THEN 'complete' WHEN (a IS NULL AND coalesce(b, true)) OR (b IS NULL AND coalesce(a, true)) THEN 'waiting' ELSE 'failed' END AS status FROM l"""


def graph_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each episode's graph identifiers in order, as a store answers: a job's, the record's own, or none."""
    rows = first_match(table(spark, folder, "segment_results"), ["result_segment_id"], ["created_at", "start_sec", "end_sec", "segment_type"])
    n = F.octet_length("result_segment_id") + F.ascii(F.right("result_segment_id", F.lit(1)))
    answer = F.struct(F.when(n % 3 == 0, F.concat(F.lit("job-"), F.col("result_segment_id"))).alias("job_id"), F.when(n % 3 == 1, F.col("result_segment_id")).otherwise(F.lit("")).alias("id"))
    records = rows.select("episode_id", "result_segment_id", J.graph_id(answer, "segment", F.col("result_segment_id")).alias("id"))
    return J.ids_in_order(records, "episode_id", "result_segment_id", "id").select("episode_id", F.array_join("ids", ",").alias("ids"))


GRAPH_IDS = """WITH r AS (SELECT DISTINCT ON (result_segment_id) result_segment_id, episode_id FROM segment_results ORDER BY result_segment_id, created_at, start_sec, end_sec, segment_type),
i AS (SELECT *, (strlen(result_segment_id) + ascii(right(result_segment_id, 1))) % 3 AS n FROM r)
SELECT episode_id, string_agg(CASE n WHEN 0 THEN 'job-' || result_segment_id WHEN 1 THEN result_segment_id ELSE 'segment-' || result_segment_id END, ',' ORDER BY result_segment_id) AS ids FROM i GROUP BY ALL"""

QUERIES = {
    "feed_item_projection": feed_item_projection, "feed_xml_scan": feed_xml_scan, "series_projection": series_projection, "feed_cutoff_filter": feed_cutoff_filter, "validation_routes": validation_routes,
    "episode_latest_status": episode_latest_status, "episode_upsert": episode_upsert, "enqueue_messages": enqueue_messages, "run_counters": run_counters, "media_rows": media_rows, "url_extension_mime": url_extension_mime,
    "job_event_resolution": job_event_resolution, "message_entity_join": message_entity_join, "entity_lookup_first": entity_lookup_first, "episode_series_join": episode_series_join, "children_census": children_census,
    "status_tally": status_tally, "cascade_delete": cascade_delete, "requeue_all": requeue_all, "event_latest_status": event_latest_status, "event_json": event_json, "text_functions": text_functions, "math_functions": math_functions,
    "image_request_parse": image_request_parse, "palette_roles": palette_roles, "category_flatten": category_flatten, "blob_fallback": blob_fallback, "speaker_map": speaker_map,
    "image_messages": image_messages, "series_update": series_update, "image_rows": image_rows, "category_any_depth": category_any_depth, "query_values": query_values,
    "job_requests": job_requests, "completion_last": completion_last, "completion_strict": completion_strict, "graph_ids": graph_ids,
}
SQL = {
    "feed_item_projection": ITEMS, "feed_xml_scan": XML, "series_projection": SERIES, "feed_cutoff_filter": CUTOFF, "validation_routes": ROUTES,
    "episode_latest_status": STATUS, "episode_upsert": UPSERT, "enqueue_messages": ENQUEUE, "run_counters": COUNTERS, "media_rows": MEDIA, "url_extension_mime": URLS,
    "job_event_resolution": RESOLUTION, "message_entity_join": ENTITY, "entity_lookup_first": LOOKUP, "episode_series_join": SERIES_JOIN, "children_census": CENSUS,
    "status_tally": TALLY, "cascade_delete": CASCADE, "requeue_all": REQUEUE, "event_latest_status": EVENT_STATUS, "event_json": EVENT_JSON, "text_functions": TEXTS, "math_functions": MATH,
    "image_request_parse": IMAGES, "palette_roles": PALETTE, "category_flatten": CATEGORIES, "blob_fallback": BLOBS, "speaker_map": SPEAKER_MAP,
    "image_messages": IMAGE_MESSAGES, "series_update": SERIES_UPDATE, "image_rows": IMAGE_ROWS, "category_any_depth": DEEP, "query_values": QUERY_VALUES,
    "job_requests": JOBS, "completion_last": COMPLETION_LAST, "completion_strict": COMPLETION_STRICT, "graph_ids": GRAPH_IDS,
}
