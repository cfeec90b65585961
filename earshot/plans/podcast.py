"""Queries over episodes' transcripts, chapters and segments, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import line_of, minutes_label
from ..operators import chapters as C
from ..operators import feeds as E
from ..operators import graph as G
from ..operators import models as M
from ..operators import transcripts as U
from ..operators.intervals import whole_ms
from ..operators.joins import first_match, interval_join
from ..operators.texts import split_greedy
from ..session import checkpointed
from ..sources.tables import table

_MS = """CASE WHEN {0} LIKE '%:%:%' THEN split_part({0}, ':', 1)::BIGINT * 3600000 + split_part({0}, ':', 2)::BIGINT * 60000 + round(split_part({0}, ':', 3)::DECIMAL(18, 6) * 1000)::BIGINT
  WHEN {0} LIKE '%:%' THEN split_part({0}, ':', 1)::BIGINT * 60000 + round(split_part({0}, ':', 2)::DECIMAL(18, 6) * 1000)::BIGINT
  ELSE round(replace(replace(trim({0}), 's', ''), ',', '.')::DECIMAL(18, 6) * 1000)::BIGINT END"""

_U = f"""
u0 AS (
  SELECT episode_id, segment_id, {_MS.format("start_time")} start_ms, {_MS.format("end_time")} end_ms, coalesce(transcript, '') AS text, coalesce(nullif(trim(speaker_label, ' '), ''), 'unknown') AS label, start_time, end_time, transcript, speaker_label
  FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY ingested_at) n FROM transcript_segments) WHERE n = 1 OR segment_id IS NULL
), u AS (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, segment_id) - 1 AS ord FROM u0
), d AS (SELECT episode_id, max(end_ms) AS duration_ms FROM u GROUP BY ALL)"""

_CH = """
c0 AS (
  SELECT DISTINCT episode_id, chapter_row_id, chapter_type, title, CAST(floor(start_sec * 1000.0 + 0.5) AS BIGINT) start_ms, CAST(floor(end_sec * 1000.0 + 0.5) AS BIGINT) end_ms
  FROM chapter_results WHERE isfinite(start_sec) AND isfinite(end_sec)
), c1 AS (
  SELECT c0.*, duration_ms, row_number() OVER w n, lag(end_ms) OVER w p, lead(1) OVER w IS NULL AS l
  FROM c0 LEFT JOIN d USING (episode_id) WINDOW w AS (PARTITION BY episode_id ORDER BY start_ms, chapter_row_id)
), c2 AS (
  SELECT episode_id, CAST(least(60000, floor(duration_ms * 0.1)) AS BIGINT) a, CAST(greatest(duration_ms - 60000, ceil(duration_ms * 0.9)) AS BIGINT) b, duration_ms e
  FROM d WHERE duration_ms IS NOT NULL AND episode_id NOT IN (SELECT episode_id FROM c0 WHERE episode_id IS NOT NULL)
), ch AS (
  SELECT episode_id, chapter_row_id::VARCHAR AS chapter_id, chapter_type, title, start_ms, end_ms FROM (
    SELECT episode_id, chapter_row_id, chapter_type, title, CASE WHEN n = 1 THEN least(start_ms, 0) ELSE p END start_ms, CASE WHEN l THEN greatest(end_ms, coalesce(duration_ms, end_ms)) ELSE end_ms END end_ms FROM c1)
  WHERE end_ms - start_ms >= 10000
  UNION ALL SELECT episode_id, episode_id || '-introduction', 'introduction', 'Introduction', 0, a FROM c2
  UNION ALL SELECT episode_id, episode_id || '-section', 'section', 'Main Content', a, b FROM c2
  UNION ALL SELECT episode_id, episode_id || '-credits', 'credits', 'Closing', b, e FROM c2
)"""

_SG = """
sg AS (
  SELECT result_segment_id, episode_id, segment_type, start_ms, end_ms, lucidity, polarity, arousal, subjectivity, humor FROM (
    SELECT result_segment_id, episode_id, segment_type, lucidity, polarity, arousal, subjectivity, humor, CAST(floor(start_sec * 1000.0 + 0.5) AS BIGINT) start_ms, CAST(floor(end_sec * 1000.0 + 0.5) AS BIGINT) end_ms,
      row_number() OVER (PARTITION BY result_segment_id ORDER BY created_at, start_sec, end_sec, segment_type, lucidity, polarity, arousal, subjectivity, humor) n
    FROM segment_results WHERE isfinite(start_sec) AND isfinite(end_sec)) WHERE n = 1
)"""


def _utterances(spark: SparkSession, folder: str, **what: bool) -> DataFrame:
    return U.utterances(table(spark, folder, "transcript_segments"), **what)


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return U.durations(_utterances(spark, folder, text=False, label=False, ordered=False))


def _times(spark: SparkSession, folder: str) -> DataFrame:
    return U.times(table(spark, folder, "transcript_segments")).withColumnRenamed("episode_id", "ep")


def _chapters(spark: SparkSession, folder: str, lengths: DataFrame | None = None) -> DataFrame:
    """The chapters in order and without gaps: chapter_id is the row's, or the episode's and the kind for a default chapter."""
    raw = table(spark, folder, "chapter_results").select("episode_id", "chapter_row_id", "chapter_type", "title", whole_ms(F.col("start_sec")).alias("start_ms"), whole_ms(F.col("end_sec")).alias("end_ms")).distinct()
    repaired = C.repair_chapters(raw, _lengths(spark, folder) if lengths is None else lengths, "chapter_row_id", defaults=True)
    own = F.coalesce(F.col("chapter_row_id").cast("string"), F.concat_ws("-", "episode_id", "chapter_type"))
    return repaired.select("episode_id", own.alias("chapter_id"), "chapter_type", "title", "start_ms", "end_ms")


def _segments(spark: SparkSession, folder: str, metrics: bool = False) -> DataFrame:
    raw = table(spark, folder, "segment_results").withColumn("start_ms", whole_ms(F.col("start_sec"))).withColumn("end_ms", whole_ms(F.col("end_sec"))).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    first = first_match(raw, ["result_segment_id"], ["created_at", "start_sec", "end_sec", "segment_type", *G.METRICS])
    return first.select("result_segment_id", "episode_id", "segment_type", "start_ms", "end_ms", *G.METRICS * metrics)


def _placed(spark: SparkSession, folder: str, metrics: bool = False, chapters: DataFrame | None = None) -> DataFrame:
    """Segments with the chapter that holds their middle, cut to it."""
    return C.clamp_segments(C.midpoint_chapter(_segments(spark, folder, metrics), _chapters(spark, folder) if chapters is None else chapters, "result_segment_id", "chapter_id"))


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    """Each episode's last version with its series' title."""
    columns = ["episode_id", "title", "series_id", "published_at"]
    last = first_match(table(spark, folder, "episodes").select(*columns, "updated_at"), ["episode_id"], [F.col("updated_at").desc(), "title", "series_id", "published_at"])
    series = table(spark, folder, "podcast_series").select("series_id", F.col("title").alias("series_title"))
    return last.join(series, "series_id", "left").select("episode_id", F.col("title").alias("episode_title"), "series_id", "series_title", "published_at")


_TITLES = """
e0 AS (SELECT episode_id, title, series_id, published_at FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY updated_at DESC NULLS LAST, title NULLS FIRST, series_id NULLS FIRST, published_at NULLS FIRST) n FROM episodes) WHERE n = 1),
e AS (SELECT e0.episode_id, e0.title AS episode_title, e0.series_id, s.title AS series_title, published_at FROM e0 LEFT JOIN podcast_series s ON s.series_id = e0.series_id)"""


def _speakers(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "episode_speakers").select("episode_id", F.col("speaker_id").alias("label"), F.col("speaker_name").alias("name"), F.col("speaker_role").alias("role"))
    return first_match(s, ["episode_id", "label"], ["name", "role"])


def transcript_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of 30 seconds as labelled lines with speakers' names."""
    return U.timeline(U.named(_utterances(spark, folder), _speakers(spark, folder)))


_NAMED = """
s AS (SELECT episode_id, speaker_id AS label, speaker_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker_id ORDER BY speaker_name NULLS FIRST, speaker_role NULLS FIRST) n FROM episode_speakers) WHERE n = 1),
un AS (SELECT u.*, coalesce(nullif(s.name, ''), u.label) AS name FROM u LEFT JOIN s ON s.episode_id = u.episode_id AND s.label = u.label)"""

TIMELINE = f"""WITH {_U}, {_NAMED}, t AS (
  SELECT episode_id, CAST(start_ms // 30000 AS BIGINT) AS block, string_agg('[' || name || '] ' || text, ' ' ORDER BY ord) x FROM un WHERE start_ms >= 0 GROUP BY ALL)
SELECT episode_id, block, (block * 30 // 60)::VARCHAR || ':' || lpad((block * 30 % 60)::VARCHAR, 2, '0') AS label, CASE WHEN length(x) > 300 THEN left(x, 300) || '...' ELSE x END AS text FROM t"""


def speaker_labels_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Each episode's labels in order of appearance, with default names."""
    return U.default_speakers(U.labels_in_order(_utterances(spark, folder, text=False)))


LABELS = f"""WITH {_U}, l AS (SELECT episode_id, label, min(ord) AS first_ord FROM u GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY first_ord) - 1 AS place, CASE WHEN label = 'spk_0' THEN 'Host' ELSE 'Speaker ' || replace(label, 'spk_', '') END AS name, CASE WHEN label = 'spk_0' THEN 'host' ELSE 'unknown' END AS role FROM l"""


def speaker_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The listed speakers, and numbered ones for labels that are missing from the list."""
    known = table(spark, folder, "episode_speakers").select("episode_id", F.col("speaker_id").alias("label"), F.col("speaker_name").alias("name"), F.col("speaker_role").alias("role"), F.col("speaker_name").alias("place"))
    return U.fill_speakers(U.labels_in_order(_utterances(spark, folder, text=False)), known.withColumn("place", F.coalesce("place", F.lit(""))))


FILL = f"""WITH {_U}, k AS (SELECT episode_id, speaker_id AS label, arg_max(struct_pack(name := speaker_name, role := speaker_role), coalesce(speaker_name, '')) x FROM episode_speakers GROUP BY ALL)
SELECT episode_id, label, x.name AS name, x.role AS role, true AS listed FROM k
UNION ALL SELECT DISTINCT episode_id, label, 'Speaker ' || replace(label, 'spk_', ''), 'unknown', false FROM u ANTI JOIN k USING (episode_id, label)"""


def speaker_samples_top5(spark: SparkSession, folder: str) -> DataFrame:
    """Each speaker's first five utterances, cut to 200 characters."""
    return U.samples(_utterances(spark, folder))


SAMPLES = f"""WITH {_U}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, label ORDER BY ord) AS sample FROM u)
SELECT episode_id, label, sample, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text FROM r WHERE sample <= 5"""


def episode_duration_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Each episode's length and how many chapters and segments it should have."""
    return U.targets(_lengths(spark, folder))


TARGETS = f"""WITH {_U} SELECT episode_id, duration_ms, least(greatest(CAST(floor(duration_ms / 60000.0 / 4 + 0.5) AS BIGINT), 5), 15) AS chapters, least(greatest(CAST(floor(duration_ms / 3600000.0 * 40 + 0.5) AS BIGINT), 20), 60) AS segments FROM d"""


def default_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Three chapters for every episode, as if it had none."""
    return C.default_chapters(_lengths(spark, folder))


DEFAULTS = f"""WITH {_U}, x AS (SELECT episode_id, duration_ms, CAST(least(60000, floor(duration_ms * 0.1)) AS BIGINT) a, CAST(greatest(duration_ms - 60000, ceil(duration_ms * 0.9)) AS BIGINT) b FROM d)
SELECT episode_id, 0::BIGINT AS chapter, 'introduction' AS chapter_type, 'Introduction' AS title, 'Episode introduction' AS summary, 0::BIGINT AS start_ms, a AS end_ms FROM x
UNION ALL SELECT episode_id, 1, 'section', 'Main Content', 'Main episode content', a, b FROM x UNION ALL SELECT episode_id, 2, 'credits', 'Closing', 'Episode conclusion and credits', b, duration_ms FROM x"""


def chapter_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters with repaired boundaries, and the default ones of episodes without any."""
    return _chapters(spark, folder)


REPAIR = f"WITH {_U}, {_CH} SELECT * FROM ch"


def _excerpt(how: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = _utterances(spark, folder, label=False).withColumnRenamed("episode_id", "ep")
        ranges = _chapters(spark, folder).select(F.col("episode_id").alias("ep"), "chapter_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))
        return U.excerpts(interval_join(rows, ranges, "ep", how, times=_times(spark, folder)), "chapter_id")

    query.__doc__ = f"The text of each chapter, by {how}."
    return query


def _excerpt_sql(condition: str) -> str:
    return f"WITH {_U}, {_CH} SELECT chapter_id, count(*) AS n_utterances, string_agg(text, ' ' ORDER BY ord) AS excerpt FROM ch JOIN u ON u.episode_id = ch.episode_id AND {condition} GROUP BY ALL"


def midpoint_chapter(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment's chapter, by its middle."""
    return C.midpoint_chapter(_segments(spark, folder), _chapters(spark, folder), "result_segment_id", "chapter_id").select("result_segment_id", "chapter_id")


_MID = """m AS (
  SELECT sg.*, ch.chapter_id, ch.title, ch.start_ms c_a, ch.end_ms c_b, row_number() OVER (PARTITION BY result_segment_id ORDER BY ch.start_ms, ch.chapter_id) n
  FROM sg LEFT JOIN ch ON ch.episode_id = sg.episode_id AND sg.start_ms + sg.end_ms >= 2 * ch.start_ms AND sg.start_ms + sg.end_ms < 2 * ch.end_ms)"""
MIDPOINT = f"WITH {_U}, {_CH}, {_SG}, {_MID} SELECT result_segment_id, chapter_id FROM m WHERE n = 1"


def clamp_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments cut to their chapter."""
    return _placed(spark, folder).select("result_segment_id", "start_ms", "end_ms")


CLAMP = f"WITH {_U}, {_CH}, {_SG}, {_MID} SELECT result_segment_id, CASE WHEN c_a IS NULL THEN start_ms ELSE greatest(start_ms, c_a) END AS start_ms, CASE WHEN c_a IS NULL THEN end_ms ELSE least(end_ms, c_b) END AS end_ms FROM m WHERE n = 1"


def actual_range(spark: SparkSession, folder: str) -> DataFrame:
    """From the first to the last utterance of each segment."""
    rows = _utterances(spark, folder, text=False, label=False).withColumnRenamed("episode_id", "ep")
    ranges = _segments(spark, folder).select(F.col("episode_id").alias("ep"), "result_segment_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))
    return U.actual_ranges(ranges, interval_join(rows, ranges, "ep", "overlap", times=_times(spark, folder)), "result_segment_id")


ACTUAL = f"""WITH {_U}, {_SG} SELECT sg.result_segment_id, coalesce(arg_min(u.start_ms, ord), 0) AS actual_start_ms, coalesce(arg_max(u.end_ms, ord), 0) AS actual_end_ms
FROM sg LEFT JOIN u ON u.episode_id = sg.episode_id AND u.start_ms < sg.end_ms AND u.end_ms > sg.start_ms GROUP BY ALL"""


def speaker_runs_chunked(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one speaker as chunks of at most about 4,000 characters."""
    return U.speaker_chunks(_utterances(spark, folder)).select("episode_id", "first_ord", "label", "start_ms", "end_ms", "n_lines", "text")


def split_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in pieces of at most about 5,000 characters, with the pieces' identifiers."""
    pieces = split_greedy(table(spark, folder, "documents"), "text", ["doc_id"])
    name = F.when(F.col("pieces") > 1, F.concat(F.col("doc_id").cast("string"), F.lit("-chunk-"), F.col("piece").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return pieces.select("doc_id", "piece", name.alias("piece_id"), "text")


_B = r"[\x09-\x0d \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
def ad_filter_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Segments kept after promotions are dropped, with running ordinals; the label comes as a classifier's answer would."""
    order = F.row_number().over(Window.partitionBy("episode_id").orderBy("start_ms", "end_ms", "result_segment_id"))
    chunks = _segments(spark, folder).withColumn("place", order.cast("bigint"))
    answer = F.when(F.col("segment_type") == "promotion", F.lit(" advertisement ")).when(F.col("segment_type") != "other", F.lit("CONTENT"))
    return U.survivors(chunks, "place", M.is_advertisement(answer)).select("result_segment_id", "chunk_index", "total_chunks")


ADS = f"""WITH {_SG}, a AS (SELECT *, coalesce(segment_type = 'promotion', false) AS ad, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms, result_segment_id) AS place FROM sg),
b AS (SELECT *, coalesce(sum(CASE WHEN ad THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_index,
  (count(*) OVER (PARTITION BY episode_id) - sum(CASE WHEN ad THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY place ROWS UNBOUNDED PRECEDING))::BIGINT AS total_chunks FROM a)
SELECT result_segment_id, chunk_index, total_chunks FROM b WHERE NOT ad"""


def chapter_store(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters put into a store that has every second one in an older version: all their fields are replaced, the store's own note stays."""
    own = C.stable_id(F.col("episode_id"), F.lit("chapter"), F.col("chapter_id")).alias("id")
    new = _chapters(spark, folder).where("episode_id IS NOT NULL").select(own, "episode_id", "chapter_type", "title", "start_ms", "end_ms")
    old = new.where(F.col("start_ms") % 2 == 0).select("id", "episode_id", "chapter_type", F.lit("an older title").alias("title"), "start_ms", "end_ms", F.lit("kept").alias("note"))
    return E.upsert(old, new, ["id"], [], ["episode_id", "chapter_type", "title", "start_ms", "end_ms"], {"note": F.lit(None).cast("string")})


STORE = f"""WITH {_U}, {_CH} SELECT sha256(episode_id || '|chapter|' || chapter_id) AS id, episode_id, chapter_type, title, start_ms, end_ms, CASE WHEN start_ms % 2 = 0 THEN 'kept' END AS note, CASE WHEN start_ms % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action
FROM ch WHERE episode_id IS NOT NULL"""


_NOW, _GROUP = "2025-01-01T00:00:00.000Z", "podcasts"


def _said(spark: SparkSession, folder: str, chapters: DataFrame | None = None) -> DataFrame:
    """Each kept segment with its chapter, the text of its utterances and these as stored, and its actual range."""
    placed = _placed(spark, folder, True, chapters).where(~F.coalesce(F.col("segment_type").isin(*C.NOT_IN_GRAPH), F.lit(False)))
    rows = U.named(_utterances(spark, folder, text=False, raw=True), _speakers(spark, folder)).withColumnRenamed("episode_id", "ep")
    ranges = placed.select(F.col("episode_id").alias("ep"), "result_segment_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))
    stored = F.struct(F.col("segment_id").alias("id"), "start_time", "end_time", "transcript", "speaker_label")
    # A segment's utterances; its text is made of them after the shuffle.
    one = F.struct("ord", "start_ms", "end_ms", "name", stored.alias("stored"))
    found = interval_join(rows, ranges, "ep", "overlap", times=_times(spark, folder)).groupBy("result_segment_id").agg(F.array_sort(F.collect_list(one)).alias("u"))
    line = lambda x: line_of(x["name"], F.coalesce(x["stored"]["transcript"], F.lit("")))
    texts = found.select(
        "result_segment_id", F.array_join(F.transform("u", line), "\n").alias("transcript"), F.transform("u", lambda x: x["stored"]).alias("audio"),
        F.col("u")[0]["start_ms"].alias("actual_start_ms"), F.element_at("u", -1)["end_ms"].alias("actual_end_ms"),
    )
    return placed.join(texts, "result_segment_id", "left").join(_titles(spark, folder), "episode_id", "left").withColumnRenamed("result_segment_id", "segment_id").withColumn("context", F.lit(None).cast("string"))


def graph_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records for a knowledge graph: segments of kept kinds with context, transcript and metadata, in pieces. No model answers."""
    return G.segment_records(_said(spark, folder), _GROUP, F.lit(_NOW)).drop("episode_id")


def _pieces_sql(source: str, key: str, text: str) -> str:
    """Recursive cutting of texts beyond 5,000 characters: rows of the key, piece, part and last (the number of the last piece)."""
    return rf"""cutting AS (
  SELECT {key}, -1::BIGINT AS piece, NULL::VARCHAR AS part, {text} AS rest, length({text}) > 5000 AS long FROM {source} WHERE {text} IS NOT NULL
  UNION ALL
  SELECT {key}, piece + 1, CASE WHEN NOT long OR cut_at IS NULL THEN rest ELSE regexp_replace(left(rest, cut_at), '^{_B}+|{_B}+$', '', 'g') END,
    CASE WHEN NOT long OR cut_at IS NULL THEN NULL ELSE regexp_replace(substr(rest, cut_at + 1), '^{_B}+|{_B}+$', '', 'g') END, long
  FROM (SELECT *, CASE WHEN length(rest) > 5000 THEN
      CASE WHEN stop > 3500 THEN stop + 1 WHEN blank > 3500 THEN blank ELSE 5000 END END AS cut_at
    FROM (SELECT *, CASE WHEN contains(left(rest, 5002), '. ') THEN length(left(rest, 5002)) - instr(reverse(left(rest, 5002)), ' .') - 1 ELSE -1 END AS stop,
      CASE WHEN contains(left(rest, 5001), ' ') THEN length(left(rest, 5001)) - instr(reverse(left(rest, 5001)), ' ') ELSE -1 END AS blank
      FROM cutting WHERE rest IS NOT NULL AND (rest <> '' OR piece = -1)))
), numbered AS (SELECT *, max(piece) OVER (PARTITION BY {key}) AS last FROM cutting WHERE piece >= 0)"""


_CLOCK = "(({0} // 1000) // 60)::VARCHAR || ':' || lpad((({0} // 1000) % 60)::VARCHAR, 2, '0')"
_KEPT = f"""
k AS (SELECT m.* REPLACE (CASE WHEN c_a IS NULL THEN start_ms ELSE greatest(start_ms, c_a) END AS start_ms, CASE WHEN c_a IS NULL THEN end_ms ELSE least(end_ms, c_b) END AS end_ms) FROM m
  WHERE n = 1 AND coalesce(segment_type, '') NOT IN ('promotion', 'credits', 'sound-only')),
x AS (SELECT k.result_segment_id, string_agg('[' || name || '] ' || text, chr(10) ORDER BY ord) AS t, count(*) AS n_utterances, arg_min(un.start_ms, ord) AS s, arg_max(un.end_ms, ord) AS z,
    to_json(list(struct_pack(id := segment_id, start_time := start_time, end_time := end_time, transcript := transcript, speaker_label := speaker_label) ORDER BY ord)) AS audio
  FROM k JOIN un ON un.episode_id = k.episode_id AND un.start_ms < k.end_ms AND un.end_ms > k.start_ms GROUP BY ALL),
g AS (SELECT k.*, coalesce(s, 0) AS s, coalesce(z, 0) AS z, x.t, x.n_utterances, coalesce(audio, '[]') AS audio, series_id, coalesce(series_title, 'Untitled') AS st, coalesce(episode_title, 'Untitled') AS et, published_at,
    '<document>' || chr(10) || '<context>Segment from "' || coalesce(series_title, 'Untitled') || '" episode "' || coalesce(episode_title, 'Untitled') || '". ' || coalesce(segment_type, 'null') || ' at ' || {_CLOCK.format("k.start_ms")} || '.</context>' || chr(10)
    || '<transcript>' || chr(10) || coalesce(t, '') || chr(10) || '</transcript>' || chr(10) || '</document>' AS data
  FROM k LEFT JOIN x USING (result_segment_id) LEFT JOIN e ON e.episode_id = k.episode_id)"""
_SHORT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1} - 1) || '…' END"
GRAPH = f"""WITH RECURSIVE {_U}, {_NAMED}, {_CH}, {_SG}, {_MID}, {_TITLES}, {_KEPT}, {_pieces_sql("g", "result_segment_id", "data")},
o AS (SELECT g.*, piece, part, CASE WHEN last > 0 THEN result_segment_id || '-chunk-' || piece ELSE result_segment_id END AS own, {_CLOCK.format("s")} AS sc, {_CLOCK.format("z")} AS zc FROM numbered JOIN g USING (result_segment_id))
SELECT own AS record_id, piece, 'json' AS type, {_SHORT.format("st", 12)} || ' - ' || {_SHORT.format("et", 15)} || ' - ' || sc || '-' || zc AS name, part AS data, '{_GROUP}' AS group_id, coalesce(published_at, '{_NOW}') AS created_at,
  st || ', ' || et || ', segment ' || own || ', ' || sc || ' - ' || zc AS source_description,
  '{{"series_id":' || coalesce(to_json(series_id)::VARCHAR, 'null') || ',"series_title":' || to_json(st)::VARCHAR || ',"episode_id":' || coalesce(to_json(episode_id)::VARCHAR, 'null') || ',"episode_title":' || to_json(et)::VARCHAR
  || ',"segment_id":' || to_json(own)::VARCHAR || ',"segment_type":' || coalesce(to_json(segment_type)::VARCHAR, 'null') || ',"chapter_id":' || coalesce(to_json(chapter_id)::VARCHAR, 'null')
  || ',"episode_start_sec":' || to_json(s / 1000)::VARCHAR || ',"episode_end_sec":' || to_json(z / 1000)::VARCHAR
  || ',"lucidity":' || coalesce(to_json(lucidity)::VARCHAR, 'null') || ',"polarity":' || coalesce(to_json(polarity)::VARCHAR, 'null') || ',"arousal":' || coalesce(to_json(arousal)::VARCHAR, 'null')
  || ',"subjectivity":' || coalesce(to_json(subjectivity)::VARCHAR, 'null') || ',"humor":' || coalesce(to_json(humor)::VARCHAR, 'null') || ',"audio_segments":' || CASE WHEN piece = 0 THEN audio::VARCHAR ELSE '[]' END || '}}' AS metadata
FROM o"""


def chunk_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of one speaker's chunks, those that a classifier calls advertisements left out; here it calls so what speaks of a sponsor."""
    chunks = U.speaker_chunks(_utterances(spark, folder)).withColumn("chunk_text", M.shown(F.col("text"), "advertisement"))
    answer = F.when(F.lower("chunk_text").contains("sponsor"), F.lit("ADVERTISEMENT")).otherwise(F.lit("CONTENT"))
    kept = U.survivors(chunks, "first_ord", M.is_advertisement(answer)).join(_titles(spark, folder), "episode_id").where("episode_title IS NOT NULL AND series_title IS NOT NULL")
    return G.chunk_messages(kept.withColumn("context", F.lit(None).cast("string")), _GROUP, F.lit(_NOW))


_FOLD = """l AS MATERIALIZED (SELECT *, label || ': ' || text AS line FROM u), f AS (
  SELECT episode_id, ord, label, line, ord AS first_ord, length(line) AS size FROM l WHERE ord = 0
  UNION ALL
  SELECT l.episode_id, l.ord, l.label, l.line, CASE WHEN l.label <> f.label OR f.size + length(l.line) > 4000 THEN l.ord ELSE f.first_ord END,
    CASE WHEN l.label <> f.label OR f.size + length(l.line) > 4000 THEN length(l.line) ELSE f.size + 1 + length(l.line) END
  FROM f JOIN l ON l.episode_id = f.episode_id AND l.ord = f.ord + 1),
c AS (SELECT f.episode_id, first_ord, any_value(f.label) AS label, arg_min(l.start_ms, f.ord) AS start_ms, arg_max(l.end_ms, f.ord) AS end_ms, count(*) AS n_lines, string_agg(f.line, chr(10) ORDER BY f.ord) AS text
  FROM f JOIN l ON l.episode_id = f.episode_id AND l.ord = f.ord GROUP BY f.episode_id, first_ord)"""
MESSAGES = f"""WITH RECURSIVE {_U}, {_FOLD}, {_TITLES}, a AS (SELECT *, contains(lower(left(text, 2000)), 'sponsor') AS ad FROM c),
b AS (SELECT *, coalesce(sum(CASE WHEN ad THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY first_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_index,
  (count(*) OVER (PARTITION BY episode_id) - sum(CASE WHEN ad THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY first_ord ROWS UNBOUNDED PRECEDING))::BIGINT AS total_chunks FROM a),
o AS (SELECT *, 'Transcript chunk from ' || series_title || ' - ' || episode_title || ', spoken by ' || label AS ctx FROM b JOIN e USING (episode_id) WHERE NOT ad AND episode_title IS NOT NULL AND series_title IS NOT NULL)
SELECT episode_id, chunk_index, '{_GROUP}' AS group_id, label || ': ' || text AS content, 'user' AS role_type, label AS role, '{_NOW}' AS timestamp,
  'Podcast transcript chunk ' || (chunk_index + 1) || '/' || total_chunks || ' from "' || episode_title || '" (' || series_title || '). Time: ' || {_CLOCK.format("start_ms")} || ' - ' || {_CLOCK.format("end_ms")} || '. Context: ' || ctx AS source_description,
  '{{"series_id":' || coalesce(to_json(series_id)::VARCHAR, 'null') || ',"series_title":' || to_json(series_title)::VARCHAR || ',"episode_id":' || to_json(episode_id)::VARCHAR || ',"episode_title":' || to_json(episode_title)::VARCHAR
  || ',"speaker_label":' || to_json(label)::VARCHAR || ',"start_time":' || to_json(start_ms / 1000)::VARCHAR || ',"end_time":' || to_json(end_ms / 1000)::VARCHAR
  || ',"chunk_index":' || chunk_index || ',"total_chunks":' || total_chunks || ',"context_summary":' || to_json(ctx)::VARCHAR || '}}' AS metadata FROM o"""


def model_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What models are asked about each episode: its speakers (by their samples) and its chapters (by the timeline), as JSON."""
    rows = _utterances(spark, folder)
    lines = lambda of, text, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(of).alias("o"), text.alias("t")))), lambda x: x["t"]), glue)
    titles = _titles(spark, folder)
    numbered = F.concat(F.lit("  "), F.col("sample").cast("string"), F.lit('. "'), F.col("text"), F.lit('"'))
    per_label = U.samples(rows).groupBy("episode_id", "label").agg(lines("sample", numbered, "\n").alias("t"))
    order = U.labels_in_order(rows).select("episode_id", "label", "place")
    speakers = per_label.join(order, ["episode_id", "label"]).groupBy("episode_id").agg(lines("place", F.col("label"), ", ").alias("labels"), lines("place", F.concat("label", F.lit(":\n"), "t"), "\n\n").alias("samples"))
    blocks = U.timeline(U.named(rows, _speakers(spark, folder)))
    summary = blocks.groupBy("episode_id").agg(lines("block", line_of(F.col("label"), F.col("text")), "\n").alias("timeline"))
    aims = U.targets(_lengths(spark, folder)).select("episode_id", "chapters")
    one = speakers.join(titles, "episode_id").select("episode_id", F.lit("speakers").alias("asked"), M.request(series=F.col("series_title"), episode=F.col("episode_title"), labels=F.col("labels"), samples=F.col("samples")).alias("request"))
    two = summary.join(aims, "episode_id").join(titles, "episode_id").select("episode_id", F.lit("chapters").alias("asked"), M.request(series=F.col("series_title"), episode=F.col("episode_title"), target=F.col("chapters"), timeline=F.col("timeline")).alias("request"))
    return one.unionByName(two)


_PART = """CASE WHEN {1} IS NULL THEN '' ELSE '"{0}":' || to_json({1})::VARCHAR || ',' END"""
REQUESTS = f"""WITH {_U}, {_NAMED}, {_TITLES}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, label ORDER BY ord) AS sample FROM u), p AS (SELECT episode_id, label, min(ord) AS place FROM u GROUP BY ALL),
q AS (SELECT episode_id, label, string_agg('  ' || sample || '. "' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END || '"', chr(10) ORDER BY sample) AS t FROM r WHERE sample <= 5 GROUP BY ALL),
s2 AS (SELECT episode_id, string_agg(label, ', ' ORDER BY place) AS labels, string_agg(label || ':' || chr(10) || t, chr(10) || chr(10) ORDER BY place) AS samples FROM q JOIN p USING (episode_id, label) GROUP BY ALL),
t AS (SELECT episode_id, start_ms // 30000 AS block, string_agg('[' || name || '] ' || text, ' ' ORDER BY ord) x FROM un WHERE start_ms >= 0 GROUP BY ALL),
tl AS (SELECT episode_id, string_agg('[' || (block * 30 // 60)::BIGINT || ':' || lpad((block * 30 % 60)::BIGINT::VARCHAR, 2, '0') || '] ' || CASE WHEN length(x) > 300 THEN left(x, 300) || '...' ELSE x END, chr(10) ORDER BY block) AS timeline FROM t GROUP BY ALL)
SELECT episode_id, 'speakers' AS asked, '{{' || {_PART.format("series", "series_title")} || {_PART.format("episode", "episode_title")} || '"labels":' || to_json(labels)::VARCHAR || ',"samples":' || to_json(samples)::VARCHAR || '}}' AS request FROM s2 JOIN e USING (episode_id)
UNION ALL SELECT episode_id, 'chapters', '{{' || {_PART.format("series", "series_title")} || {_PART.format("episode", "episode_title")} || '"target":' || least(greatest(CAST(floor(duration_ms / 60000.0 / 4 + 0.5) AS BIGINT), 5), 15) || ',"timeline":' || to_json(timeline)::VARCHAR || '}}' FROM tl JOIN d USING (episode_id) JOIN e USING (episode_id)"""


def segment_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What a model is asked about each chapter: its beginning as lines with times and names, and how many segments to find."""
    rows = U.named(_utterances(spark, folder), _speakers(spark, folder)).withColumnRenamed("episode_id", "ep")
    chapters = _chapters(spark, folder)
    ranges = chapters.select(F.col("episode_id").alias("ep"), "chapter_id", F.col("start_ms").alias("a_ms"), F.col("end_ms").alias("b_ms"))
    line = F.concat(F.lit("["), minutes_label(F.col("start_ms") / 1000), F.lit("] "), line_of(F.col("name"), F.col("text")))
    texts = U.excerpts(interval_join(rows, ranges, "ep", "start_in", times=_times(spark, folder)), "chapter_id", line, "\n").select("chapter_id", M.shown(F.col("excerpt"), "chapter").alias("text"))
    aims = U.targets(_lengths(spark, folder)).select("episode_id", "duration_ms", "segments")
    joined = chapters.join(aims, "episode_id").join(texts, "chapter_id", "left")
    return joined.select("chapter_id", U.part_of_target(F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), F.col("segments")).alias("target"), F.coalesce("text", F.lit("")).alias("text"))


SEGMENT_REQUESTS = f"""WITH {_U}, {_NAMED}, {_CH}, x AS (SELECT chapter_id, string_agg('[' || {_CLOCK.format("un.start_ms")} || '] [' || name || '] ' || text, chr(10) ORDER BY ord) t FROM ch JOIN un ON un.episode_id = ch.episode_id AND un.start_ms >= ch.start_ms AND un.start_ms < ch.end_ms GROUP BY ALL)
SELECT chapter_id, greatest(1, CAST(floor((end_ms - start_ms) / duration_ms * least(greatest(CAST(floor(duration_ms / 3600000.0 * 40 + 0.5) AS BIGINT), 20), 60) + 0.5) AS BIGINT)) AS target, coalesce(left(t, 6000), '') AS text
FROM ch JOIN d USING (episode_id) LEFT JOIN x USING (chapter_id)"""


def _answers(rows: DataFrame, key: str, what: str, place: str, **fields: str) -> DataFrame:
    """Tables of results as the JSON that a model would have answered."""
    one = F.struct(F.col(place).alias("_place"), *[F.col(c).alias(n) for n, c in fields.items()])
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[n].alias(n) for n in fields]))
    return rows.groupBy(key).agg(F.to_json(F.struct(listed.alias(what))).alias("answer"))


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers, chapters and segments read from models' answers; recorded answers are made of the tables of results, and one isn't JSON."""
    s = table(spark, folder, "episode_speakers").distinct().withColumn("o", F.struct("speaker_id", "speaker_name", "speaker_role", "reasoning"))
    c = table(spark, folder, "chapter_results").where("start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec)").select("episode_id", "chapter_row_id", "chapter_type", "title", "summary", "start_sec", "end_sec").distinct()
    g = table(spark, folder, "segment_results").where("start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec)").select("episode_id", "result_segment_id", "segment_type", "start_sec", "end_sec", *G.METRICS).distinct()
    broken = spark.createDataFrame([("broken", "{no json")], "episode_id string, answer string")
    speakers = M.parse_speakers(_answers(s, "episode_id", "speakers", "o", id="speaker_id", name="speaker_name", role="speaker_role", reasoning="reasoning").unionByName(broken), "answer", ["episode_id"])
    chapters = M.parse_chapters(_answers(c, "episode_id", "chapters", "chapter_row_id", type="chapter_type", title="title", summary="summary", start_sec="start_sec", end_sec="end_sec").unionByName(broken), "answer", ["episode_id"])
    order = g.withColumn("o", F.struct("result_segment_id", "segment_type", "start_sec", "end_sec"))
    segments = M.parse_segments(_answers(order, "episode_id", "segments", "o", type="segment_type", start_sec="start_sec", end_sec="end_sec", **{m: m for m in G.METRICS}).unionByName(broken), "answer", ["episode_id"])
    flat = lambda df, what, label, value: df.select("episode_id", F.lit(what).alias("what"), "place", F.col(label).alias("label"), value.alias("value"))
    return (
        flat(speakers, "speaker", "id", F.col("name")).unionByName(flat(chapters, "chapter", "type", F.floor(F.col("end_sec") * 1000 + 0.5).cast("string"))).unionByName(flat(segments, "segment", "type", F.floor(F.col("humor") * 100 + 0.5).cast("string")))
    )


ANSWERS = """WITH s AS (SELECT DISTINCT * FROM episode_speakers), c AS (SELECT DISTINCT episode_id, chapter_row_id, chapter_type, title, summary, start_sec, end_sec FROM chapter_results WHERE NOT coalesce(isnan(start_sec), true) AND NOT coalesce(isnan(end_sec), true)),
g AS (SELECT DISTINCT episode_id, result_segment_id, segment_type, start_sec, end_sec, lucidity, polarity, arousal, subjectivity, humor FROM segment_results WHERE NOT coalesce(isnan(start_sec), true) AND NOT coalesce(isnan(end_sec), true))
SELECT episode_id, 'speaker' AS what, row_number() OVER (PARTITION BY episode_id ORDER BY speaker_id NULLS FIRST, speaker_name NULLS FIRST, speaker_role NULLS FIRST, reasoning NULLS FIRST) - 1 AS place, speaker_id AS label, speaker_name AS value FROM s
UNION ALL SELECT episode_id, 'chapter', row_number() OVER (PARTITION BY episode_id ORDER BY chapter_row_id) - 1, chapter_type, CAST(floor(end_sec * 1000 + 0.5) AS BIGINT)::VARCHAR FROM c
UNION ALL SELECT episode_id, 'segment', row_number() OVER (PARTITION BY episode_id ORDER BY result_segment_id, segment_type NULLS FIRST, start_sec, end_sec) - 1, segment_type, CAST(floor(humor * 100 + 0.5) AS BIGINT)::VARCHAR FROM g"""


def transcript_processing(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts end to end, with the tables of results as recorded answers of the models: per episode, what comes out of each step.

    Speakers are the listed ones and those missing for a label, chapters are repaired or the default
    ones, segments are cut to the chapter of their middle, and the kept ones become records of the
    graph with context, transcript and metadata, in pieces. Contexts take their fallback.
    """
    # Written down once: what several steps start from, a row per episode and one per chapter.
    lengths = checkpointed(_lengths(spark, folder))
    chapters = checkpointed(_chapters(spark, folder, lengths))
    labels = U.labels_in_order(_utterances(spark, folder, text=False))
    known = _speakers(spark, folder).withColumn("place", F.lit(0))
    speakers = U.fill_speakers(labels, known).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_speakers"))
    records = G.segment_records(_said(spark, folder, chapters), _GROUP, F.lit(_NOW))
    made = records.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum((F.col("piece") == 0).cast("bigint")).alias("n_segments"), F.sum(F.char_length("data")).alias("n_chars"))
    counted = chapters.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    return lengths.join(speakers, "episode_id", "left").join(counted, "episode_id", "left").join(made, "episode_id", "left").select("episode_id", "duration_ms", "n_speakers", "n_chapters", "n_segments", "n_records", "n_chars")


PROCESSING = f"""WITH RECURSIVE {_U}, {_NAMED}, {_CH}, {_SG}, {_MID}, {_TITLES}, {_KEPT}, {_pieces_sql("g", "result_segment_id", "data")},
v AS (SELECT episode_id, count(*) AS n_speakers FROM (SELECT episode_id, speaker_id AS label FROM episode_speakers UNION SELECT episode_id, label FROM u) GROUP BY ALL),
w AS (SELECT episode_id, count(*) AS n_chapters FROM ch GROUP BY ALL),
y AS (SELECT episode_id, count(*) AS n_records, count(*) FILTER (piece = 0) AS n_segments, sum(length(part))::BIGINT AS n_chars FROM numbered JOIN g USING (result_segment_id) GROUP BY ALL)
SELECT episode_id, duration_ms, n_speakers, n_chapters, n_segments, n_records, n_chars FROM d LEFT JOIN v USING (episode_id) LEFT JOIN w USING (episode_id) LEFT JOIN y USING (episode_id)"""


def flagship_fallback_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript processing with a provider that never answers: per episode, what each step falls back to.

    Speakers and chapters are the default ones; a chapter without an answer has no segments, so
    nothing goes into the graph.
    """
    aims = U.targets(_lengths(spark, folder))
    asked = M.ask(aims, M.Offline(), ["episode_id"])
    chapters = C.default_chapters(asked.where("answer IS NULL").select("episode_id", "duration_ms"))
    segments = M.parse_segments(M.ask(chapters, M.Offline(), ["episode_id", "chapter"]), "answer", ["episode_id"])
    rows = _utterances(spark, folder, text=False)
    speakers = U.default_speakers(U.labels_in_order(rows)).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_speakers"))
    blocks = rows.where("start_ms >= 0").groupBy("episode_id").agg(F.countDistinct(F.floor(F.col("start_ms") / 30_000)).alias("n_blocks"))
    counted = chapters.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    found = segments.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    joined = aims.join(speakers, "episode_id").join(blocks, "episode_id", "left").join(counted, "episode_id", "left").join(found, "episode_id", "left")
    return joined.select("episode_id", "duration_ms", "chapters", "segments", "n_speakers", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"), F.coalesce("n", F.lit(0)).alias("n_segments"))


FLAGSHIP = f"""WITH {_U} SELECT episode_id, duration_ms, least(greatest(CAST(floor(duration_ms / 60000.0 / 4 + 0.5) AS BIGINT), 5), 15) AS chapters, least(greatest(CAST(floor(duration_ms / 3600000.0 * 40 + 0.5) AS BIGINT), 20), 60) AS segments,
  g.n_speakers, g.n_blocks, CASE WHEN duration_ms IS NULL THEN 0 ELSE 3 END AS n_chapters, 0 AS n_segments
FROM d JOIN (SELECT episode_id, count(DISTINCT label) AS n_speakers, count(DISTINCT start_ms // 30000) FILTER (start_ms >= 0) AS n_blocks FROM u GROUP BY ALL) g USING (episode_id)"""

CHUNKS = f"WITH RECURSIVE {_U}, {_FOLD} SELECT * FROM c"
SPLIT = f"""WITH RECURSIVE {_pieces_sql("documents", "doc_id", "text")}
SELECT doc_id, piece, CASE WHEN last > 0 THEN doc_id::VARCHAR || '-chunk-' || piece::VARCHAR ELSE doc_id::VARCHAR END AS piece_id, part AS text FROM numbered"""

_HOW = {"containment": "u.start_ms >= ch.start_ms AND u.end_ms <= ch.end_ms", "start_in": "u.start_ms >= ch.start_ms AND u.start_ms < ch.end_ms", "overlap": "u.start_ms < ch.end_ms AND u.end_ms > ch.start_ms"}

QUERIES = {
    "transcript_timeline": transcript_timeline, "speaker_labels_first_seen": speaker_labels_first_seen, "speaker_fill": speaker_fill, "speaker_samples_top5": speaker_samples_top5,
    "episode_duration_targets": episode_duration_targets, "default_chapters": default_chapters, "chapter_repair": chapter_repair, **{f"excerpt_{h}": _excerpt(h) for h in _HOW},
    "midpoint_chapter": midpoint_chapter, "clamp_segments": clamp_segments, "actual_range": actual_range, "speaker_runs_chunked": speaker_runs_chunked, "split_documents": split_documents,
    "ad_filter_ordinals": ad_filter_ordinals, "chapter_store": chapter_store, "graph_records": graph_records, "chunk_messages": chunk_messages, "model_requests": model_requests, "segment_requests": segment_requests, "model_answers": model_answers,
    "transcript_processing": transcript_processing, "flagship_fallback_pipeline": flagship_fallback_pipeline,
}
SQL = {
    "transcript_timeline": TIMELINE, "speaker_labels_first_seen": LABELS, "speaker_fill": FILL, "speaker_samples_top5": SAMPLES,
    "episode_duration_targets": TARGETS, "default_chapters": DEFAULTS, "chapter_repair": REPAIR, **{f"excerpt_{h}": _excerpt_sql(c) for h, c in _HOW.items()},
    "midpoint_chapter": MIDPOINT, "clamp_segments": CLAMP, "actual_range": ACTUAL, "speaker_runs_chunked": CHUNKS, "split_documents": SPLIT,
    "ad_filter_ordinals": ADS, "chapter_store": STORE, "graph_records": GRAPH, "chunk_messages": MESSAGES, "model_requests": REQUESTS, "segment_requests": SEGMENT_REQUESTS, "model_answers": ANSWERS,
    "transcript_processing": PROCESSING, "flagship_fallback_pipeline": FLAGSHIP,
}
