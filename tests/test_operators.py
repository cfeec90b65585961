"""Operators against plain loops, with the edge rows of feeds and transcripts."""

import json
import random
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.functions import compat as K
from earshot.operators import chapters, feeds, jobs, models, scans, transcripts
from earshot.operators.texts import greedy_pieces
from earshot.sources import media, sinks


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_scalar_functions(spark):
    x = F.col("x")
    assert values(spark, K.plain_duration(x), [(t,) for t in ("", "90", "12.5", "1:30", "1:02:03", "a:b", None)]) == [None, 90, None, 90, 3723, None, None]
    assert values(spark, K.half_up(x), [(2.5,), (-2.5,), (0.49,)], "x double") == [3, -2, 0]
    assert values(spark, K.clamp(x, 1, 5), [(0.0,), (9.0,), (None,)], "x double") == [1.0, 5.0, None]
    assert values(spark, K.minutes_label(x), [(125.9,), (0.0,), (7200.0,)], "x double") == ["2:05", "0:00", "120:00"]
    assert values(spark, K.leading_number(x), [("12.5x",), (" -3",), ("x",), (None,)]) == [12.5, -3.0, None, None]
    assert values(spark, K.ellipsize(x, 4), [("abcd",), ("abcde",), (None,)]) == ["abcd", "abc…", None]
    assert values(spark, K.utf16_length(x), [("a😀",)]) == [3]
    assert values(spark, K.query_value(x), [("a b&c",)]) == ["a%20b%26c"]
    assert values(spark, K.query_value(x), [("it's (a) ~b!*",)]) == ["it's%20(a)%20~b!*"]
    assert values(spark, K.fixed(x, 1), [(0.25,), (2.0,), (None,)], "x double") == ["0.3", "2.0", None]
    assert values(spark, K.leading_int(x), [("007x",), ("0" * 30 + "5",), ("9" * 30,), ("-3",)]) == [7, 5, None, -3]
    assert values(spark, K.clock_ms(x), [("0" * 12 + "5",), ("9" * 20,), ("1:" + "0" * 12 + "5",), ("9" * 20 + ":00",)]) == [5000, None, 65000, None]
    assert values(spark, K.trimmed(x), [("  a　\n",)]) == ["a"]
    assert values(spark, K.clock_ms(x), [("12.5",), ("12,5",), (" 3.1s",), ("1:02:03.5",), ("0:00.539",), ("x",), (None,), ("",), ("1:x",)]) == [12500, 12500, 3100, 3723500, 539, None, None, None, None]
    dates = [("Fri, 01 Apr 2022 13:55:16 -0500",), ("01 Apr 2022 13:55:16 GMT",), ("2021-01-12T10:55:16Z",), ("yesterday",), ("2021-13-02",), (None,), ("",)]
    got = values(spark, F.unix_timestamp(K.feed_date(F.col("x"))), dates)
    assert got == [int(datetime(2022, 4, 1, 18, 55, 16, tzinfo=timezone.utc).timestamp()), int(datetime(2022, 4, 1, 13, 55, 16, tzinfo=timezone.utc).timestamp()), int(datetime(2021, 1, 12, 10, 55, 16, tzinfo=timezone.utc).timestamp()), None, None, None, None]
    urls = [("https://a.b/c.m4a?x=1.mp3", None), ("https://a.b/c", "audio/ogg"), ("not a url", None), (None, None), ("https://a.b/c.MP3", "audio/ogg")]
    assert values(spark, K.file_extension(F.col("u"), F.col("t")), urls, "u string, t string") == ["m4a", "ogg", "mp3", "mp3", "mp3"]
    assert values(spark, K.file_extension(F.col("u"), F.col("t"), "image"), [("https://a.b/c.jpeg", None), ("https://a.b/", "image/webp")], "u string, t string") == ["jpg", "webp"]
    assert values(spark, K.image_mime(F.col("x")), [("png",), ("bmp",), ("svg",)]) == ["image/png", "image/jpeg", "image/svg+xml"]
    feed = {n: F.col(n) for n in ("title", "summary", "description", "explicit", "categories", "series_type", "author")}
    row = spark.createDataFrame([("", "sum", "", "true", [], "other", "")], "title string, summary string, description string, explicit string, categories array<string>, series_type string, author string").select(*feeds.series_row(feed, F.lit("old"))).first()
    assert row.asDict() == {"title": "old", "description": "sum", "categories": None, "explicit": True, "series_type": "episodic", "author": None}
    assert spark.range(1).select(feeds.first_of(F.array(F.lit("a"), F.lit("b"))), feeds.first_of(F.array().cast("array<string>"))).first()[:] == ("a", None)
    w, h = K.fit_inside(F.col("w"), F.col("h"), F.lit(100.0), F.lit(100.0))
    assert [tuple(r) for r in spark.createDataFrame([(200.0, 50.0), (10.0, 10.0)], "w double, h double").select(w, h).collect()] == [(100, 25), (10, 10)]


def repaired(rows, duration, least=10_000):
    rows = [list(r) for r in sorted(rows)]
    if not rows:
        return []
    rows[0][0] = min(rows[0][0], 0)
    rows[-1][1] = max(rows[-1][1], duration)
    for a, b in zip(rows, rows[1:], strict=False):
        b[0] = a[1]
    return [tuple(r) for r in rows if r[1] - r[0] >= least]


def test_chapter_repair(spark):
    rng = random.Random(1)
    lists = {f"e{i}": [(rng.randint(-5_000, 90_000), 0, j) for j in range(rng.randint(1, 6))] for i in range(60)}
    lists = {k: [(s, s + rng.randint(-2_000, 40_000), j) for s, _, j in v] for k, v in lists.items()}
    df = spark.createDataFrame([(k, j, s, e) for k, v in lists.items() for s, e, j in v] + [("e0", 99, None, 5)], "episode_id string, j int, start_ms bigint, end_ms bigint")
    lengths = spark.createDataFrame([(k, 100_000) for k in lists], "episode_id string, duration_ms bigint")
    got = {}
    for r in chapters.repair_chapters(df, lengths, "j").collect():
        got.setdefault(r.episode_id, []).append((r.start_ms, r.end_ms))
    for k, v in lists.items():
        want = repaired([(s, e) for s, e, j in sorted(v, key=lambda x: (x[0], x[2]))] if len({x[0] for x in v}) == len(v) else [(s, e) for s, e, _ in v], 100_000)
        assert sorted(got.get(k, [])) == sorted(want)


def test_default_chapters(spark):
    rows = chapters.default_chapters(spark.createDataFrame([("a", 100_000), ("b", None), ("c", 3_600_000)], "episode_id string, duration_ms bigint")).collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, 10_000), (10_000, 90_000), (90_000, 100_000), (0, 60_000), (60_000, 3_540_000), (3_540_000, 3_600_000)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 60))
def test_greedy_pieces(text, limit):
    pieces = greedy_pieces(text, limit, limit * 7 // 10)
    assert all(len(p) <= limit + 1 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    if len(text) <= limit:
        assert pieces == [text]


def test_greedy_edges():
    assert len(greedy_pieces("x" * 5000)) == 1 and [len(p) for p in greedy_pieces("x" * 5001)] == [5000, 1]
    at = lambda i: "x" * i + ". " + "y" * (6000 - i)
    assert len(greedy_pieces(at(3501))[0]) == 3502 and len(greedy_pieces(at(5000))[0]) == 5001
    assert len(greedy_pieces(at(3500))[0]) == 3501  # the blank after the full stop, not the stop itself
    assert len(greedy_pieces(at(3400))[0]) == 5000


def test_running_sum(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None, "b"]), i, rng.choice([None, 1, 2, -3])) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("b", F.floor(F.col("i") / 7))
    got = {r.i: r.s for r in scans.running_sum(df, ["k"], "b", ["i"], F.col("v"), "s").collect()}
    total = {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        assert got[i] == total[k]
    assert scans.ordinals(df.limit(0), ["k"], "b", ["i"]).count() == 0
    previous = {r.i: r.p for r in scans.lagged(df, ["k"], "b", "i", "v", "p").collect()}
    last = {}
    for k, i, v in rows:
        assert previous[i] == last.get(k)
        last[k] = v


def utterance_rows(spark, rows):
    return spark.createDataFrame([("e", i, label, text, i * 1000, i * 1000 + 900) for i, (label, text) in enumerate(rows)], "episode_id string, ord bigint, label string, text string, start_ms bigint, end_ms bigint")


def test_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["spk_0", "spk_0", "spk_1"]), "x" * rng.choice([1, 30, 90, 200])) for _ in range(80)]
    want, key, size = [], None, 0
    for label, text in rows:
        line = f"{label}: {text}"
        if label != key or size + len(line) > 150:
            want.append([label, [line]])
            key, size = label, len(line)
        else:
            want[-1][1].append(line)
            size += 1 + len(line)
    got = transcripts.speaker_chunks(utterance_rows(spark, rows), 150).orderBy("first_ord").collect()
    assert [(r.label, r.text) for r in got] == [(a, "\n".join(b)) for a, b in want]
    assert transcripts.speaker_chunks(utterance_rows(spark, rows).limit(0)).count() == 0


def test_survivors(spark):
    df = spark.createDataFrame([("e", i, ad) for i, ad in enumerate([False, True, None, True, False])], "episode_id string, i int, ad boolean")
    assert [(r.i, r.chunk_index, r.total_chunks) for r in transcripts.survivors(df, "i", F.col("ad")).orderBy("i").collect()] == [(0, 0, 5), (2, 1, 4), (4, 2, 3)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5, "u", "complete"), (2, "b", None, "v", "failed")], "k int, title string, n bigint, url string, status string")
    new = spark.createDataFrame([(1, None, None, None), (3, "c", 7, "w")], "k int, title string, n bigint, url string")
    once = feeds.upsert(old, new, ["k"], ["title", "n"], ["url"], {"status": F.lit("pending")})
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5, None, "complete", "updated"), (2, "b", None, "v", "failed", "kept"), (3, "c", 7, "w", "pending", "inserted")]
    again = feeds.upsert(once.drop("action"), new, ["k"], ["title", "n"], ["url"], {"status": F.lit("pending")})
    assert sorted(map(tuple, again.drop("action").collect())) == sorted(map(tuple, once.drop("action").collect()))


def test_models(spark):
    class Echo:
        def answer(self, requests):
            return [None if r["x"] == "bad" else r["x"].upper() for r in requests]

    class Broken:
        def answer(self, requests):
            raise RuntimeError

    df = spark.createDataFrame([("a",), ("bad",)], "x string")
    assert sorted(map(tuple, models.ask(df, Echo(), ["x"], concurrency=1).collect())) == [("a", "A"), ("bad", None)]
    assert {r.answer for r in models.ask(df, Broken(), ["x"]).collect()} == {None}
    assert values(spark, models.is_advertisement(F.col("x")), [(" advertisement ",), ("CONTENT",), (None,)]) == [True, False, False]


def test_feed_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<rss xmlns:itunes="x"><channel><title>T</title><item><guid>g1</guid><title>A &amp; B</title><pubDate>01 Apr 2022 13:55:16 GMT</pubDate><enclosure url="https://a.b/c.mp3" type="audio/mpeg" length="12"/><itunes:duration>1:30</itunes:duration></item>'
        "<item><title>only a title</title></item></channel></rss>"
    )
    rows = media.feed_items(spark, str(tmp_path / "feed.xml")).orderBy("title").collect()
    assert [(r.guid, r.title) for r in rows] == [("g1", "A & B"), (None, "only a title")]
    assert rows[0].enclosure["_url"] == "https://a.b/c.mp3" and rows[0]["itunes:duration"] == "1:30"


def test_transcript_files(spark, tmp_path):
    place = tmp_path / "processed" / "m1"
    place.mkdir(parents=True)
    segments = [{"id": str(i), "start_time": f"{9 - i}.5", "end_time": "12", "transcript": "t", "speaker_label": "spk_0", "items": [1]} for i in range(3)]
    (place / "transcript.json").write_text(json.dumps({"results": {"audio_segments": segments}}))
    bad = tmp_path / "processed" / "m2"
    bad.mkdir()
    (bad / "transcript.json").write_text("not json")
    rows = media.transcript_files(spark, str(tmp_path / "processed" / "*" / "transcript.json")).orderBy("media_id", "ord").collect()
    assert [(r.media_id, r.ord, r.id, r.error) for r in rows] == [("m1", 0, "0", None), ("m1", 1, "1", None), ("m1", 2, "2", None), ("m2", None, None, "no transcript")]


def test_categories(spark):
    doc = [{"_text": "Arts", "category": [{"_text": "Books"}, {"_VALUE": "Design"}, {"_text": ""}]}, {"_text": "News"}]
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", f"array<{feeds.category_type(3).simpleString()}>").alias("c"))
    assert df.select(feeds.flatten_categories(F.col("c"), 3)).first()[0] == ["Arts", "Books", "Design", "News"]
    xml = "<channel>" + "".join(f'<itunes:category text="c{i}">' for i in range(40)) + "</itunes:category>" * 40 + "<category text='R &amp; D'/><itunes:category text=''/></channel>"
    assert values(spark, feeds.category_names(F.col("x")), [(xml,), ("<x/>",)]) == [[f"c{i}" for i in range(40)] + ["R & D"], []]


@pytest.mark.parametrize("stem", ["a", "b"])
def test_blobs(spark, tmp_path, stem):
    (tmp_path / f"{stem}.bin").write_bytes(b"12")
    assert media.blobs(spark, str(tmp_path)).select("length").first()[0] == 2


def test_completion(spark):
    rows = [("a", "transcode", "ERROR", 1, 1), ("a", "transcribe", "COMPLETED", 2, 2), ("b", "transcribe", "COMPLETED", 1, 3), ("b", "transcode", "error", 2, 4), ("c", "transcode", "COMPLETE", 1, 5), ("c", "transcribe", "IN_PROGRESS", 2, 6), ("d", "transcode", "COMPLETE", 3, 7), ("d", "transcribe", "COMPLETED", 4, 8)]
    df = spark.createDataFrame(rows, "episode_id string, job string, status string, ts int, seq int")
    assert dict(map(tuple, jobs.completion(df).collect())) == {"a": "complete", "b": "failed", "d": "complete"}
    assert dict(map(tuple, jobs.completion(df, strict=True).collect())) == {"a": "failed", "b": "failed", "c": "waiting", "d": "complete"}


def test_responses_and_small_parts(spark):
    df = spark.createDataFrame([("/image/ab-1.jpg", b"x"), ("/image/ab-1.jpg", None), ("/x", b"x")], "p string, c binary")
    r = jobs.response(K.image_request(F.col("p"), F.lit(None).cast("string"), F.lit("5")), F.col("c"), F.lit("image/jpeg"))
    got = [x.r for x in df.select(r.alias("r")).collect()]
    assert [(x.status, x.body, x.is_base64) for x in got] == [(200, "eA==", True), (404, None, False), (404, None, False)]
    assert got[0].headers["Content-Type"] == "image/jpeg"
    doc = [{"id": "1", "start_time": "0", "end_time": "1", "transcript": "t", "speaker_label": "s", "items": [1]}]
    u = spark.createDataFrame([(json.dumps({"results": {"audio_segments": doc}}),)], "j string").select(F.from_json("j", media.TRANSCRIPT).alias("d"))
    assert u.select(jobs.without_items(F.col("d.results.audio_segments"))).first()[0][0].asDict().keys() == {"id", "start_time", "end_time", "transcript", "speaker_label"}
    assert values(spark, jobs.doubled_label(F.lit("spk_0"), F.col("x")), [("spk_0: a",)]) == ["spk_0: spk_0: a"]
    assert values(spark, jobs.created_at(F.col("x"), F.lit("now")), [("then",), (None,)]) == ["then", "now"]


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.Settings.read({})
    assert sinks.Settings.read({"EARSHOT_STORE": "s"}).graph is None
    df = spark.createDataFrame([("q", "e1", None), ("r", "e2", "m")], "queue_name string, episodeId string, audioMediaId string")
    sinks.publish(df, ["episodeId", "audioMediaId"], str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()) == ['{"episodeId":"e1"}', '{"episodeId":"e2","audioMediaId":"m"}']
    blobs = spark.createDataFrame([("raw/a", b"12"), ("raw/b", None)], "key string, content binary")
    assert sorted(map(tuple, sinks.write_blobs(blobs, str(tmp_path / "store")).collect())) == [("raw/a", 2), ("raw/b", None)]
    assert (tmp_path / "store" / "raw" / "a").read_bytes() == b"12"


def test_base_files_by_format(spark):
    wanted = spark.createDataFrame([(m, f) for m in ("both", "jpg", "png", "webp", "none") for f in ("jpg", "png", "webp")] + [(None, "jpg")], "media_id string, format string")
    paths = [f"x/processed/{m}/base.{k}" for m, kinds in {"both": ("jpg", "png"), "jpg": ("jpg",), "png": ("png",), "webp": ("webp",)}.items() for k in kinds]
    got = {(r.media_id, r.format): (r.path or "").rpartition(".")[2] or r.error for r in media.blob_with_fallback(wanted, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    no = "no such picture"
    assert got == {("both", "jpg"): "jpg", ("both", "png"): "png", ("both", "webp"): "jpg", ("jpg", "jpg"): "jpg", ("jpg", "png"): no, ("jpg", "webp"): "jpg", ("png", "jpg"): "png", ("png", "png"): "png", ("png", "webp"): "png", **{(m, f): no for m in ("webp", "none") for f in ("jpg", "png", "webp")}, (None, "jpg"): no}


def test_default_chapters_only_without_any(spark):
    df = spark.createDataFrame([("a", 1, "x", 5_000, 60_000), ("b", 2, "y", None, 5)], "episode_id string, n int, title string, start_ms bigint, end_ms bigint")
    lengths = spark.createDataFrame([("a", 100_000), ("b", 100_000), ("c", None)], "episode_id string, duration_ms bigint")
    got = sorted(map(tuple, chapters.repair_chapters(df, lengths, "n", defaults=True).collect()), key=str)
    assert got == [("a", 1, "x", 0, 100_000), ("b", None, "Closing", 90_000, 100_000), ("b", None, "Introduction", 0, 10_000), ("b", None, "Main Content", 10_000, 90_000)]


def test_answers_of_models(spark):
    df = spark.createDataFrame([(1, '{"segments": [{"type": "analysis", "start_sec": 1, "end_sec": 2.5, "humor": 3}, {"type": null}]}'), (2, "{"), (3, None), (4, "{}"), (5, '{"segments": []}')], "e int, a string")
    got = [(r.e, r.place, r.type, r.start_sec, r.humor) for r in models.parse_segments(df, "a", ["e"]).orderBy("e", "place").collect()]
    assert got == [(1, 0, "analysis", 1.0, 3.0), (1, 1, None, None, None)]
    assert values(spark, models.segment_context(F.col("x"), F.lit("S"), F.lit("E"), F.lit("analysis"), F.lit("1:00")), [("told",), ("",), (None,)]) == ["told", "", 'Segment from "S" episode "E". analysis at 1:00.']


def test_utterances_without_an_id(spark):
    rows = [("a", "e", "2", "3", "x", "spk_0", 1), ("a", "e", "9", "9", "y", "spk_1", 2), (None, "e", "1", "2", "p", None, 1), (None, "e", "1", "2", "p", None, 1)]
    df = spark.createDataFrame(rows, "segment_id string, episode_id string, start_time string, end_time string, transcript string, speaker_label string, ingested_at int")
    got = transcripts.utterances(df).collect()
    assert sorted((r.ord, r.segment_id or "", r.text, r.label) for r in got) == [(0, "", "p", "unknown"), (1, "", "p", "unknown"), (2, "a", "x", "spk_0")]
    assert transcripts.utterances(df, text=False, label=False, ordered=False).columns == ["episode_id", "segment_id", "start_ms", "end_ms"]
