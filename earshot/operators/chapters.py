"""Chapters and segments: defaults, repair of boundaries, clamping, graph records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import interval_join

#: Kinds of segments that don't go into the graph.
NOT_IN_GRAPH = ["promotion", "credits", "sound-only"]
#: Type, title and summary of the chapters of an episode without any.
DEFAULT_CHAPTERS = [("introduction", "Introduction", "Episode introduction"), ("section", "Main Content", "Main episode content"), ("credits", "Closing", "Episode conclusion and credits")]


def default_chapters(lengths: DataFrame) -> DataFrame:
    """Introduction, main part and end of an episode without chapters: the first and last minute, or tenth if that is shorter."""
    d = F.col("duration_ms")
    intro, end = F.least(F.lit(60_000), F.floor(d * 0.1)).cast("bigint"), F.greatest(d - 60_000, F.ceil(d * 0.9)).cast("bigint")
    bounds = [(F.lit(0).cast("bigint"), intro), (intro, end), (end, d)]
    parts = [F.struct(F.lit(i).cast("bigint").alias("chapter"), F.lit(kind).alias("chapter_type"), F.lit(title).alias("title"), F.lit(text).alias("summary"), a.alias("start_ms"), b.alias("end_ms")) for i, ((kind, title, text), (a, b)) in enumerate(zip(DEFAULT_CHAPTERS, bounds, strict=True))]
    return lengths.where(d.isNotNull()).select("episode_id", F.inline(F.array(*parts)))


def repair_chapters(chapters: DataFrame, lengths: DataFrame, order: str, least_ms: int = 10_000, defaults: bool = False) -> DataFrame:
    """Chapters without gaps and overlaps.

    Per episode, by start and ``order``: a first start after 0 becomes 0 (a negative one stays), a
    last end before the episode's end becomes that, every other start becomes the previous end, and
    what is then shorter than ``least_ms`` is dropped. No step changes an end that a later one reads,
    so all of it is one window. Rows with a null bound are no chapters. With ``defaults`` an episode of
    ``lengths`` that has no chapters gets the :func:`default_chapters`, as they are; columns that those
    don't have are null.
    """
    usable = chapters.where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    w = Window.partitionBy("episode_id").orderBy("start_ms", order)
    placed = usable.join(lengths, "episode_id", "left").withColumn("_n", F.row_number().over(w)).withColumn("_previous", F.lag("end_ms").over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    start = F.when(F.col("_n") == 1, F.least("start_ms", F.lit(0).cast("bigint"))).otherwise(F.col("_previous"))
    end = F.when(F.col("_last"), F.greatest("end_ms", "duration_ms")).otherwise(F.col("end_ms"))
    repaired = placed.withColumn("_start", start).withColumn("_end", end)
    kept = [c for c in chapters.columns if c not in ("start_ms", "end_ms")]
    repaired = repaired.where(F.col("_end") - F.col("_start") >= least_ms).select(*kept, F.col("_start").alias("start_ms"), F.col("_end").alias("end_ms"))
    if not defaults:
        return repaired
    bare = lengths.join(usable.select("episode_id").distinct(), "episode_id", "left_anti")
    made = default_chapters(bare).select(*[c for c in repaired.columns if c in ("episode_id", "chapter_type", "title", "summary", "start_ms", "end_ms")])
    return repaired.unionByName(made, allowMissingColumns=True)


def midpoint_chapter(segments: DataFrame, chapters: DataFrame, segment: str, chapter: str) -> DataFrame:
    """Each segment's chapter: the first by start that holds the segment's middle (its end excluded), else null. Segments need unique identifiers."""
    # Twice the middle is a whole number; segments and chapters meet in slices of time.
    twice = (F.col("start_ms") + F.col("end_ms")).alias("start_ms")
    points = segments.select("episode_id", segment, twice, twice.alias("end_ms"))
    ranges = chapters.select("episode_id", F.col(chapter).alias("_c"), F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"), (2 * F.col("start_ms")).alias("a_ms"), (2 * F.col("end_ms")).alias("b_ms"))
    pairs = interval_join(points, ranges, "episode_id", "start_in", 1_200_000)
    first = pairs.groupBy(segment).agg(F.min(F.struct("_a", "_c", "_b")).alias("m"))
    return segments.join(first, segment, "left").select(*segments.columns, F.col("m._c").alias(chapter), F.col("m._a").alias("chapter_start_ms"), F.col("m._b").alias("chapter_end_ms"))


def clamp_segments(placed: DataFrame) -> DataFrame:
    """Segments cut to their chapter's bounds; a segment outside it comes out reversed, one without chapter unchanged."""
    inside = F.col("chapter_start_ms").isNotNull()
    return placed.withColumn("start_ms", F.when(inside, F.greatest("start_ms", "chapter_start_ms")).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(inside, F.least("end_ms", "chapter_end_ms")).otherwise(F.col("end_ms")))


def stable_id(*parts: Column) -> Column:
    """An identifier that is the same whenever a row is made again."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
