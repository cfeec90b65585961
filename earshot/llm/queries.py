"""Queries of the text problems (3, 4, 6, 7 and 8), with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compat import clock_ms
from ..operators.intervals import whole_ms
from ..session import checkpointed
from ..sources.tables import table
from .encode import token_counts, token_ids
from .mixing import budgets, leaf_sizes, leaves, select_mix, shortfalls
from .sentences import sentence_units
from .splitting import covered_texts, split_texts
from .turns import speaker_turns, utterances

# ---- 3: speaker turns


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """The transcript rows with their series' language; podcast_series is a fixed, small table, broadcast if its size allows."""
    series = table(spark, folder, "podcast_series").groupBy("series_id").agg(F.min(F.lower(F.substring(F.trim("lang_code"), 1, 2))).alias("language"))
    rows = table(spark, folder, "transcript_segments").select("segment_id", "episode_id", "series_id", "start_time", "end_time", "transcript", "speaker_label")
    return rows.join(series, "series_id", "left")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The turns by the rule of TESTDATA.md, an unlabelled utterance being the speaker's before it: no speaker model takes part, for it couldn't change a row."""
    turns = speaker_turns(utterances(_segments(spark, folder), table(spark, folder, "episode_speakers")), blank_change=0.0)
    return turns.select("episode_id", "speaker", "first_segment_id", "last_segment_id", "n_words")


def p3_profiled(spark: SparkSession, folder: str) -> DataFrame:
    """The turns by the speaker model, in which an unlabelled utterance may be another speaker's if its words tell so."""
    turns = speaker_turns(utterances(_segments(spark, folder), table(spark, folder, "episode_speakers")))
    return turns.select("episode_id", "speaker", "first_segment_id", "last_segment_id", "n_words", "n_utterances")


# ---- 4: splitting

_LIMIT, _OVERLAP = 4000, 200


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """The oversized transcripts, and the oversized texts that ranges of segment_results cover."""
    segments = table(spark, folder, "transcript_segments").select("segment_id", "episode_id", "start_time", "end_time", "transcript")
    own = F.when(F.col("segment_id").isNull(), F.monotonically_increasing_id())
    long = segments.where(F.char_length("transcript") > _LIMIT).groupBy("segment_id", own.alias("own")).agg(F.min("transcript").alias("text"))
    utterance = long.select(F.lit("utterance").alias("item_kind"), F.col("segment_id").alias("item_id"), "text")
    said = segments.select(F.col("episode_id").alias("group_id"), F.col("segment_id").alias("utterance_id"), clock_ms(F.col("start_time")).alias("start_ms"), clock_ms(F.col("end_time")).alias("end_ms"), F.col("transcript").alias("text"))
    ranges = table(spark, folder, "segment_results").select(F.col("episode_id").alias("group_id"), F.col("result_segment_id").alias("range_id"), whole_ms(F.col("start_sec")).alias("start_ms"), whole_ms(F.col("end_sec")).alias("end_ms"))
    covered = covered_texts(said, ranges, _LIMIT)
    return utterance.unionByName(covered.select(F.lit("segment").alias("item_kind"), F.col("range_id").alias("item_id"), "text"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized items."""
    return split_texts(_items(spark, folder), "text", ["item_kind", "item_id"], _LIMIT, _OVERLAP)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that had to be split: those with a second piece."""
    return p4_pieces(spark, folder).where(F.col("piece") == 1).select("item_kind", "item_id").distinct()


P4_FOUND = """
WITH t AS (
  SELECT DISTINCT ON (segment_id) segment_id, episode_id, transcript,
    CASE WHEN start_time LIKE '%:%:%' THEN split_part(start_time, ':', 1)::BIGINT * 3600000 + split_part(start_time, ':', 2)::BIGINT * 60000 + round(split_part(start_time, ':', 3)::DECIMAL(18, 6) * 1000)::BIGINT
      WHEN start_time LIKE '%:%' THEN split_part(start_time, ':', 1)::BIGINT * 60000 + round(split_part(start_time, ':', 2)::DECIMAL(18, 6) * 1000)::BIGINT
      ELSE round(replace(replace(trim(start_time), 's', ''), ',', '.')::DECIMAL(18, 6) * 1000)::BIGINT END a,
    CASE WHEN end_time LIKE '%:%:%' THEN split_part(end_time, ':', 1)::BIGINT * 3600000 + split_part(end_time, ':', 2)::BIGINT * 60000 + round(split_part(end_time, ':', 3)::DECIMAL(18, 6) * 1000)::BIGINT
      WHEN end_time LIKE '%:%' THEN split_part(end_time, ':', 1)::BIGINT * 60000 + round(split_part(end_time, ':', 2)::DECIMAL(18, 6) * 1000)::BIGINT
      ELSE round(replace(replace(trim(end_time), 's', ''), ',', '.')::DECIMAL(18, 6) * 1000)::BIGINT END b
  FROM transcript_segments ORDER BY segment_id, ingested_at
), r AS (
  SELECT DISTINCT result_segment_id, episode_id, CAST(floor(start_sec * 1000.0 + 0.5) AS BIGINT) a, CAST(floor(end_sec * 1000.0 + 0.5) AS BIGINT) b
  FROM segment_results WHERE isfinite(start_sec) AND isfinite(end_sec)
)
SELECT 'utterance' item_kind, segment_id item_id FROM t WHERE length(transcript) > 4000
UNION ALL
SELECT DISTINCT 'segment', result_segment_id FROM (
  SELECT r.result_segment_id, r.a, r.b FROM r JOIN t ON t.episode_id = r.episode_id AND t.a >= r.a AND t.b <= r.b AND t.transcript <> ''
  WHERE r.b > r.a GROUP BY ALL HAVING sum(length(t.transcript)) + count(*) - 1 > 4000)
"""


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every oversized item's pieces: from 0 to its end without a gap, each within the limit and beyond the one before, neighbours sharing no more than the overlap."""
    pieces = p4_pieces(spark, folder)
    before = Window.partitionBy("item_kind", "item_id").orderBy("piece")
    seen = pieces.select("item_kind", "item_id", "piece", "start_char", "end_char", F.char_length("text").alias("n"), F.lag("start_char").over(before).alias("a"), F.lag("end_char").over(before).alias("b"))
    first = F.col("piece") == 0
    holds = F.when(first, F.col("start_char") == 0).otherwise((F.col("start_char") > F.col("a")) & (F.col("start_char") <= F.col("b")) & (F.col("end_char") > F.col("b")) & (F.col("b") - F.col("start_char") <= _OVERLAP))
    whole = holds & (F.col("n") <= _LIMIT) & (F.col("n") == F.col("end_char") - F.col("start_char"))
    return seen.groupBy("item_kind", "item_id").agg(F.max("end_char").alias("n_chars"), F.every(whole).alias("holds"))


_P4_ITEMS = P4_FOUND[P4_FOUND.index("WITH") : P4_FOUND.index("SELECT 'utterance'")]
P4_COVER = f"""{_P4_ITEMS}
SELECT 'utterance' item_kind, segment_id item_id, length(transcript) AS n_chars, true AS holds FROM t WHERE length(transcript) > 4000
UNION ALL
SELECT 'segment', result_segment_id, n_chars, true FROM (
  SELECT r.result_segment_id, r.a, r.b, sum(length(t.transcript)) + count(*) - 1 AS n_chars FROM r JOIN t ON t.episode_id = r.episode_id AND t.a >= r.a AND t.b <= r.b AND t.transcript <> ''
  WHERE r.b > r.a GROUP BY ALL HAVING n_chars > 4000)
"""


# ---- 6: encoding of the corpus


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(table(spark, folder, "documents"))


# ---- 7: mixing

def _language(lang):
    bare = F.lower(F.regexp_extract(lang, "^[A-Za-z]+", 0))
    names = {"english": "en", "eng": "en", "ger": "de", "deu": "de", "spa": "es", "fra": "fr", "fre": "fr", "cmn": "zh", "zho": "zh", "jpn": "ja", "jp": "ja", "rus": "ru", "hin": "hi", "tha": "th", "ell": "el", "gre": "el", "ara": "ar", "und": "", "": ""}
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.nullif(F.coalesce(F.try_element_at(lookup, bare), bare), F.lit(""))


_PATH = ["domain", "language", "source"]


def _sizes(spark: SparkSession, folder: str, domains: DataFrame | None = None) -> DataFrame:
    """Every document's tokens and place in the tree; ``domains`` (source, domain) groups sources, without it all are of one domain."""
    rows = token_counts(table(spark, folder, "documents"), keep=["doc_id", "source", "lang"]).withColumn("language", _language(F.col("lang")))
    if domains is None:
        return rows.withColumn("domain", F.lit(None).cast("string"))
    return rows.join(domains.select(F.col("source").alias("_s"), "domain"), F.col("source") == F.col("_s"), "left").drop("_s")


def _plan(spark: SparkSession, folder: str, sizes: DataFrame) -> tuple[DataFrame, int]:
    """The budgets of the tree's leaves, and the tokens of all documents."""
    found = checkpointed(leaf_sizes(sizes, _PATH))
    total = found.agg(F.sum("tokens")).first()[0] or 0
    targets = table(spark, folder, "mix_targets").groupBy("source").agg(F.sum("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    return budgets(leaves(targets, found, _PATH), _PATH, total), total


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of mix_targets that fall short of their share: those whose leaves of the tree can't fill their budgets."""
    planned, total = _plan(spark, folder, _sizes(spark, folder))
    return shortfalls(planned, "source", total)


def p7_mix(spark: SparkSession, folder: str, domains: DataFrame | None = None) -> DataFrame:
    """The documents of the mix and how often each is used."""
    sizes = checkpointed(_sizes(spark, folder, domains))
    return select_mix(sizes, _PATH, _plan(spark, folder, sizes)[0])


def p7_shares(spark: SparkSession, folder: str, domains: DataFrame | None = None) -> DataFrame:
    """Each target source's wanted and actual share of the mix."""
    sizes = checkpointed(_sizes(spark, folder, domains))
    planned, total = _plan(spark, folder, sizes)
    actual = select_mix(sizes, _PATH, planned).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("bigint").alias("documents"))
    targets = table(spark, folder, "mix_targets").groupBy("source").agg(F.sum("target_weight").alias("target_weight"))
    joined = targets.join(actual, "source", "left").select("source", "target_weight", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    # One row for each target.
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return joined.select("source", "target_weight", (F.lit(total) * F.col("target_weight")).alias("target_tokens"), "tokens", "documents", (F.col("tokens") / F.nullif(whole, F.lit(0))).alias("actual_share"))


def p7_limits(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every target source's part of the mix: no document more than max_repeats times, no more tokens than
    that allows, and each leaf's budget met by less than one document more."""
    sizes = checkpointed(_sizes(spark, folder))
    planned, _ = _plan(spark, folder, sizes)
    planned = checkpointed(planned)
    mix = select_mix(sizes, _PATH, planned)
    used = mix.groupBy(*[F.col(c).alias(f"_{c}") for c in _PATH]).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("n_tokens").alias("largest"), F.max("copies").alias("most"), (F.count(F.lit(1)) == F.countDistinct("doc_id")).alias("once"))
    same = F.lit(True)
    for c in _PATH:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = planned.join(used, same, "left")
    over = F.coalesce("used", F.lit(0)) - F.col("given")
    holds = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("once", F.lit(True)) & (over > -1e-3) & (over < F.coalesce("largest", F.lit(1))) & (F.coalesce("used", F.lit(0)) <= F.col("tokens") * F.col("max_repeats"))
    return both.groupBy("source").agg(F.every(holds).alias("holds"))


P7_LIMITS = "SELECT source, true AS holds FROM mix_targets GROUP BY ALL"


# ---- 8: sentences


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return sentence_units(table(spark, folder, "documents"), language="lang")


QUERIES = {"p3_found": p3_found, "p3_profiled": p3_profiled, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover, "p6_ids": p6_ids, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_limits": p7_limits, "p8_found": p8_found}
SQL = {"p4_found": P4_FOUND, "p4_cover": P4_COVER, "p7_limits": P7_LIMITS}
