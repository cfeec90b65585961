"""Calls of outside models and codecs behind one interface, with fallbacks that need none.

A provider gets a batch of rows and returns one result for each, or None where it failed; a failed
row takes the fallback. Batches are what Arrow brings to a task, so a provider opens its connection
once per task, and the number of partitions is the number of calls at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    """Something that answers requests; must be picklable."""

    def answer(self, requests: Sequence[dict]) -> Sequence[str | None]: ...


class Offline:
    """The provider that never answers, so that every row takes its fallback."""

    def answer(self, requests: Sequence[dict]) -> list[None]:
        return [None] * len(requests)


def ask(df: DataFrame, provider: Provider, inputs: Sequence[str], output: str = "answer", concurrency: int | None = None) -> DataFrame:
    """``df`` with a text column of the provider's answers, null where it failed.

    Filter and cut the inputs before: a call costs more than anything else in a plan. ``concurrency``
    bounds the number of tasks, and so of calls at a time.
    """
    rows = df.repartition(concurrency) if concurrency else df
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                answers = list(provider.answer(part[list(inputs)].to_dict("records")))
            except Exception:  # a provider's failure is a row's fallback, not the job's end
                answers = [None] * len(part)
            yield part.assign(**{output: pd.Series(answers, index=part.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def is_advertisement(answer: Column) -> Column:
    """A classifier's answer as a flag; anything unclear keeps the text."""
    return F.coalesce(F.upper(F.trim(answer)) == "ADVERTISEMENT", F.lit(False))


def _answer_or(answer: Column, fallback: Column) -> Column:
    """What the model says, an empty text too; the fallback only where it failed."""
    return F.coalesce(answer, fallback)


# The sentences that stand for a description that failed.
SEGMENT_SENTENCE = 'Segment from "%s" episode "%s". %s at %s.'
CHUNK_SENTENCE = "Transcript chunk from %s - %s, spoken by %s"


def segment_context(answer: Column, series_title: Column, episode_title: Column, kind: Column, start_label: Column) -> Column:
    """A model's description of a segment, else a sentence from what is known."""
    return _answer_or(answer, F.format_string(SEGMENT_SENTENCE, series_title, episode_title, kind, start_label))


def chunk_context(answer: Column, series_title: Column, episode_title: Column, label: Column) -> Column:
    """A model's description of a chunk of one speaker, else a sentence from what is known."""
    return _answer_or(answer, F.format_string(CHUNK_SENTENCE, series_title, episode_title, label))


# How much of a text a model is shown.
SHOWN = {"sample": 200, "chapter": 6000, "segment": 2000, "advertisement": 2000, "chunk": 1500}


def shown(text: Column, what: str) -> Column:
    """The part of a text that a model is asked about."""
    return F.left(text, F.lit(SHOWN[what]))


def request(**fields: Column) -> Column:
    """A request's facts as JSON; null ones are left out. Wording a prompt from them is the provider's part."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


_SPEAKERS = "struct<speakers: array<struct<id: string, name: string, role: string, reasoning: string>>>"
_CHAPTERS = "struct<chapters: array<struct<type: string, title: string, summary: string, start_sec: double, end_sec: double>>>"
_SEGMENTS = "struct<segments: array<struct<type: string, start_sec: double, end_sec: double, lucidity: double, polarity: double, arousal: double, subjectivity: double, humor: double>>>"


def _parsed(df: DataFrame, answer: str, schema: str, field: str, keep: Sequence[str]) -> DataFrame:
    rows = df.withColumn("_a", F.from_json(answer, schema, {"mode": "PERMISSIVE"})).where(F.col(f"_a.{field}").isNotNull())
    return rows.select(*keep, F.posexplode(f"_a.{field}").alias("place", "_x")).select(*keep, F.col("place").cast("bigint").alias("place"), "_x.*")


def parse_speakers(df: DataFrame, answer: str, keep: Sequence[str]) -> DataFrame:
    """The speakers in a model's answers, one row each with its ``place``; null and unreadable answers give none."""
    return _parsed(df, answer, _SPEAKERS, "speakers", keep)


def parse_chapters(df: DataFrame, answer: str, keep: Sequence[str]) -> DataFrame:
    """The chapters in a model's answers, one row each with its ``place``; null and unreadable answers give none."""
    return _parsed(df, answer, _CHAPTERS, "chapters", keep)


def parse_segments(df: DataFrame, answer: str, keep: Sequence[str]) -> DataFrame:
    """The segments in a model's answers, one row each with its ``place``; null and unreadable answers give none, as the fallback has it."""
    return _parsed(df, answer, _SEGMENTS, "segments", keep)


def palette_roles(swatch) -> list[Column]:
    """Three colours from a picture's swatches, with fallbacks: ``swatch`` gives the column of a swatch's name."""
    pick = lambda *names: F.coalesce(*[swatch(n) for n in names])
    return [
        pick("vibrant", "light_vibrant", "dark_vibrant").alias("primary_color"),
        pick("dark_muted", "light_muted", "muted").alias("background_color"),
        pick("muted", "light_vibrant", "dark_vibrant").alias("secondary_color"),
    ]
