"""All queries of the core."""

from __future__ import annotations

from . import feeds, files, general, podcast, streams

QUERIES = {**general.QUERIES, **feeds.QUERIES, **files.QUERIES, **podcast.QUERIES, **streams.QUERIES}
SQL = {**general.SQL, **feeds.SQL, **files.SQL, **podcast.SQL, **streams.SQL}
FLAGSHIP = "transcript_processing"
