"""Every query with SQL gives what DuckDB gives, over the whole of the smallest tables."""

import pytest

from earshot.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, tables):
    assert registry.QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", ["episode_duration_targets", "default_chapters", "chapter_repair", "midpoint_chapter", "clamp_segments", "actual_range", "speaker_labels_first_seen", "speaker_fill", "flagship_fallback_pipeline"])
def test_no_text_is_read_where_none_is_printed(name, spark, tables):
    plan = registry.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "start_time" in plan and "transcript#" not in plan
