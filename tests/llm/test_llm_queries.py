import pytest

from earshot.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, tables):
    queries.QUERIES[name](spark, tables).count()


def test_shares(spark, tables):
    rows = {r.source: r for r in queries.p7_shares(spark, tables).collect()}
    assert sum(r.actual_share or 0 for r in rows.values()) == pytest.approx(1)
    short = {r.source for r in queries.p7_found(spark, tables).collect()}
    for s, r in rows.items():
        if s not in short:
            assert r.tokens >= r.target_tokens - 1
