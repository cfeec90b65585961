import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from earshot.session import local_session

    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test tables")
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(tables):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(tables).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same(spark, tables, duck):
    """Compares a query with its SQL: columns, and rows in any order."""

    def plain(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return str(int(v)) if abs(v) < 1e15 and v == int(v) else f"{v:.9g}"
        return str(v)

    def compare(query, sql):
        df = query(spark, tables)
        names = sorted(df.columns)
        ours = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
        relation = duck.sql(sql)
        assert sorted(relation.columns) == names
        theirs = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
        assert ours == theirs

    return compare
