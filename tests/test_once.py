import random

import pytest
from pyspark.sql import functions as F

from earshot.operators.once import canonical_id, first_copies, fold_batch, read_once, read_surplus, surplus

SCHEMA = "d bigint, q string, m string, t bigint, _w string"


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b"]), rng.choice(["x", "y", "z", None, "hot", "hot", "hot"]), rng.choice([None, *range(5)]), "w") for i in range(n)]


def winners(data):
    best = {}
    for r in data:
        if r[1] is not None and r[2] is not None:
            k = (r[3] is None, r[3] or 0, r[0])
            if (r[1], r[2]) not in best or k < best[r[1], r[2]][0]:
                best[r[1], r[2]] = (k, r[0])
    return {v[1] for v in best.values()}


def test_surplus_and_first(spark):
    data = rows(200, 1)
    df = spark.createDataFrame(data, SCHEMA)
    kept = winners(data)
    got = {r.d for r in surplus(df, ["q", "m"], ["t", "d"], "d").collect()}
    assert got == {r[0] for r in data if r[2] is not None} - kept
    assert {r.d for r in first_copies(df, ["q", "m"], ["t", "d"]).collect()} == kept | {r[0] for r in data if r[2] is None}
    assert first_copies(df.limit(0), ["q", "m"], ["t", "d"]).count() == 0
    assert surplus(df.limit(0), ["q", "m"], ["t", "d"], "d").count() == 0


KEYS, ORDER = ["q", "m"], ["t", "d"]


def test_fold_in_batches(spark, tmp_path):
    data = rows(300, 2)
    home = str(tmp_path / "table")
    for i in (0, 100, 200, 100):  # one batch comes twice
        fold_batch(spark, home, spark.createDataFrame([r[:4] for r in data[i : i + 100]], FOLDED), KEYS, ORDER, "t")
    known = {r[0] for r in data if r[2] is not None}
    assert sorted(r.d for r in read_once(spark, home).collect()) == sorted(winners(data) | {r[0] for r in data} - known)
    assert sorted(r.d for r in read_surplus(spark, home).collect()) == sorted(known - winners(data))
    assert fold_batch(spark, home, spark.createDataFrame([], FOLDED), KEYS, ORDER, "t") == []
    assert len(list((tmp_path / "table").glob("manifest-*.json"))) == 4


FOLDED = "d bigint, q string, m string, t bigint"


def files(home):
    return {str(p) for p in home.rglob("*.parquet") if "_kept=true" in str(p)}


def test_only_affected_partitions_are_written(spark, tmp_path):
    home = tmp_path / "table"
    fold = lambda data: fold_batch(spark, str(home), spark.createDataFrame(data, FOLDED), KEYS, ORDER, "t div 100")
    fold([(i, "a", f"m{i}", i, ) for i in range(1000)])
    before = files(home)
    # A later copy, an earlier copy, a new message and one without an identifier.
    assert fold([(2000, "a", "m150", 950), (2001, "a", "m350", 20), (2002, "a", "new", 960), (2003, "a", None, 970)]) == ["1", "3"]
    rewritten = {p for p in before if "_part=1/" in p or "_part=3/" in p}
    assert before - files(home) == set()  # readers of the manifest before still have them
    kept = {r.m: r.d for r in read_once(spark, str(home)).collect()}
    assert kept["m150"] == 150 and kept["m350"] == 2001 and kept["new"] == 2002 and kept[None] == 2003 and len(kept) == 1002
    assert {r.d for r in read_surplus(spark, str(home)).collect()} == {2000, 350}
    assert fold([(3000, "a", "m999", 1)]) == ["9"]
    assert before - files(home) == rewritten
    assert read_once(spark, str(home)).count() == 1002


def test_empty_table_null_times_and_repeats(spark, tmp_path):
    home = str(tmp_path / "table")
    assert fold_batch(spark, home, spark.createDataFrame([], FOLDED), KEYS, ORDER, "t") == []
    assert read_once(spark, home).count() == read_surplus(spark, home).count() == 0
    data = [(1, "a", "x", None), (2, "a", "x", None), (2, "a", "x", None), (3, None, "x", 1), (3, None, "x", 1), (4, None, "x", 1)]
    fold_batch(spark, home, spark.createDataFrame(data, FOLDED), KEYS, ORDER, "t")
    assert sorted(r.d for r in read_once(spark, home).collect()) == [1, 3, 4] and [r.d for r in read_surplus(spark, home).collect()] == [2]


def test_one_of_two_writers_gives_up(spark, tmp_path, monkeypatch):
    from earshot.operators import once

    home = str(tmp_path / "table")
    batch = spark.createDataFrame([(1, "a", "x", 1)], FOLDED)
    fold_batch(spark, home, batch, KEYS, ORDER, "t")
    stale = once._manifest(spark, home)
    fold_batch(spark, home, spark.createDataFrame([(2, "a", "y", 1)], FOLDED), KEYS, ORDER, "t")
    monkeypatch.setattr(once, "_manifest", lambda *_: stale)
    with pytest.raises(RuntimeError):
        fold_batch(spark, home, spark.createDataFrame([(3, "a", "z", 1)], FOLDED), KEYS, ORDER, "t")
    monkeypatch.undo()
    assert sorted(r.d for r in read_once(spark, home).collect()) == [1, 2]


def test_a_message_with_most_deliveries(spark, tmp_path):
    home = str(tmp_path / "table")
    df = spark.range(5000).select(F.col("id").alias("d"), F.lit("a").alias("q"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("m"), (5000 - F.col("id")).alias("t"))
    fold_batch(spark, home, df, KEYS, ORDER, "1")
    assert {r.d for r in read_once(spark, home).where("m = 'hot'").collect()} == {4999} and read_surplus(spark, home).count() == 3332


def test_canonical_id(spark):
    same = "8a804405-9645-4711-aa06-009693afd879"
    forms = [same, same.upper(), "{" + same + "}", "urn:uuid:" + same, same.replace("-", ""), f"\t {same}\n", f"URN:UUID:{same.upper()} ", f" {same}"]
    df = spark.createDataFrame([(x,) for x in forms], "x string").select(canonical_id(F.col("x")))
    assert {r[0] for r in df.collect()} == {same.replace("-", "")}
    others = spark.createDataFrame([(None,), ("",), (" \t",), (" Abc ",)], "x string").select(canonical_id(F.col("x")))
    assert [r[0] for r in others.collect()] == [None, None, None, "abc"]
