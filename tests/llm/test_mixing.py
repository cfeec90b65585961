import random

import pytest
from pyspark.sql import functions as F

from earshot.llm.mixing import budgets, leaf_sizes, leaves, select_mix, shortfalls

TREE = "d string, s string, weight double, max_repeats int, tokens bigint"


def brute(rows, total):
    """Budgets by plain loops: shortages are spread again and again, level by level."""
    weight = [r[2] if r[2] and r[2] > 0 else 0.0 for r in rows]
    room = [(r[4] or 0) * max(r[3] or 0, 0) for r in rows]
    given = [min(w * total, c) for w, c in zip(weight, room, strict=True)]
    nodes = [[[i for i, r in enumerate(rows) if r[0] == d] for d in {r[0] for r in rows}], [list(range(len(rows)))]]
    for level in nodes:
        for node in level:
            for _ in range(len(rows) + 1):
                missing = sum(weight[i] * total for i in node) - sum(given[i] for i in node)
                free = [i for i in node if weight[i] > 0 and room[i] - given[i] > 1e-9]
                if missing <= 1e-6 or not free:
                    break
                share = sum(weight[i] for i in free)
                for i in free:
                    given[i] = min(room[i], given[i] + missing * weight[i] / share)
    return given


def plan(spark, rows, total):
    found = {(r.d, r.s): r for r in budgets(spark.createDataFrame(rows, TREE), ["d", "s"], total).collect()}
    return [found[r[0], r[1]] for r in rows]


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", 0.25, 1, 10), ("a", "y", 0.25, 4, 100), ("b", "z", 0.5, 4, 100)]
    assert [r.given for r in plan(spark, rows, 100)] == pytest.approx([10, 40, 50])
    assert [r.initial for r in plan(spark, rows, 100)] == pytest.approx([10, 25, 50])
    # A branch that can't make it up passes the rest on.
    rows[1] = ("a", "y", 0.25, 1, 30)
    assert [r.given for r in plan(spark, rows, 100)] == pytest.approx([10, 30, 60])
    short = shortfalls(budgets(spark.createDataFrame(rows, TREE), ["d", "s"], 100), "s", 100)
    assert [r.s for r in short.collect()] == ["x"]


def test_budgets_as_by_loops(spark):
    for seed in range(25):
        check_budgets(spark, random.Random(seed))


def check_budgets(spark, rng):
    rows = [(rng.choice(["a", "b", None]), f"s{i}", rng.choice([0, 1, 1, 2, 5, None, -1]), rng.choice([0, 1, 1, 2, 4, None]), rng.randint(0, 50)) for i in range(rng.randint(1, 40))]
    whole = sum(r[2] for r in rows if r[2] and r[2] > 0) or 1
    rows = [(d, s, None if w is None else w / whole, n, t) for d, s, w, n, t in rows]
    total = rng.randint(1, 600)
    assert [r.given for r in plan(spark, rows, total)] == pytest.approx(brute(rows, total), abs=1e-6)


def test_weights_fall_to_leaves(spark):
    found = spark.createDataFrame([("en", "x", 30, 3), ("de", "x", 10, 1), (None, None, 7, 1), ("en", "y", 0, 2), ("en", "other", 5, 1)], "language string, source string, tokens bigint, documents bigint")
    targets = spark.createDataFrame([("x", 0.5, 1), ("y", 0.2, 2), ("none", 0.1, 2), (None, 0.2, 1)], "source string, weight double, max_repeats int")
    got = {(r.language, r.source): (round(r.weight, 9), r.max_repeats, r.tokens) for r in leaves(targets, found, ["language", "source"]).collect()}
    assert got == {("en", "x"): (0.375, 1, 30), ("de", "x"): (0.125, 1, 10), (None, None): (0.2, 1, 7), (None, "y"): (0.2, 2, 0), (None, "none"): (0.1, 2, 0)}


def planned(spark, found, wants, repeats):
    rows = [(r.source, wants.get(r.source, 0.0), repeats, r.tokens) for r in found.collect()]
    return spark.createDataFrame(rows, "source string, given double, max_repeats int, tokens bigint")


def test_selection(spark):
    sizes = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("s")).otherwise(F.lit("hot")).alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 7).alias("n_tokens"), F.lit(1).alias("copies"))
    found = leaf_sizes(sizes, ["source"])
    tokens = {r.source: r.tokens for r in found.collect()}
    wants = {"s": tokens["s"] * 1.6, "hot": 500.0}
    chosen = planned(spark, found, wants, 3)
    rows = select_mix(sizes, ["source"], chosen, slices=64).collect()
    for source, g in wants.items():
        own = [r for r in rows if r.source == source]
        used = sum(r.n_tokens * r.copies for r in own)
        assert g <= used < g + 7 and max(r.copies for r in own) <= 3
        assert len({r.doc_id for r in own}) == len(own)
    assert {r.copies for r in rows if r.source == "s"} == {1, 2} and {r.copies for r in rows if r.source == "hot"} == {1}
    assert sorted(map(tuple, select_mix(sizes, ["source"], chosen, slices=1024).collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, select_mix(sizes, ["source"], chosen, seed=1).collect())) != sorted(map(tuple, rows))
    assert select_mix(sizes.limit(0), ["source"], chosen).count() == 0


def test_nulls_and_empty(spark):
    sizes = spark.createDataFrame([(None, 1, 10), (None, 2, 0), ("a", 3, 5), ("a", 4, None)], "source string, doc_id bigint, n_tokens bigint")
    found = leaf_sizes(sizes, ["source"])
    assert {r.source: (r.tokens, r.documents) for r in found.collect()} == {None: (10, 2), "a": (5, 2)}
    tree = leaves(spark.createDataFrame([(None, 1.0, 2), ("none", 0.5, 2)], "source string, weight double, max_repeats int"), found, ["source"])
    assert [tuple(r) for r in select_mix(sizes, ["source"], budgets(tree, ["source"], 15)).collect()] == [(None, 1, 10, 2)]
    none = budgets(leaves(spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int"), found.limit(0), ["source"]), ["source"], 0)
    assert [r.given for r in none.collect()] == [0.0] and shortfalls(none, "source", 0).count() == 0
