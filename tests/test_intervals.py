import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.operators.intervals import periods_and_gaps, whole_ms
from earshot.operators.joins import interval_join


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        merged = []
        for a, b in sorted((a, b) for k, a, b in rows if k == key and a is not None and b is not None and b > a):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(key, "period", a, b) for a, b in merged]
        out += [(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)]
    return sorted(out, key=str)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-60, 60)), st.one_of(st.none(), st.integers(-60, 60))), max_size=40), st.sampled_from([1, 7, 1000]))
def test_same_as_brute_force(spark, rows, block):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    assert sorted(map(tuple, periods_and_gaps(df, ["k"], "s", "e", block).collect()), key=str) == brute(rows)


def test_clashing_names_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5, 1), ("a", 0, 5, 1), ("a", 5, 7, 2), ("a", 9, 9, 2), ("a", 12, 13, 2)], "k string, s bigint, e bigint, kind int")
    assert sorted(map(tuple, periods_and_gaps(df, ["k"], "s", "e").collect())) == [("a", "gap", 7, 12), ("a", "period", 0, 7), ("a", "period", 12, 13)]
    assert periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0


def test_whole_ms(spark):
    rows = [(0.0004,), (0.0005,), (54.171999997,), (float("nan"),), (float("inf"),), (None,), (-0.0006,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(whole_ms(F.col("x"))).collect()]
    assert got == [0, 1, 54172, None, None, None, -1]


def test_interval_joins(spark):
    rng = random.Random(3)
    points = [("k", i, a := rng.randint(-500, 3000), a + rng.randint(0, 900)) for i in range(80)] + [("k", 99, None, 5), (None, 98, 1, 2)]
    ranges = [("k", i, a := rng.randint(-500, 3000), a + rng.randint(-50, 1500)) for i in range(30)] + [("k", 77, None, 5)]
    p = spark.createDataFrame(points, "k string, p int, start_ms bigint, end_ms bigint")
    r = spark.createDataFrame(ranges, "k string, r int, a_ms bigint, b_ms bigint")
    tests = {"containment": lambda s, e, a, b: s >= a and e <= b, "start_in": lambda s, e, a, b: a <= s < b, "overlap": lambda s, e, a, b: s < b and e > a}
    for how, test in tests.items():
        want = sorted((x[1], y[1]) for x in points for y in ranges if x[0] == y[0] and None not in (*x, *y) and test(x[2], x[3], y[2], y[3]))
        for size in (1, 100, 300_000):
            assert sorted((q.p, q.r) for q in interval_join(p, r, "k", how, size).collect()) == want, how


def test_ends_far_away(spark):
    far = 10**15
    p = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 5, far), ("k", 3, far - 5, far), ("k", 4, -far, far), ("m", 5, 1, 2)], "k string, p int, start_ms bigint, end_ms bigint")
    r = spark.createDataFrame([("k", 1, 0, far), ("k", 2, 0, 7), ("k", 3, -far, -far + 1), ("k", 4, 20, 30), ("m", 5, 0, far), ("n", 6, 0, far)], "k string, r int, a_ms bigint, b_ms bigint")
    got = {how: sorted((q.p, q.r) for q in interval_join(p, r, "k", how).collect()) for how in ("containment", "start_in", "overlap")}
    assert got["containment"] == [(1, 1), (2, 1), (3, 1), (5, 5)]
    assert got["start_in"] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 3), (5, 5)]
    assert got["overlap"] == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 4), (3, 1), (4, 1), (4, 2), (4, 3), (4, 4), (5, 5)]
