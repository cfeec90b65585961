import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm.splitting import covered_texts, cuts, split_texts


def test_kinds_of_boundaries():
    assert [c[2] for c in cuts("One is here. Two is here now.\nThree is here.", 32)] == ["paragraph", "whole"]
    assert [c[2] for c in cuts("One is here. Two is here now. Three is here.", 32)] == ["sentence", "whole"]
    assert [c[2] for c in cuts("one, two, three and four, five six", 28)] == ["clause", "whole"]
    assert [c[2] for c in cuts("one two three four", 12)] == ["word", "whole"]
    assert [c[2] for c in cuts("x" * 25, 10)] == ["hard", "hard", "whole"]
    assert cuts("", 10) == [] and cuts("abc", 3) == [(0, 3, "whole")]
    with pytest.raises(ValueError):
        cuts("abcdef", 3, 3)


def test_composed_characters_stay_whole():
    for a, b, _ in cuts("é" * 30, 9):
        assert (b - a) % 2 == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.,! \né。", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_cover(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    found = cuts(text, limit, overlap)
    if not text:
        assert found == []
        return
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for a, b, _ in found:
        assert 0 < b - a <= limit
    for x, y in zip(found, found[1:], strict=False):
        assert x[0] < y[0] <= x[1] < y[1] and x[1] - y[0] <= overlap


def test_other_sizes():
    text = "aa bb cc dd"
    sizes = np.array([5 if ch == "b" else 1 for ch in text])
    for a, b, _ in cuts(text, 12, 0, sizes=sizes):
        assert sizes[a:b].sum() <= 12
    assert len(cuts("abc", 4, sizes=np.array([9, 1, 1]))) == 2  # larger than the limit by itself


def test_long_texts_are_fast():
    text = "word and, another. " * 20_000
    assert len(cuts(text, 4000, 200)) < 2 * len(text) / 4000 + 2


def test_operator(spark):
    df = spark.createDataFrame([(1, "a b " * 10, 9), (2, None, 9), (3, "", 9), (4, "short", 9), (1, "a b " * 10, 9)], "i int, t string, piece int")
    got = split_texts(df, "t", ["i"], 12, 4).collect()
    assert {r.i for r in got} == {1} and all(len(r.text) <= 12 and r.text == ("a b " * 10)[r.start_char : r.end_char] for r in got)
    assert {r.i for r in split_texts(df, "t", ["i"], 12, 4, only_oversized=False).collect()} == {1, 4}
    assert split_texts(df.limit(0), "t", ["i"]).count() == 0


def test_covered_texts(spark):
    rng = random.Random(6)
    said = [("g" if rng.random() < 0.8 else "h", f"u{i}", a := rng.randint(-2000, 9000), a + rng.randint(0, 800), rng.choice([None, "", "word", "a longer one"])) for i in range(150)]
    said += said[:20] + [("g", "x", None, 5, "lost"), (None, "y", 1, 2, "lost")]
    ranges = [("g", f"r{i}", a := rng.randint(-2000, 8000), a + rng.randint(-100, 4000)) for i in range(40)]
    ranges += ranges[:5] + [("g", "n", None, 5), ("h", "hh", -5000, 20000)]
    want = {}
    for g, r, a, b in ranges:
        if a is not None and b is not None and b > a:
            inside = sorted({(x[2], x[3], x[1], x[4]) for x in said if x[0] == g and x[2] is not None and x[2] >= a and x[3] <= b and x[4]})
            text = " ".join(x[3] for x in inside)
            if len(text) > 60:
                want[r] = text
    u = spark.createDataFrame(said, "group_id string, utterance_id string, start_ms bigint, end_ms bigint, text string")
    r = spark.createDataFrame(ranges, "group_id string, range_id string, start_ms bigint, end_ms bigint")
    for size in (500, 300_000):
        rows = covered_texts(u, r, 60, size).collect()
        assert {x.range_id: x.text for x in rows} == want and len(rows) == len(want)
    assert {x.range_id: x.text for x in covered_texts(u, r, 60, most_sent=0).collect()} == want
    assert covered_texts(u.limit(0), r, 60).count() == 0


def test_rows_without_an_id_and_ends_far_away(spark):
    u = spark.createDataFrame([("g", None, 1, 2, "one two"), ("g", None, 1, 2, "one two"), ("g", "a", 3, 4, "three"), ("g", "a", 3, 4, "three"), ("g", "b", 5, 10**15, "far")], "group_id string, utterance_id string, start_ms bigint, end_ms bigint, text string")
    r = spark.createDataFrame([("g", "r", 0, 10**15), ("g", "s", -(10**15), 9)], "group_id string, range_id string, start_ms bigint, end_ms bigint")
    assert sorted(map(tuple, covered_texts(u, r, 5).collect())) == [("r", "one two one two three far"), ("s", "one two one two three")]
