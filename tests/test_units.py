import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.functions.units import best, mentioned, readings, time_unit, units
from earshot.operators.units import lengths


@pytest.mark.parametrize(
    ("text", "ms"),
    [
        ("PT10M2S", 602_000), ("p0dt1h11m37s", 4_297_000), ("10分43秒", 643_000), ("1時間5分", 3_900_000), ("12M 4S", 724_000), ("about 1 minutes", 60_000), ("~110 min", 6_600_000), ("ca. 79 Min.", 4_740_000),
        ("00:00:50,750", 50_750), ("1,5 min", 90_000), ("39′24″", 2_364_000), ("66'15\"", 3_975_000), ("9m19s", 559_000), ("1076000 ms", 1_076_000), ("1½ h", 5_400_000), ("unos 89 min", 5_340_000), ("2h20", 8_400_000), ("1h04", 3_840_000),
        ("half an hour", 1_800_000), ("Three quarters of an hour", 2_700_000), ("an hour and a half", 5_400_000), ("two and a half hours", 9_000_000), ("eine Dreiviertelstunde", 2_700_000), ("Anderthalb Stunden", 5_400_000), ("eine halbe Stunde", 1_800_000),
        ("Trois quarts d'heure", 2_700_000), ("une demi-heure", 1_800_000), ("Una hora y media", 5_400_000), ("media hora", 1_800_000), ("zwanzig Minuten", 1_200_000), ("forty-five minutes", 2_700_000), ("hundertzwanzig Minuten", 7_200_000), ("zweihundert Sekunden", 200_000), ("ciento veinte minutos", 7_200_000), ("cent vingt minutes", 7_200_000), ("one hundred and five minutes", 6_300_000), ("two hundred seconds", 200_000),
        (" " * 500 + "1 h 2 min" + " " * 500, 3_720_000), ("about " * 200 + "5 min", 300_000), ("1 Std. 2 Min.", 3_720_000), ("0,09 Std.", 324_000), ("1 hrs, 8 mins", 4_080_000),
    ],
)
def test_written(text, ms):
    found = readings(text)
    assert [(r.ms, r.unit) for r in found] == [(ms, "written")]


@pytest.mark.parametrize("text", [None, "", "  ", "TBA", "n/a min", "a:b", "--:--", "NaN", "-12:30", "-1", "0", "00:00", "?", "null", "x" * 500, "9" * 5000, "1:" + "9" * 5000, "5 " + "s" * 50_000, "5 " + "minutes" * 20_000, "half " * 20_000, "1" * 50_000 + " min"])
def test_no_length(text):
    assert readings(text) == ()


def test_open_notations():
    assert {r.unit for r in readings("1062")} == {"s", "min", "ms", "h"}
    assert {r.unit for r in readings("٥٢:٢٢")} == {"m:s", "h:m"}
    assert best(readings("662000"), 600_000, 1_200_000)[0].ms == 662_000
    assert best(readings("11"), None, None, mentioned("Er kam um 70 Minuten zu spät. (11 min)"))[0].ms == 660_000
    assert best(readings("696"), None, None)[0].ms == 696_000
    assert best(readings("588,000ms"), 400_000, 800_000)[0].ms == 588_000


def test_segmentation():
    assert units("ms")[0].factor == 1e-3
    assert units("m")[0].dimension == "time" and units("m", {"length": 0.9})[0].dimension == "length"
    assert units("min")[0].factor == 60 and units("mn")[0].factor == 60
    assert time_unit("km") is None and time_unit("m²") is None and time_unit("") is None
    assert units("milliseconds")[0].factor == 1e-3


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40_000))
def test_round_trip(seconds):
    h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    for text in (f"{h}:{m:02}:{s:02}", f"PT{h}H{m}M{s}S", f"{h} h {m} min {s} sec", f"{seconds} seconds", f"{seconds * 1000} ms"):
        assert any(r.ms == seconds * 1000 for r in readings(text)), text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_never_fails(text):
    for r in readings(text):
        assert r.ms > 0


def test_operator(spark):
    schema = "id bigint, d string, n string, c string, s string, length_ms string"
    rows = [(1, "45", "21600000", None, "a", "x"), (2, "45", None, None, "a", "x"), (3, "2700", None, None, "b", "x"), (4, None, None, None, None, "x"), (5, "30", "14400000", None, "a", "x"), (6, "31", "14880000", None, "a", "x"), (6, "31", "14880000", None, "a", "x"), (7, "PT1M", "junk", None, None, "x")]
    out = lengths(spark.createDataFrame(rows, schema), "d", "n", "c", "s", ["id"])
    got = sorted((r.id, r.length_ms, r.length_unit) for r in out.collect() if r.length_ms)
    # The second row has no evidence of its own, but its source writes minutes.
    assert got == [(1, 2_700_000, "min"), (2, 2_700_000, "min"), (3, 2_700_000, "s"), (5, 1_800_000, "min"), (6, 1_860_000, "min"), (6, 1_860_000, "min"), (7, 60_000, "written")]
    assert lengths(spark.createDataFrame([], schema), "d", "n", "c", "s", ["id"]).count() == 0
