"""Worked examples and properties of the functions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlake.functions import codecs, ranking, text, timewin
from voltlake.operators import intervals


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_minutes(spark):
    got = one(spark, a=timewin.hhmm_strict(F.lit("24:00")), b=timewin.hhmm_strict(F.lit("24:30")), c=timewin.hhmm_strict(F.lit("9:05")), d=timewin.hhmm_lenient(F.lit("9:05")), e=timewin.format_minutes(F.lit(1440)), f=timewin.wrap_minutes(F.lit(1440)), g=timewin.twelve_hour(F.lit(1440)))
    assert got == {"a": 1440, "b": None, "c": None, "d": 545, "e": "24:00", "f": "00:00", "g": "12:00 AM"}


@pytest.mark.parametrize("age, state", [(36.0, "fresh"), (36.01, "stale"), (144.0, "stale"), (144.01, "very-stale"), (None, "unknown"), (float("nan"), "unknown")])
def test_freshness(spark, age, state):
    assert one(spark, s=timewin.freshness(F.lit(age).cast("double")))["s"] == state


@pytest.mark.parametrize("day, n", [("2026-08-23", 0), ("2024-01-01", 1), ("2024-02-29", 4)])
def test_weekday(spark, day, n):
    assert one(spark, d=timewin.weekday_index(F.to_date(F.lit(day))))["d"] == n


@pytest.mark.parametrize("raw, slug", [("Kalyanpur-1", "kalyanpur-1"), ("D.Khan", "d-khan"), ("Narayangonj (east)", "narayangonj-east"), ("Café 12", "cafe-12"), ("ঢাকা", "unknown")])
def test_slugify(spark, raw, slug):
    assert one(spark, s=text.slugify(F.lit(raw)))["s"] == slug


@pytest.mark.parametrize("names, fold", [(("Kallyanpur", "Kollyanpur", "Kalyanpur"), "kalanpar"), (("Uttara", "Uttora"), "atara"), (("Mohakhali", "Mahakhali"), "mahakala"), (("Noyamati", "nyamati"), "namata"), (("Shyamoli", "Shamoli"), "samala"), (("Dhanmondi",), "danmanda"), (("Phulbari Road",), "falbara rad")])
def test_fold(spark, names, fold):
    for n in names:
        assert one(spark, f=text.fold_latin(F.lit(n)))["f"] == fold


def test_tokens(spark):
    got = one(spark, t=text.tokens(F.lit("Road 12, Sector 7, Uttara")))["t"]
    assert sorted(got) == sorted("road:12 sector:7 road ~rad sector ~sactar uttara ~atara".split())


def test_coverage(spark):
    c, e = F.array(*map(F.lit, ("sector:7", "uttara", "~atara"))), F.array(*map(F.lit, ("uttara", "~atara")))
    assert round(one(spark, x=ranking.token_coverage(c, e))["x"], 6) == 0.428571
    assert one(spark, x=ranking.token_coverage(F.array().cast("array<string>"), e))["x"] == 0


@pytest.mark.parametrize("km, w", [(0, 0.95), (1, 0.792065), (3, 0.550599), (8, 0.221831)])
def test_decay(spark, km, w):
    assert round(one(spark, x=ranking.distance_decay(F.lit(float(km))))["x"], 6) == w


@pytest.mark.parametrize("score, div, area, margin, raw, shown", [(0.75, 1.0, 0.5, 0.12, "medium", "medium"), (0.87, 1.0, 0.75, 0.25, "high", "medium"), (0.27, 0.5, 0.04, 0.1, "none", "none")])
def test_confidence(spark, score, div, area, margin, raw, shown):
    level = ranking.confidence(*[F.lit(x) for x in (score, div, area, margin)])
    assert one(spark, r=level, s=ranking.capped(level, F.lit(False)), t=ranking.capped(level, F.lit(True))) == {"r": raw, "s": shown, "t": raw}


@pytest.mark.parametrize("active, total, said", [(0, 3, "none"), (3, 3, "all"), (2, 3, "2 of 3"), (0, 0, "no schedule")])
def test_agreement(spark, active, total, said):
    assert one(spark, a=ranking.agreement(F.lit(active), F.lit(total)))["a"] == said


@pytest.mark.parametrize("raw, load", [("4.2", 4.2), ("35.0", None), ("183", None), ("4,2", None)])
def test_load(spark, raw, load):
    assert one(spark, x=text.load_plausible(F.lit(raw)))["x"] == load


def test_split_areas(spark):
    assert len(one(spark, a=text.split_areas(F.lit("নয়ামাটি, ., আনন্দ হোটেল, x")))["a"]) == 2


def test_row_windows_merge(spark):
    rows = [(w,) for w in ([(600, 660), (540, 600), (700, 690)], [(0, 10), (5, 20), (30, 40)], [])]
    df = spark.createDataFrame(rows, "w array<struct<start_min:int,end_min:int>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(timewin.merge_windows(F.col("w"))).collect()]
    assert got == [[(540, 660)], [(0, 20), (30, 40)], []]


def test_merge_modes(spark):
    df = spark.createDataFrame([(1, 9, 11), (1, 10, 12), (2, 9, 10), (2, 10, 12), (3, 18, 9)], "k int, s int, e int")
    touch = sorted(map(tuple, intervals.merge_intervals(df, ["k"], "s", "e", "touch").collect()))
    both = sorted(map(tuple, intervals.merge_intervals(df, ["k"], "s", "e").collect()))
    assert touch == [(1, 9, 11), (1, 10, 12), (2, 9, 12)] and both == [(1, 9, 12), (2, 9, 12)]


@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), max_size=20))
def test_polyline_round_trip(points):
    back = codecs.decode_polyline(codecs.encode_polyline(points))
    assert len(back) == len(points)
    assert all(abs(a - c) <= 1e-5 and abs(b - d) <= 1e-5 for (a, b), (c, d) in zip(points, back, strict=True))


def test_polyline_known():
    assert codecs.encode_polyline([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


@pytest.mark.parametrize("raw, want", [("gwZwSj", "মতিঝিল"), ("wdWvi", "ফিডার"), ("GjvKvi bvg", "এলাকার নাম")])
def test_bijoy(raw, want):
    assert codecs.bijoy(raw) == want


def test_bijoy_gate(spark):
    got = one(spark, a=codecs.decode_if_confident(F.lit("gwZwSj")), b=codecs.decode_if_confident(F.lit("A133E RMU")))
    assert got == {"a": "মতিঝিল", "b": "A133E RMU"}
