"""Golden values and invariants of scalar functions."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspan.functions import dates, geo, ranks, scoring, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given_", "kansan", "exam", "score", "rough"),
    [
        ({"naishin5": 22, "jitsugi": 10, "toujitsu": 390}, 42, 390, 752, False),
        ({"naishin": 65, "toujitsu": 500, "esat": 20}, 65, 500, 1020, False),
        ({"sonai": 36}, 52, 380, 784, True),
        ({"naishin5": 22}, None, None, None, False),
        ({"naishin5": 99, "jitsugi": 10}, None, None, None, False),
        ({}, None, None, None, False),
    ],
)
def test_estimate(spark, given_, kansan, exam, score, rough):
    names = ("naishin", "naishin5", "jitsugi", "sonai", "toujitsu", "esat")
    got = one(spark, scoring.estimate(*(F.lit(given_.get(k)).cast("int") for k in names)))
    assert (got.kansan, got.exam, got.score, got.rough) == (kansan, exam, score, rough)


@pytest.mark.parametrize(("gap", "strict", "rough", "relaxed"), [(221, None, "s", "s"), (60, "s", "m", "s"), (59, "m", "m", "m"), (-60, "m", "m", "m"), (-61, "c", "m", "m"), (-160, "c", "c", "c"), (-161, None, "c", "c"), (-241, None, None, None)])
def test_tier_edges(spark, gap, strict, rough, relaxed):
    def tier(r, x):
        return one(spark, scoring.tier(F.lit("std"), F.lit(500), F.lit(500 + gap), F.lit(r), F.lit(x)))

    assert tier(False, False) == strict
    assert tier(True, False) == rough
    assert tier(False, True) == relaxed


def test_no_exam_has_no_tier(spark):
    assert one(spark, scoring.tier(F.lit("no_exam"), F.lit(500), F.lit(500), F.lit(False), F.lit(False))) is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 1100), st.integers(400, 950), st.booleans()), min_size=1, max_size=20))
def test_tier_is_monotone_and_rough_contains_strict(spark, rows):
    df = spark.createDataFrame(rows, "score int, target int, relaxed boolean")

    def tier(rough):
        return scoring.tier(F.lit("std"), F.col("target"), F.col("score"), F.lit(rough), F.col("relaxed"))

    order = {"c": 0, "m": 1, "s": 2}
    for r in df.select("*", tier(False).alias("a"), tier(True).alias("b")).collect():
        if r.a is not None:
            assert r.b is not None
    ranked = sorted(((r.score - r.target, r.a) for r in df.select("*", tier(False).alias("a")).where("not relaxed").collect() if r.a), key=lambda p: p[0])
    assert [order[a] for _, a in ranked] == sorted(order[a] for _, a in ranked)


@pytest.mark.parametrize(
    ("rank", "points", "strength"),
    [("優勝", 100, 1000), ("準優勝", 95, 999), ("ベスト8", 82, 0), ("ベスト64", 50, 0), ("3位", 86, 995), ("決勝 40位", 20, 0), ("金賞・最優秀", 88, 0), ("金賞", 75, 0), ("銀賞", 55, 0), ("銅賞", 40, 0), ("入賞", 70, 0), ("佳作", 45, 0), ("二回戦進出", 24, 0), ("一回戦出場", 18, 0), ("出場", 15, 0), ("都大会出場", 15, 100), ("全国決勝進出", 5, 500), ("3回戦", 13, 0), ("参加", 5, 0)],
)
def test_ranks(spark, rank, points, strength):
    assert one(spark, ranks.rank_score(F.lit(rank))) == points
    assert one(spark, ranks.strength(F.lit(rank))) == strength


@pytest.mark.parametrize(("stage", "won", "label"), [("決勝", True, "優勝"), ("決勝", False, "準優勝"), ("準決勝", False, "ベスト4"), ("準々決勝", True, "ベスト4"), ("準々決勝", False, "ベスト8"), ("１回戦", False, "一回戦出場"), ("1回戦", True, "二回戦進出"), ("五回戦", True, "準々決勝進出")])
def test_stages(spark, stage, won, label):
    assert one(spark, ranks.stage_label(ranks.stage_order(F.lit(stage)), F.lit(won))) == label


@pytest.mark.parametrize(("rank", "level", "shown"), [("9位", 3, "出場"), ("8位", 3, "8位"), ("95位", 1, "95位"), ("予選 12位", 2, "出場"), ("2回戦", 2, "出場"), ("銅賞", 3, "銅賞")])
def test_shown_rank(spark, rank, level, shown):
    assert one(spark, ranks.shown_rank(F.lit(rank), F.lit(level))) == shown


def test_dates(spark):
    assert one(spark, dates.fiscal_year(F.lit(datetime.date(2024, 3, 31)))) == 2023
    assert one(spark, dates.fiscal_year(F.lit(datetime.date(2024, 4, 1)))) == 2024
    assert one(spark, dates.era_text(F.lit(2019))) == "令和元年度"
    assert one(spark, dates.era_number(F.lit("令和元年度"))) == 1
    assert one(spark, dates.era_number(F.lit("令和１２年"))) == 12
    assert one(spark, dates.edition_year(F.lit(66), 63, 5)) == 8


def test_geo(spark):
    assert one(spark, F.round(geo.haversine(F.lit(35.0), F.lit(139.0), F.lit(35.0), F.lit(139.0)), 6)) == 0
    assert one(spark, geo.walk_minutes(F.lit(0.8))) == 13
    assert one(spark, geo.ride_minutes(F.lit(0.0), F.lit(1.0))) == 1.0


def test_names(spark):
    assert one(spark, text.base_name(F.lit("男子バレーボール部"))) == "バレーボール"
    assert one(spark, text.organisation(F.lit("写真同好会"))) == "同好会"
    assert one(spark, text.nfkc(F.lit("ＡＢＣ①"))) == "ABC1"
    assert one(spark, text.bare(F.lit("a　（b）・c"))) == "abc"
    assert one(spark, text.pieces(F.lit("写真部・美術部"))) == ["写真部", "美術部"]
    assert one(spark, text.pieces(F.lit("写真・美術"))) == ["写真・美術"]
    assert one(spark, text.unescape(F.lit("&lt;a&gt; &hearts;"))) == "<a> ♥"
    assert one(spark, text.romaji(F.lit("キッチョウ"))) == "kiccho"
    assert [one(spark, text.romaji(F.lit(x))) for x in ("オオタ", "コウッチ", "ッaカ", "ッ", "トオウ")] == ["oota", "kocchi", "ka", "", "too"]


def test_json_inside(spark):
    assert one(spark, text.json_inside(F.lit('<think>{no}</think>```json\n{"a": 1}\n``` bye'))) == '{"a": 1}'
    assert one(spark, text.json_inside(F.lit("nothing"))) is None


def test_commute_range(spark):
    assert one(spark, scoring.commute_range(F.lit(44))) == "30〜45分"
    assert one(spark, scoring.commute_range(F.lit(3))) == "5〜20分"


def test_only_entities_that_a_semicolon_ends_are_decoded(spark):
    page = "<p>a &amp b &ampx; &lt;i&gt; &am &quot</p><p>x&copy=1 &#39;&#x41; &hellip;&nope;&amp;lt;</p>"
    assert one(spark, text.html_lines(F.lit(page), closed=True)) == ["a &amp b &ampx; <i> &am &quot", "x&copy=1 'A …&nope;&lt;"]
    assert one(spark, text.html_lines(F.lit("<p>a &amp b</p>"))) == ["a & b"]
