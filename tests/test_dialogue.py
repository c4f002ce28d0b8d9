"""Scripted utterances and replies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.operators import dialogue


def slots(spark, said):
    return spark.createDataFrame([(said,)], "text string").select(dialogue.extract(F.col("text")).alias("s")).first().s


def test_place_and_club(spark):
    got = slots(spark, "石神井公園駅の近くで、サッカー部がある学校")
    assert got.station == "石神井公園" and got.clubs == ["サッカー部"]


def test_residence_only_fills_no_score(spark):
    got = slots(spark, "練馬に住んでいます")
    assert got.station == "練馬"
    assert got.naishin5 is None and got.toujitsu is None and got.commute_limit is None


def test_three_numbers(spark):
    got = slots(spark, "5教科は22、実技は10、当日は390点です")
    assert (got.naishin5, got.jitsugi, got.toujitsu) == (22, 10, 390)


def test_out_of_range_is_kept_for_validation(spark):
    assert slots(spark, "5教科は99です").naishin5 == 99


def test_alias_expands(spark):
    assert slots(spark, "プログラミングがしたい").clubs == ["パソコン", "コンピューター", "情報"]


@pytest.mark.parametrize(("said", "minutes"), [("45分以内で", 45), ("通学は４０分", 40), ("30分かかる", None), ("通学は200分まで", None)])
def test_commute_limit(spark, said, minutes):
    assert slots(spark, said).commute_limit == minutes


@pytest.mark.parametrize(("said", "priority"), [("近いところ", "commute"), ("確実に入りたい", "reachable"), ("部活がいちばん大事", "club"), ("吹奏楽部がある学校", None), ("大学進学", "academic")])
def test_priority(spark, said, priority):
    assert slots(spark, said).priority == priority


def test_null_text(spark):
    got = slots(spark, None)
    assert got.station is None and got.clubs == [] and got.declines is False


@pytest.mark.parametrize(
    ("said", "offered", "key", "declined", "kind"),
    [
        ("はい", ["commute_15"], "commute_15", False, None),
        ("はい", ["commute_15", "score_range"], None, False, "which"),
        ("いいえ", ["commute_15"], None, True, None),
        ("広げなくていいです", ["commute_15"], None, True, None),
        ("大丈夫です", ["commute_15"], None, False, "yesno"),
        ("２番で", ["commute_15", "score_range"], "score_range", False, None),
        ("15分広げて", ["commute_15", "score_range"], "commute_15", False, None),
        ("時間と成績", ["commute_15", "score_range"], None, False, "which"),
        ("", ["commute_15"], None, False, None),
        ("はい", [], None, False, None),
    ],
)
def test_relax_reply(spark, said, offered, key, declined, kind):
    df = spark.createDataFrame([(said, offered)], "text string, offered array<string>")
    got = df.select(dialogue.relax_reply(F.col("text"), F.col("offered")).alias("r")).first().r
    assert (got.key, got.declined, got.kind) == (key, declined, kind)


def test_model_failure_is_null(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")

    def model(prompt):
        if prompt == "b":
            raise OSError("down")
        return prompt.upper()

    got = {r.id: r.reply for r in dialogue.ask_model(rows, "id", "prompt", model).collect()}
    assert got == {1: "A", 2: None}
    assert {r.reply for r in dialogue.ask_model(rows, "id", "prompt", None).collect()} == {None}


def test_turns_accumulate(spark):
    turns = [(1, 0, "渋谷駅です"), (1, 1, "45分以内"), (1, 2, "5教科は22"), (1, 3, "実技は10"), (1, 4, "美術部"), (1, 5, "写真部と美術部")]
    df = spark.createDataFrame(turns, "session long, turn long, text string").withColumn("slots", dialogue.extract(F.col("text")))
    got = dialogue.merge_turns(df, "session", "turn").first()
    assert (got.station, got.commute_limit, got.naishin5, got.jitsugi) == ("渋谷", 45, 22, 10)
    assert got.clubs == ["美術部", "写真部"]
