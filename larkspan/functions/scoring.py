"""Student estimates, tiers and match scores as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted ranges, tier gaps, score weights and points.
RANGES = {"naishin5": (5, 25), "jitsugi": (4, 20), "naishin": (9, 65), "sonai": (9, 45), "toujitsu": (0, 500), "esat": (0, 20)}
PRIORITIES = ("commute", "academic", "club", "dept", "reachable")


@dataclass(frozen=True)
class Gaps:
    safe: int
    fit: int
    challenge: int
    most: int


STRICT, ROUGH, RELAXED = Gaps(60, -60, -160, 220), Gaps(90, -90, -210, 280), 80
EXAM_WEIGHT, REPORT_FULL, REPORT_POINTS, ESAT_DEFAULT = 1.4, 65, 300, 12
TIER_POINTS = {"m": 40, "c": 25, "s": 15}
TIER_LABELS = {"s": "安全圏", "m": "適正圏", "c": "挑戦圏"}
SELECTION_LABELS = {
    "jiko": "自校作成問題校。共通問題の模試とは尺度がずれます",
    "keisha": "傾斜配点があります。得意科目で有利になる場合があります",
    "fukasawa": "特別な選抜方式です。募集要項を確認してください",
    "ratio64": "当日点と内申の比率が6:4です",
    "no_exam": "学力検査なし（面接・作文で選抜）",
    "kosen": "高専は入試の方式が都立高校と異なります（学力検査3教科＋調査書）",
}

# What is said of a tier, and why there is none.
TIER_REASONS = {"s": "目安点を上回っています", "m": "目安点とほぼ同じです", "c": "目安点をやや下回ります"}
NO_TIER = {
    "no_exam": "学力検査がないため点数では判定しません",
    "高専": "高専は入試の方式が異なるため（学力検査3教科＋調査書）、都立高校の目安点では判定していません",
    "定時制": "定時制は学力検査の教科数が学校ごとに違うため、5教科の目安点では判定していません",
    "併設": "定時制は全日制と入試の方式が違うため、全日制の目安点では判定していません",
    "target": "目安点が未設定です",
    "score": "成績の入力がないため点数では判定しません",
    "above": "余裕がありすぎるため候補から外しています",
    "below": "目安点から離れているため候補から外しています",
}


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity, to an int."""
    return F.floor(x + F.lit(0.5)).cast("int")


def number(x: Column) -> Column:
    """A number of a string; blank and non-numeric are null."""
    return F.trim(x).try_cast("double")


def valid(x: Column, name: str) -> Column:
    low, high = RANGES[name]
    return F.when(x.between(low, high), x)


def invalid_names(**given: Column) -> Column:
    """Names of the inputs that were given and are out of range."""
    return F.array_compact(F.array(*(F.when(x.isNotNull() & valid(x, k).isNull(), F.lit(k)) for k, x in given.items())))


def converted_report(naishin: Column, naishin5: Column, jitsugi: Column, sonai: Column) -> Column:
    """The converted report score: as given, of its parts, or roughly of the nine subjects' sum."""
    return F.coalesce(valid(naishin, "naishin"), valid(naishin5, "naishin5") + valid(jitsugi, "jitsugi") * 2, half_up(valid(sonai, "sonai") * 13 / 9))


def estimate(naishin: Column, naishin5: Column, jitsugi: Column, sonai: Column, toujitsu: Column, esat: Column) -> Column:
    """struct(kansan, exam, exam_rough, report_rough, rough, score); score is null without a report score."""
    exact = F.coalesce(valid(naishin, "naishin"), valid(naishin5, "naishin5") + valid(jitsugi, "jitsugi") * 2)
    kansan = converted_report(naishin, naishin5, jitsugi, sonai)
    report_rough = exact.isNull() & kansan.isNotNull()
    given = valid(toujitsu, "toujitsu")
    exam = F.coalesce(given, half_up(kansan / REPORT_FULL * 500 * 0.95))
    score = half_up(exam * EXAM_WEIGHT + kansan * (REPORT_POINTS / REPORT_FULL) + F.coalesce(valid(esat, "esat"), F.lit(ESAT_DEFAULT)))
    exam_rough = given.isNull() & kansan.isNotNull()
    return F.struct(
        kansan.cast("int").alias("kansan"),
        F.when(kansan.isNotNull(), exam).cast("int").alias("exam"),
        exam_rough.alias("exam_rough"),
        report_rough.alias("report_rough"),
        (exam_rough | report_rough).alias("rough"),
        score.alias("score"),
    )


def tier(selection: Column, target: Column, score: Column, rough: Column, relaxed: Column) -> Column:
    """s, m or c by the gap of estimate and target; null where numbers don't judge."""
    bonus = F.when(relaxed, RELAXED).otherwise(0)

    def bound(name: str) -> Column:
        return F.when(rough, getattr(ROUGH, name)).otherwise(getattr(STRICT, name))

    gap = score - target
    return F.when(
        ~F.coalesce(selection == "no_exam", F.lit(False)),
        F.when(gap > bound("most") + bonus, None).when(gap >= bound("safe"), "s").when(gap >= bound("fit") - bonus, "m").when(gap >= bound("challenge") - bonus, "c"),
    )


def tier_reason(selection: Column, target: Column, score: Column, tier: Column, gap: Column, courses: Column, foreign: Column) -> Column:
    """What the tier says, or why there is none; ``foreign`` rows are judged by another course's examination."""
    evening = F.coalesce(courses.contains("定時制") & ~courses.contains("全日制"), F.lit(False))
    unset = F.when(courses == "高専", NO_TIER["高専"]).when(evening, NO_TIER["定時制"]).otherwise(NO_TIER["target"])
    said = F.coalesce(*(F.when(tier == k, v) for k, v in TIER_REASONS.items()))
    return (
        F.when(foreign, NO_TIER["併設"])
        .when(selection == "no_exam", NO_TIER["no_exam"])
        .when(target.isNull(), unset)
        .when(score.isNull(), NO_TIER["score"])
        .otherwise(F.coalesce(said, F.when(gap > 0, NO_TIER["above"]).otherwise(NO_TIER["below"])))
    )


def match_score(
    minutes: Column, tier: Column, priority: Column, academic: Column, designation: Column, dept_fits: Column, clubs_matched: Column, clubs_exact: Column, clubs_wanted: Column
) -> Column:
    """Points of a candidate by nearness, tier and wishes; the stated priority weighs more."""
    near = F.greatest(F.lit(0), half_up((60 - F.coalesce(minutes, F.lit(60))) / 2))

    def is_(p: str) -> Column:
        return F.coalesce(priority == p, F.lit(False))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    parts = [
        F.when(is_("commute"), near * 2).otherwise(near),
        F.coalesce(*(F.when(tier == k, v) for k, v in TIER_POINTS.items()), F.lit(0)),
        F.when(is_("reachable") & yes(tier == "s"), 40).when(is_("reachable") & yes(tier == "m"), 10).otherwise(0),
        F.when(yes(academic) & designation.isNotNull(), F.when(is_("academic"), 40).otherwise(10)).otherwise(0),
        F.when(yes(dept_fits), F.when(is_("dept"), 70).otherwise(40)).otherwise(0),
        F.when(
            clubs_matched > 0,
            30 + F.when(is_("club"), F.when(clubs_exact > 0, 30 * F.least(clubs_exact, F.greatest(clubs_wanted, F.lit(1)))).otherwise(10)).otherwise(0),
        ).otherwise(0),
    ]
    return reduce(lambda a, b: a + b, parts).cast("int")


def reasons(minutes: Column, via: Column, mode: Column, tier: Column, priority: Column, academic: Column, designation: Column, dept: Column, dept_fits: Column, clubs: Column) -> Column:
    """Why a candidate scores, as an array of phrases; a way whose mode isn't known is walked."""
    no = F.lit(False)
    leg = F.when(mode == "bus", "バス").otherwise("徒歩")
    return F.array_compact(
        F.array(
            F.when(minutes.isNotNull(), F.concat(F.lit("通学"), minutes.cast("string"), F.lit("分（"), F.coalesce(F.concat(via.cast("string"), F.lit("駅から")), F.lit("")), leg, F.lit("）"))),
            F.coalesce(*(F.when(tier == k, v) for k, v in TIER_LABELS.items())),
            F.when(F.coalesce((priority == "reachable") & (tier == "s"), no), "いま届きそう"),
            F.when(F.coalesce(academic, no) & designation.isNotNull(), F.concat(F.lit("大学進学重視 → "), designation)),
            F.when(F.coalesce(dept_fits, no), F.concat(F.lit("学科の希望「"), dept, F.lit("」に一致"))),
            F.when(F.size(clubs) > 0, F.concat(F.lit("希望の部活: "), F.array_join(clubs, "・"))),
        )
    )


def selection_note(note: Column, selection: Column) -> Column:
    """The row's own note, else the label of its selection type, else null."""
    return F.coalesce(F.nullif(note, F.lit("")), *(F.when(selection == k, v) for k, v in SELECTION_LABELS.items()))


def commute_range(minutes: Column) -> Column:
    """A quarter-hour range, from 5 minutes on."""
    low = F.greatest(F.lit(5), (F.floor(minutes / 15) * 15).cast("int"))
    return F.concat(low.cast("string"), F.lit("〜"), (low + 15).cast("string"), F.lit("分"))
