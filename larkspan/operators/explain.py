"""Template explanations of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import scoring
from larkspan.operators import search


def condition_text() -> Column:
    """What a request asked for, in one phrase; unset parts are left out."""
    return F.concat_ws(
        "・",
        F.concat(F.col("station"), F.lit("駅から")),
        F.when(F.coalesce("no_commute_limit", F.lit(False)), "通学時間の制限なし").otherwise(F.concat(F.coalesce("commute_limit", F.lit(60)).cast("string"), F.lit("分以内"))),
        F.when(F.size(F.coalesce("clubs", F.array().cast("array<string>"))) > 0, F.concat(F.array_join("clubs", "、"), F.lit("がある"))),
        F.concat(F.lit("学科は"), F.col("dept")),
        F.when(F.coalesce("academic", F.lit(False)), "進学を重視"),
    )


# How a priority and a relaxation are said.
PRIORITY_SAID = {"commute": "通学の近さを最優先", "academic": "大学進学を最優先", "club": "入りたい部活を最優先", "dept": "学びたい分野を最優先", "reachable": "いま届きそうなところを最優先"}
RELAXED_SAID = {"commute_15": "通学時間", "club_similar": "部活の種目", "score_range": "合格の目安点の幅"}


def conditions(student: Column | None = None) -> Column:
    """What a request was searched by, after its relaxations: station and limit, clubs, courses, department, wishes, score."""
    none = F.array().cast("array<string>")
    clubs, courses, relaxed = (F.coalesce(F.col(c), none) for c in ("clubs", "course_types", "relaxations"))
    limit = F.coalesce("commute_limit", F.lit(60)) + F.when(F.array_contains(relaxed, "commute_15"), 15).otherwise(0)
    start = F.concat(F.col("station"), F.lit("駅から"))
    named = F.array_join(clubs, "・")
    parts = [
        F.when(F.coalesce("no_commute_limit", F.lit(False)), start).otherwise(F.concat(start, limit.cast("string"), F.lit("分以内"))),
        F.when(F.size(clubs) > 0, F.when(F.array_contains(relaxed, "club_similar"), F.concat(named, F.lit("と似た種目のある学校"))).otherwise(F.concat(named, F.lit("のある学校")))),
        F.when(F.size(courses) > 0, F.concat(F.array_join(courses, "・"), F.lit("のある学校"))),
        F.concat(F.lit("学科は「"), F.col("dept"), F.lit("」")),
        F.when(F.coalesce("academic", F.lit(False)), "大学進学に力を入れている学校"),
        F.coalesce(*(F.when(F.col("priority") == k, v) for k, v in PRIORITY_SAID.items())),
    ]
    if student is not None:
        score = F.concat(F.lit("お子さんの成績（換算内申"), student["kansan"].cast("string"), F.when(F.coalesce(student["rough"], F.lit(False)), "・概算").otherwise(""), F.lit("）"))
        parts.append(F.when(student["score"].isNotNull(), score))
    return F.concat_ws("、", *parts)


def school_text() -> Column:
    """An answer's row (see ``search.answers``) in sentences."""
    place = F.coalesce(F.concat(F.nullif(F.col("ward"), F.lit("")), F.lit("にある学校で")), F.lit(""))
    way = F.coalesce(F.concat(F.lit("、通学はおよそ"), F.col("commute_minutes").cast("string"), F.lit("分です")), F.lit("、通学時間のデータがありません"))
    sign = F.when(F.col("score_gap") > 0, "+").otherwise("")
    gap = F.coalesce(F.concat(F.lit("（目安点との差 "), sign, F.col("score_gap").cast("string"), F.lit("点）")), F.lit(""))
    both = F.when(F.col("course_types") == "高専", "ご希望の高専です").when(F.col("course_types").contains("全日制"), "全日制と定時制の両方がある学校で、ご希望の定時制課程があります").otherwise("ご希望の定時制です")
    said = F.concat_ws(
        "。",
        F.concat(F.col("name"), F.lit("は"), place, way),
        F.coalesce(F.concat(F.lit("合格の見込みは"), F.col("tier_label"), gap), F.nullif(F.col("tier_reason"), F.lit(""))),
        F.when(F.size("matched_clubs") > 0, F.concat(F.lit("希望の"), F.array_join("matched_clubs", "・"), F.lit("があります"))),
        F.concat(F.nullif(F.col("designation"), F.lit("")), F.lit("に指定されています")),
        F.when(F.col("encourage"), "学力検査によらない選抜のため、点数では判定していませんが候補に残しています"),
        F.when(F.col("suggested_course"), "ものづくり系をお探しなので、5年制の高専も挙げています"),
        F.when(F.col("requested_course"), both),
        F.nullif(F.col("selection_note"), F.lit("")),
    )
    return F.concat(said, F.lit("。"))


def summaries(requests: DataFrame, shown: DataFrame) -> DataFrame:
    """Per request: how many schools were found by what, what was widened, how they were judged, and the tally of tiers."""
    named = F.coalesce(*(F.when(F.col("tier") == k, v) for k, v in scoring.TIER_LABELS.items()))
    counts = shown.withColumn("label", named).groupBy("req_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("first", "label", "n")))), lambda x: F.concat(x["label"], x["n"].cast("string"), F.lit("校")))
    found = counts.groupBy("req_id").agg(F.sum("n").alias("n"), F.array_join(listed, "・").alias("tally"))
    asked = search.students(requests).withColumn("said", conditions(F.col("student"))).join(found, "req_id", "left")
    relaxed = F.coalesce(F.col("relaxations"), F.array().cast("array<string>"))
    widened = F.array_compact(F.transform(relaxed, lambda r: F.coalesce(*(F.when(r == k, v) for k, v in RELAXED_SAID.items()))))
    text = F.concat_ws(
        "",
        F.col("said"),
        F.lit("で、"),
        F.col("n").cast("string"),
        F.lit("校が見つかりました。"),
        F.when(F.size(widened) > 0, F.concat(F.array_join(widened, "と"), F.lit("を広げてお探ししたものです。"))),
        F.when(F.col("student.score").isNull(), "成績の入力がないため、合格の見込みは判定せず、通学の近い順にご案内しています。").when(F.col("student.rough"), "成績が概算のため、合格の見込みは幅を広めに取っています。"),
        F.when(F.col("tally") != "", F.concat(F.lit("内訳は"), F.col("tally"), F.lit("です。"))),
    )
    nothing = F.concat(F.col("said"), F.lit("で探しましたが、条件をすべて満たす学校は見つかりませんでした。"))
    return asked.select("req_id", F.when(F.col("n").isNull(), nothing).otherwise(text).alias("text"))


def tier_tally(shown: DataFrame) -> DataFrame:
    """Per request, how many rows each tier label has, in the order in which labels first appear."""
    named = F.coalesce(*(F.when(F.col("tier") == k, v) for k, v in scoring.TIER_LABELS.items()), F.lit("判定なし"))
    counts = shown.withColumn("label", named).groupBy("req_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "label", "n"))), lambda x: F.concat(x["label"], x["n"].cast("string"), F.lit("校")))
    return counts.groupBy("req_id").agg(F.array_join(parts, "、").alias("tally"))


def sentences(shown: DataFrame) -> DataFrame:
    """One sentence per shown row, of its reasons and a note."""
    note = scoring.selection_note(F.col("selection_note"), F.col("selection_type")) if "selection_note" in shown.columns else F.lit(None).cast("string")
    return shown.withColumn("text", F.concat_ws("。", F.concat(F.col("name"), F.lit("："), F.array_join("why", "、")), note))
