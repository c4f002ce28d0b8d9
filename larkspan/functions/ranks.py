"""Results of contests: rank strings as scores, stages as ordinals, levels of meets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of meets, rounds in order, points and strengths of rank words, bands.
MEET_LEVELS = {"全国大会（インターハイ）": 3, "全国大会（定時制通信制）": 3, "全国大会": 3, "関東大会": 2, "東京都大会": 1, "東京都大会（予選）": 1}
ROUNDS = ("一回戦", "二回戦", "三回戦", "四回戦", "五回戦", "準々決勝", "準決勝", "決勝")
KANJI, FULL, HALF = "一二三四五六七八九", "１２３４５６７８９", "123456789"
AWARDS = {"入賞": 70, "佳作": 45}
STRENGTHS = {"優勝": 1000, "準優勝": 999, "全国決勝進出": 500, "全国準決勝進出": 400, "都大会出場": 100}
BANDS = {"進学指導重点校": 5, "進学指導特別推進校": 4, "進学指導推進校": 3}
SPORTS = "陸上|水泳|競泳|バレー|バスケ|サッカー|テニス|卓球|バドミントン|柔道|剣道|弓道|なぎなた|ソフトボール|ハンドボール|ラグビー|体操|新体操|ダンス|チア|空手|相撲|レスリング|フェンシング|ボート|カヌー|自転車|登山|ワンダーフォーゲル|少林寺|アーチェリー|ホッケー|ラクロス|山岳"


# Words that tell the level of a meet, the highest first; words of qualifiers, which are city results.
MEET_WORDS = {
    "全国大会": "全国大会|インターハイ|インハイ|全国高等学校総合体育大会|甲子園|全国選抜",
    "関東大会": "関東大会|関東高等学校|関東選抜",
    "東京都大会": "東京都|都大会|都立|西東京|東東京|支部",
}
QUALIFIER, QUALIFIED = "予選|地区大会|支部大会|都大会予選", "東京都大会（予選）"


def _number(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("int")


def rank_score(rank: Column) -> Column:
    """Points of a rank word; the first rule that fits counts."""
    best, place, nth = (_number(rank, p) for p in (r"^ベスト\s*(\d+)", r"(\d+)\s*位", r"^(\d+)\s*回戦"))
    kanji = F.instr(F.lit(KANJI), F.regexp_extract(rank, f"^([{KANJI}])回戦", 1))
    return (
        F.when(rank == "優勝", 100)
        .when(rank == "準優勝", 95)
        .when(best.isNotNull(), F.greatest(F.lit(50), 90 - best))
        .when(place.isNotNull(), F.greatest(F.lit(20), 92 - 2 * place))
        .when(rank.startswith("金賞"), F.when(rank.contains("最優秀"), 88).otherwise(75))
        .when(rank.startswith("銀賞"), 55)
        .when(rank.startswith("銅賞"), 40)
        .when(rank == "入賞", AWARDS["入賞"])
        .when(rank == "佳作", AWARDS["佳作"])
        .when(rank.rlike(f"^[{KANJI}]回戦(進出|出場)"), 12 + 6 * kanji)
        .when(rank.contains("出場"), 15)
        .when(nth.isNotNull(), 10 + nth)
        .otherwise(5)
    )


def strength(rank: Column) -> Column:
    """How strong a result is: first, second, N-th by 998 - N, reaching a stage; 0 for anything else."""
    return F.coalesce(*(F.when(rank == k, v) for k, v in STRENGTHS.items()), 998 - _number(rank, r"^(\d+)位$"), F.lit(0))


def stage_order(stage: Column) -> Column:
    """Ordinal of the first round word in the order of rounds; digits may stand for numerals."""
    plain = F.translate(F.translate(stage, FULL, KANJI), HALF, KANJI)
    return F.coalesce(*(F.when(plain.contains(word), i + 1) for i, word in enumerate(ROUNDS)))


def stage_label(order: Column, won: Column) -> Column:
    """What a furthest stage means; before the quarter-finals the round that was reached."""
    reached = F.when(won, order + 1).otherwise(order)
    names = F.array(*map(F.lit, ROUNDS))
    return (
        F.when(order == 8, F.when(won, "優勝").otherwise("準優勝"))
        .when(order == 7, F.when(won, "決勝進出").otherwise("ベスト4"))
        .when(order == 6, F.when(won, "ベスト4").otherwise("ベスト8"))
        .when(reached == 1, "一回戦出場")
        .otherwise(F.concat(F.get(names, (reached - 1).cast("int")), F.lit("進出")))
    )


def meet_level(meet: Column) -> Column:
    return F.coalesce(*(F.when(meet == k, v) for k, v in MEET_LEVELS.items()), F.lit(0))


def meet_of(said: Column) -> Column:
    """The level that a sentence names, '' without any; a qualifier of a national or regional meet is the city's."""
    named = F.coalesce(*(F.when(said.rlike(p), k) for k, p in MEET_WORDS.items()), F.lit(""))
    return F.when(named.isin("全国大会", "関東大会") & said.rlike(QUALIFIER), QUALIFIED).otherwise(named)


def shown_rank(rank: Column, level: Column) -> Column:
    """Places beyond 8 and rounds at national and regional meets show as entries; awards stay."""
    award = rank.contains("賞") | (rank == "佳作")
    far = F.coalesce(_number(rank, r"^(?:決勝|準決勝|準々決勝|予選)?\s*(\d+)\s*位$") > 8, F.lit(False)) | rank.rlike(r"^\d+\s*回戦$")
    return F.when(~award & (level >= 2) & far, "出場").otherwise(rank)


def plain_rank(said: Column) -> Column:
    """The rank that a text states, in comparable form, or null."""
    best, place = F.regexp_extract(said, r"ベスト\s*([0-9０-９]+)", 1), F.regexp_extract(said, r"([0-9]+)\s*位", 1)
    return F.when(said.contains("準優勝"), "準優勝").when(said.contains("優勝"), "優勝").when(best != "", F.concat(F.lit("ベスト"), best)).when(place != "", F.concat(place.try_cast("int").cast("string"), F.lit("位")))


def sports(said: Column) -> Column:
    """The words of sports in a text, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(said, F.lit(f"({SPORTS})"), 1)))


def band(designation: Column) -> Column:
    return F.coalesce(*(F.when(designation == k, v) for k, v in BANDS.items()))
