"""Slots from utterances, merged over turns: rules as column expressions, folds as aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import scoring, text
from larkspan.operators import model as models
from larkspan.operators.search import CLUB_CATEGORIES, COLLEGE, EVENING

# Patterns of utterances, in the order in which they are tried.
STATION = (r"([一-龥ぁ-んァ-ヴー\w]{1,12}?)駅", r"([一-龥ァ-ヴー]{2,12})(?:から|より)", r"([一-龥ァ-ヴー]{2,12})(?:の?(?:あたり|付近|周辺|近く)|に住)")
MINUTES_LIMIT, MINUTES_ANY, TRAVEL = r"(\d{1,3})\s*分(?:以内|くらい|ぐらい|程度|まで)", r"(\d{1,3})\s*分", "通学|通え|かよ"
NUMBERS = {"naishin5": (r"(?:5|五)\s*教科", 12), "jitsugi": (r"実技(?:\s*(?:4|四)\s*教科)?", 12), "nine": (r"(?:9|九)\s*教科", 12), "report": ("(?:素)?内申", 12), "naishin": ("換算内申", 12), "toujitsu": ("(?:当日点?|本番|模試|入試|得点)", 14)}
ACADEMIC, EMPHASIS = "進学|大学|受験に強|学力|勉強", "重視|優先|いちばん|一番|最優先|大事|重要|こだわ|中心"
PRIORITY = (
    ("reachable", "行けるところ|入れるところ|届き|受かり|確実|手堅|安全|無理のない|背伸び", False),
    ("commute", "近い|近く|近め|通いやす|通える|遠くない|時間をかけ|近所|距離", False),
    ("club", "部活|クラブ", True),
    ("dept", "学科|専門|分野|学べる|学びたい", True),
)
DEPARTMENTS = (
    ("工", "工業|工科|ものづくり|機械|電気"),
    ("商", "商業|ビジネス|簿記"),
    ("農", "農業|農芸|園芸|畜産"),
    ("総", "総合学科|総合高校|いろいろ学びたい"),
    ("家", "家政|家庭|保育|調理|服飾"),
    ("福", "福祉|介護"),
    ("水", "水産|海洋"),
    ("普", "普通科"),
)
KNOWN_DEPARTMENTS = ("普", "工", "商", "農", "総", "家", "福", "水", "他")
COURSES = ((EVENING, "定時制|夜間|夜学|働きながら|チャレンジスクール"), (COLLEGE, "高専|高等専門"))
ALIASES = {"プログラミング": ["パソコン", "コンピューター", "情報"], "IT": ["パソコン", "コンピューター", "情報"], "eスポーツ": ["eスポーツ", "パソコン"], "ブラスバンド": ["吹奏楽"]}
DECLINE = "わか(?:ら|り)|分か(?:ら|り)|わかん|不明|決めてな|決まってな|まだ.{0,6}(?:受けて|出て|決めて)(?:い)?ない|持ってな"
HINTS = {"commute_15": "通学|時間|分|遠く|距離|範囲", "club_similar": "部活|クラブ|似た|近い種目|種目", "score_range": "点|成績|目安|レベル|学力|偏差"}
YES, UNCLEAR = "はい|うん|お願い|それで|そうし|やって|広げて", "大丈夫|いいです|いいよ|まあ|どちらでも|お任せ"
NO = "いいえ|^いえ|いや|やめ|結構|しない|変えない|そのまま|いらない|このまま|なくてい|なくても|ないで|なしで|不要"
SLOTS = ("station", "commute_limit", "naishin", "toujitsu", "wants")

NUMERIC = ("commute_limit", "naishin5", "jitsugi", "sonai", "naishin", "toujitsu")


def _found(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def near_number(x: Column, word: str, reach: int) -> Column:
    """The number of up to three digits that follows a word within some characters."""
    return _found(x, f"{word}[^0-9]{{0,{reach}}}([0-9]{{1,3}})").cast("int")


def clubs(x: Column) -> Column:
    """Club words as said, with their suffix, and what aliases stand for; each once, in order."""
    words = dict.fromkeys(w for m in CLUB_CATEGORIES.values() for w in m)
    said = [F.when(x.contains(w), F.array(F.regexp_extract(x, f"({w}(?:部|同好会|クラブ)?)", 1))).otherwise(F.array().cast("array<string>")) for w in words]
    aliases = [F.when(x.contains(w), F.array(*map(F.lit, real))).otherwise(F.array().cast("array<string>")) for w, real in ALIASES.items()]
    return F.array_distinct(F.concat(*said, *aliases))


def department(x: Column) -> Column:
    return F.coalesce(*(F.when(x.rlike(p), code) for code, p in DEPARTMENTS))


def resolve_department(x: Column) -> Column:
    return F.when(F.trim(x).isin(*KNOWN_DEPARTMENTS), F.trim(x)).otherwise(department(x))


def extract(raw: Column) -> Column:
    """The slots that one utterance fills, by rules alone; null where it says nothing."""
    x = text.fold_digits(F.coalesce(raw, F.lit("")))
    limit = F.coalesce(_found(x, MINUTES_LIMIT), F.when(x.rlike(TRAVEL), _found(x, MINUTES_ANY))).cast("int")
    n = {k: near_number(x, p, reach) for k, (p, reach) in NUMBERS.items()}
    academic = x.rlike(ACADEMIC)
    emphasis = x.rlike(EMPHASIS)
    priority = F.coalesce(*(F.when((emphasis & x.rlike(p)) if emphatic else x.rlike(p), k) for k, p, emphatic in PRIORITY), F.when(academic, "academic"))
    courses = F.array_compact(F.array(*(F.when(x.rlike(p), c) for c, p in COURSES)))
    return F.struct(
        F.coalesce(*(_found(x, p) for p in STATION)).alias("station"),
        F.when(limit.between(1, 180), limit).alias("commute_limit"),
        n["naishin5"].alias("naishin5"),
        n["jitsugi"].alias("jitsugi"),
        F.coalesce(n["nine"], F.when(n["naishin5"].isNull() & n["jitsugi"].isNull() & ~x.contains("換算"), n["report"])).alias("sonai"),
        n["naishin"].alias("naishin"),
        n["toujitsu"].alias("toujitsu"),
        F.when(academic, True).alias("academic"),
        priority.alias("priority"),
        department(x).alias("dept"),
        courses.alias("course_types"),
        clubs(x).alias("clubs"),
        x.rlike(DECLINE).alias("declines"),
    )


def bare_answer(raw: Column, slot: Column, found: Column, had_five: Column) -> Column:
    """``extract``'s struct with a short answer read as the slot that was asked for, and only that."""
    x = F.trim(text.fold_digits(F.coalesce(raw, F.lit(""))))
    number = _found(x, r"^([0-9]{1,3})\s*(?:点|分)?[。.\s]*$").cast("int")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[。.\s]+$", ""), "(?:駅)?(?:です|でお願いします|になります|かな|だと思います)$", ""), "駅$", "")
    nothing = F.forall(F.array(*(found[k].cast("string") for k in ("station", *NUMERIC, "academic", "priority", "dept"))), lambda v: v.isNull()) & (F.size(found["course_types"]) == 0) & (F.size(found["clubs"]) == 0)

    def read(asked: str, field: str, value: Column, condition: Column) -> Column:
        return F.coalesce(found[field], F.when((slot == asked) & condition, value)).alias(field)

    no_report = found["naishin5"].isNull() & found["jitsugi"].isNull() & found["sonai"].isNull() & found["naishin"].isNull()
    filled = {
        "station": read("station", "station", name, nothing & F.length(name).between(1, 12)),
        "commute_limit": read("commute_limit", "commute_limit", number, number.isNotNull()),
        "toujitsu": read("toujitsu", "toujitsu", number, number.between(0, 500)),
        "naishin5": read("naishin", "naishin5", number, no_report & had_five.isNull()),
        "jitsugi": read("naishin", "jitsugi", number, no_report & had_five.isNotNull()),
    }
    names = ("station", "commute_limit", "naishin5", "jitsugi", "sonai", "naishin", "toujitsu", "academic", "priority", "dept", "course_types", "clubs", "declines")
    return F.struct(*(filled.get(k, found[k].alias(k)) for k in names))


def over_model(rules: Column, model: Column) -> Column:
    """Each field as the rules have it, else as the model's."""
    scalar = ("station", *NUMERIC, "academic", "priority", "dept")
    lists = [F.when(F.size(rules[k]) > 0, rules[k]).otherwise(F.coalesce(model[k], F.array().cast("array<string>"))).alias(k) for k in ("course_types", "clubs")]
    return F.struct(*(F.coalesce(rules[k], model[k]).alias(k) for k in scalar), *lists)


MODEL_SCHEMA = "station string, commute_limit string, naishin5 string, jitsugi string, sonai string, toujitsu string, wants struct<academic: boolean, priority: string, dept: string, course_types: array<string>, clubs: array<string>>, declined array<string>"


def sanitised(reply: Column) -> Column:
    """A model's reply as slots: the JSON in it, typed, in range, known words only; anything else is null."""
    got = F.from_json(text.json_inside(reply), MODEL_SCHEMA)
    limits = {"commute_limit": (1, 180), **{k: scoring.RANGES[k] for k in ("naishin5", "jitsugi", "sonai", "toujitsu")}}

    def ranged(k: str) -> Column:
        v = scoring.number(got[k])
        return F.when(v.between(*limits[k]), v.cast("int")).alias(k)

    def word(x: Column) -> Column:
        return F.nullif(F.trim(x), F.lit(""))

    wants = got["wants"]
    return F.struct(
        word(got["station"]).alias("station"),
        *(ranged(k) for k in limits),
        F.when(wants["academic"], True).alias("academic"),
        word(wants["priority"]).alias("priority"),
        resolve_department(word(wants["dept"])).alias("dept"),
        F.array_intersect(F.coalesce(wants["course_types"], F.array().cast("array<string>")), F.array(F.lit(EVENING), F.lit(COLLEGE))).alias("course_types"),
        F.filter(F.transform(F.coalesce(wants["clubs"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "").alias("clubs"),
        F.coalesce(got["declined"], F.array().cast("array<string>")).alias("declined"),
    )


def needs_model(slot: Column, found: Column) -> Column:
    """Whether a model should be asked: not if the slot asked for is answered or declined, always for wishes."""
    report = found["naishin5"].isNotNull() | found["jitsugi"].isNotNull() | found["sonai"].isNotNull()
    filled = F.when(slot == "naishin", report).when(slot == "station", found["station"].isNotNull()).when(slot == "commute_limit", found["commute_limit"].isNotNull()).when(slot == "toujitsu", found["toujitsu"].isNotNull()).otherwise(False)
    return slot.isNull() | (slot == "wants") | ~(filled | found["declines"])


def ask_model(rows: DataFrame, key: str, prompt: str, model: Callable[[str], str] | None, retries: int = 1) -> DataFrame:
    """key and reply of rows that need a model, as it gave it (see ``sanitised``); without one, or if it fails each time, the reply is null."""
    limits = models.Limits(attempts=retries + 1, again="")
    return models.answers(rows, key, prompt, model, limits=limits, check=lambda reply, _: reply if isinstance(reply, str) else None).select(key, "reply")


def resolve_station(asked: DataFrame, stations: DataFrame, most: int = 5) -> DataFrame:
    """req_id, station and candidates: the exact name, else the only name that contains what was said.

    Said names are cut to the substrings that stations have, by equality on their character pairs.
    """
    said = asked.select("req_id", F.regexp_replace(F.trim("said"), "駅$", "").alias("clean")).where("clean <> ''")
    exact = said.join(stations.select(F.col("station").alias("clean")).distinct().withColumn("exact", F.col("clean")), "clean", "left")
    words = exact.where("exact is null").select("clean").distinct()
    grams = stations.select("station").distinct().select("station", F.explode(F.array_distinct(_grams(F.col("station")))).alias("gram"))
    hits = words.withColumn("gram", F.substring("clean", 1, 2)).join(grams, "gram").where(F.contains("station", "clean")).select("clean", "station").distinct()
    ranked = hits.withColumn("nth", F.row_number().over(Window.partitionBy("clean").orderBy("station"))).where(F.col("nth") <= most)
    found = ranked.groupBy("clean").agg(F.array_sort(F.collect_list("station")).alias("candidates"))
    none = F.array().cast("array<string>")
    out = exact.join(found, "clean", "left").withColumn("candidates", F.coalesce("candidates", none))
    return out.select("req_id", F.coalesce("exact", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))).alias("station"), "candidates")


def _grams(x: Column) -> Column:
    """All single characters and pairs of a name."""
    at = F.sequence(F.lit(1), F.length(x))
    return F.concat(F.transform(at, lambda i: F.substring(x, i, F.lit(1))), F.transform(at, lambda i: F.substring(x, i, F.lit(2))))


def merge_turns(turns: DataFrame, session: str, turn: str, slots: str = "slots") -> DataFrame:
    """The state of each session: the last value said of each slot, lists united in order, flags latched."""
    def last(k: str) -> Column:
        v = F.col(f"{slots}.{k}")
        return F.max_by(v, F.when(v.isNotNull(), F.col(turn))).alias(k)

    def united(k: str) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(f"{slots}.{k}").alias("v")))), lambda x: x["v"])
        return F.array_distinct(F.flatten(parts)).alias(k)

    return turns.groupBy(session).agg(*(last(k) for k in ("station", *NUMERIC, "priority", "dept")), F.bool_or(F.coalesce(f"{slots}.academic", F.lit(False))).alias("academic"), united("course_types"), united("clubs"), F.count("*").alias("turns"))


def running_state(turns: DataFrame, session: str, turn: str, value: Column, name: str) -> DataFrame:
    """The last value up to each turn."""
    upto = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def slot_status(state: DataFrame, declined: str = "declined") -> DataFrame:
    """Which slots are filled, missing or declined; the next to ask for, and what is asked first.

    Invalid values are asked again before station candidates are offered, these before the next slot.
    """
    report = F.coalesce("naishin", F.col("naishin5") + F.col("jitsugi"), F.col("sonai"))
    filled = {
        "station": F.col("station").isNotNull(),
        "commute_limit": F.col("commute_limit").isNotNull(),
        "naishin": report.isNotNull(),
        "toujitsu": F.col("toujitsu").isNotNull(),
        "wants": F.col("academic") | F.col("dept").isNotNull() | (F.size("clubs") > 0) | F.col("priority").isNotNull(),
    }
    done = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in filled.items())))
    order = F.array(*map(F.lit, SLOTS))
    out = state.withColumn("filled", done).withColumn("missing", F.array_except(F.array_except(order, "filled"), F.coalesce(declined, F.array().cast("array<string>"))))
    out = out.withColumn("next", F.get("missing", F.lit(0)))
    partial = F.when(F.col("naishin5").isNotNull() & F.col("jitsugi").isNull(), "jitsugi").when(F.col("jitsugi").isNotNull() & F.col("naishin5").isNull(), "naishin5")
    out = out.withColumn("partial", partial)
    invalid = F.when(F.size("invalid") > 0, F.concat(F.lit("invalid:"), F.array_join("invalid", ","))) if "invalid" in state.columns else F.lit(None).cast("string")
    choice = F.when(F.size("candidates") > 1, F.concat(F.lit("choose:"), F.array_join("candidates", ","))) if "candidates" in state.columns else F.lit(None).cast("string")
    return out.withColumn("question", F.coalesce(invalid, choice, F.concat(F.lit("part:"), F.col("partial")), F.concat(F.lit("slot:"), F.col("next")), F.lit("search")))


def relax_reply(raw: Column, offered: Column) -> Column:
    """struct(key, declined, ambiguous, kind): what a reply to offered relaxations means.

    No comes before unclear words, these before numbers, numbers before words of one option, these before yes.
    """
    x = F.trim(F.coalesce(raw, F.lit("")))
    hinted = F.coalesce(*(F.when(x.rlike(p), True) for p in HINTS.values()), F.lit(False))
    unclear = x.rlike(UNCLEAR) & ~x.rlike(YES) & ~x.rlike("[1-9１-９]") & ~hinted
    digit = text.fold_digits(F.coalesce(_found(x, r"^([1-9１-９])\s*[。.]?$"), _found(x, r"([1-9１-９])\s*(?:番|つ目|つめ)"))).cast("int")
    numbered = F.when(digit <= F.size(offered), F.get(offered, digit - 1))
    hits = F.filter(offered, lambda k: F.coalesce(*(F.when(k == name, x.rlike(p)) for name, p in HINTS.items()), F.lit(False)))
    nothing = (x == "") | (F.size(offered) == 0)
    no = x.rlike(NO)
    open_ = ~nothing & ~no & ~unclear
    key = F.when(open_, F.coalesce(numbered, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))), F.when((F.size(hits) == 0) & x.rlike(YES) & (F.size(offered) == 1), F.get(offered, F.lit(0)))))
    which = open_ & numbered.isNull() & ((F.size(hits) > 1) | ((F.size(hits) == 0) & x.rlike(YES) & (F.size(offered) > 1)))
    ambiguous = ~nothing & ~no & (unclear | which)
    return F.struct(key.alias("key"), (~nothing & no).alias("declined"), ambiguous.alias("ambiguous"), F.when(ambiguous, F.when(unclear, "yesno").otherwise("which")).alias("kind"))


def apply_relaxation(state: DataFrame) -> DataFrame:
    """One relaxation per reply is added; an offer that was answered is gone, an unclear one stays."""
    answered = F.col("reply.key").isNotNull() | F.col("reply.declined")
    return state.withColumn("relaxations", F.when(F.col("reply.key").isNotNull(), F.array_distinct(F.concat("relaxations", F.array("reply.key")))).otherwise(F.col("relaxations"))).withColumn(
        "offered", F.when(answered, F.array().cast("array<string>")).otherwise(F.col("offered"))
    )


def budget(turns: DataFrame, session: str, turn: str, calls: Column, most: int = 30) -> DataFrame:
    """Model calls used before each turn, whether another is allowed, and what remains after it."""
    before = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    out = turns.withColumn("used", F.coalesce(F.sum(calls).over(before), F.lit(0)))
    return out.withColumn("allowed", F.col("used") < most).withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("used") - calls))


def rate_limit(calls: DataFrame, who: list[str], at: str, order: str, most: int = 6) -> DataFrame:
    """Calls with whether they are among the first of their hour."""
    hour = Window.partitionBy(*who, F.date_trunc("hour", at)).orderBy(at, order)
    return calls.withColumn("nth", F.row_number().over(hour)).withColumn("ok", F.col("nth") <= most)


def sessions(events: DataFrame, who: str, at: str, order: str, gap: str = "24 hours") -> DataFrame:
    """Events with the number of their session, which ends when nothing happens for the gap."""
    along = Window.partitionBy(who).orderBy(at, order)
    fresh = F.coalesce(F.col(at) > F.lag(at).over(along) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    return events.withColumn("__fresh", fresh.cast("int")).withColumn("session", F.sum("__fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")
