"""Set-oriented search: many requests against many candidates in one plan.

Requests, candidates and travel times are joined on their keys, filtered, judged by column expressions and
ranked per request by windows. Requests without a travel limit meet all candidates of the courses that they
want, by equality of the course, however many those are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import scoring
from larkspan.session import shared_folder

#: Parts into which the requests for one course are dealt, as one course may be most of the candidates.
SALTS = 64

#: Schools, and numbers of matched clubs, are broadcast up to so many rows (some 200 MB); beyond, candidates meet them by shuffle.
BROADCAST_ROWS = 1_000_000

# Default course, codes of courses and departments, quotas, categories of similar clubs.
FULL_TIME, EVENING, COLLEGE, TECHNICAL = "全日制", "定時制", "高専", "工"
DEFAULT_LIMIT, RELAXED_MINUTES, NO_MINUTES = 60, 15, 999
QUOTA = {"c": 1, "m": 2, "s": 1}
ORDER = {"c": 0, "m": 1, "s": 2}
CLUB_CATEGORIES = {
    "球技": ["サッカー", "野球", "バスケットボール", "バレーボール", "テニス", "卓球", "バドミントン", "ハンドボール", "ラグビー"],
    "武道": ["柔道", "剣道", "弓道", "空手", "相撲", "なぎなた"],
    "音楽": ["吹奏楽", "軽音楽", "音楽", "合唱", "箏曲", "オーケストラ"],
    "美術": ["美術", "書道", "写真", "漫画", "デザイン"],
    "理科": ["生物", "化学", "物理", "地学", "天文", "科学", "理科"],
}
RELAXATIONS = ("commute_15", "club_similar", "score_range")

REQUEST = T.StructType(
    [
        T.StructField("req_id", T.LongType()),
        T.StructField("station", T.StringType()),
        T.StructField("commute_limit", T.IntegerType()),
        T.StructField("no_commute_limit", T.BooleanType()),
        *(T.StructField(k, T.IntegerType()) for k in ("naishin", "naishin5", "jitsugi", "sonai", "toujitsu", "esat")),
        T.StructField("priority", T.StringType()),
        T.StructField("academic", T.BooleanType()),
        T.StructField("course_types", T.ArrayType(T.StringType())),
        T.StructField("dept", T.StringType()),
        T.StructField("clubs", T.ArrayType(T.StringType())),
        T.StructField("relaxations", T.ArrayType(T.StringType())),
    ]
)


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def validated(raw: DataFrame) -> DataFrame:
    """Requests of strings and arrays as typed ones: numbers out of range are null and named in ``invalid``."""
    given = {k: scoring.number(F.col(k).cast("string")) for k in scoring.RANGES}
    limit = F.col("commute_limit").try_cast("int")
    return raw.select(
        *(c for c in raw.columns if c not in {*given, "commute_limit", "priority", "clubs", "course_types", "free_text"}),
        *(scoring.valid(v, k).cast("int").alias(k) for k, v in given.items()),
        F.when(limit.between(1, 180), limit).alias("commute_limit"),
        F.when(F.col("priority").isin(*scoring.PRIORITIES), F.col("priority")).alias("priority"),
        F.slice(F.transform(F.filter(_list("clubs"), lambda x: F.trim(x) != ""), lambda x: F.substring(F.trim(x), 1, 30)), 1, 5).alias("clubs"),
        F.array_intersect(_list("course_types"), F.array(F.lit(EVENING), F.lit(COLLEGE))).alias("course_types"),
        F.when(F.size(_list("free_text")) > 10, F.slice(_list("free_text"), -10, 10)).otherwise(_list("free_text")).alias("free_text"),
        scoring.invalid_names(**given).alias("invalid"),
    )


def students(requests: DataFrame) -> DataFrame:
    """Requests with the estimate of the student's score."""
    return requests.withColumn("student", scoring.estimate(*(F.col(k) for k in ("naishin", "naishin5", "jitsugi", "sonai", "toujitsu", "esat"))))


def similar(terms: Column, categories: dict[str, list[str]]) -> Column:
    """Terms and all members of the categories that one of them names, in first-seen order."""
    def of(members: list[str]) -> Column:
        known = F.array(*map(F.lit, members))
        hit = F.exists(terms, lambda t: F.exists(known, lambda m: t.contains(m)))
        return F.when(hit, known).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(terms, *(of(m) for m in categories.values())))


def _wanted_clubs(requests: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    wide = F.when(F.array_contains("relaxations", "club_similar"), similar(F.col("clubs"), categories)).otherwise(F.col("clubs"))
    return requests.withColumn("terms", wide)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _wish(terms: Column, clubs: Column) -> Column:
    """The digest that stands for the terms and clubs of a request wherever rows are shuffled; null without terms."""
    lists = (F.array_join(F.transform(c, F.hex), ",", "-") for c in (terms, clubs))
    return F.when(F.size(terms) > 0, F.md5(F.concat_ws(";", *lists)))


def _club_sets(asked: DataFrame, clubs: DataFrame) -> DataFrame:
    """school, wish, matched, n_matched and n_exact: for each school and wish, the clubs that contain a wanted term, by name as written or normalised; sorted.

    Which names hold which terms is found once for all schools, before the names of a school are gathered. Kept as a table, since candidates need the
    numbers and only what is shown needs the names.
    """
    wishes = asked.where(F.size("terms") > 0).select("wish", "terms", "clubs").distinct()
    low, a, b = F.transform("terms", F.lower), F.lower("raw_name"), F.lower(F.coalesce("normalized", F.lit("")))
    listed = clubs.select("school", "raw_name", "normalized").distinct()
    hits = listed.select("raw_name", "normalized").distinct().join(wishes.select("wish", "terms"), F.exists(low, lambda t: F.contains(a, t) | F.contains(b, t)))
    held = listed.join(hits.select(F.col("raw_name").alias("__raw"), F.col("normalized").alias("__normal"), "wish"), (F.col("raw_name") == F.col("__raw")) & F.col("normalized").eqNullSafe(F.col("__normal")))
    named = held.groupBy("school", "wish").agg(F.array_sort(F.collect_set("raw_name")).alias("matched")).join(wishes.select("wish", "clubs"), "wish")
    exact = F.size(F.filter("matched", lambda c: F.exists("clubs", lambda w: c.contains(w))))
    sets, path = named.select("school", "wish", "matched", F.size("matched").alias("n_matched"), exact.alias("n_exact")), shared_folder(clubs.sparkSession, "clubs")
    sets.write.parquet(path)
    return clubs.sparkSession.read.schema(sets.schema).parquet(path)


def _counted(rows: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Candidates that the wish for clubs leaves, with the numbers of clubs that match."""
    if sets is None:
        return rows.withColumn("n_matched", F.lit(0)).withColumn("n_exact", F.lit(0))
    counted = rows.join(_small(sets.drop("matched")), ["school", "wish"], "left")
    counted = counted.withColumn("n_matched", F.coalesce("n_matched", F.lit(0))).withColumn("n_exact", F.coalesce("n_exact", F.lit(0)))
    return counted.where((F.col("n_wanted") == 0) | F.col("similar") | (F.col("n_matched") > 0))


def _named(rows: DataFrame, sets: DataFrame | None) -> DataFrame:
    """``matched``: the names of the clubs that match, for the numbers."""
    none, rows = F.array().cast("array<string>"), rows.drop("n_matched", "n_exact")
    if sets is None:
        return rows.withColumn("matched", none)
    return rows.join(sets.select("school", "wish", "matched"), ["school", "wish"], "left").withColumn("matched", F.coalesce("matched", none))


def _of_course(asked: DataFrame, schools: DataFrame) -> DataFrame:
    """Every request with every school of a course that it wants; no school has two of the courses that one request wants."""
    full, evening, college = (F.lit(c) for c in (FULL_TIME, EVENING, COLLEGE))
    wants = F.when(F.size("course_types") > 0, F.array_intersect("course_types", F.array(evening, college))).otherwise(F.array_compact(F.array(full, F.when(F.col("suggest"), college))))
    has = F.array_compact(F.array(F.when(F.contains("courses", full), full), F.when(F.contains("courses", evening), evening), F.when(F.col("courses") == COLLEGE, college)))
    left = asked.withColumn("__salt", F.pmod(F.xxhash64("req_id"), F.lit(SALTS))).withColumn("__course", F.explode(wants))
    right = schools.withColumn("__course", F.explode(has)).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, ["__salt", "__course"]).drop("__salt", "__course")


def candidates(requests: DataFrame, schools: DataFrame, commute: DataFrame, clubs: DataFrame | None = None, categories: dict[str, list[str]] = CLUB_CATEGORIES) -> DataFrame:
    """Every admissible (request, school) with travel minutes and matched clubs."""
    rows, sets = _admissible(requests, schools, commute, clubs, categories)
    return _named(rows, sets)


def _admissible(requests: DataFrame, schools: DataFrame, commute: DataFrame, clubs: DataFrame | None, categories: dict[str, list[str]]) -> tuple[DataFrame, DataFrame | None]:
    """Candidates with their tiers and the numbers of matched clubs, and the sets of these clubs.

    A wanted course narrows; a wish for technical subjects adds the college to the default course. Clubs narrow
    unless relaxed to similar ones, when candidates without any stay too.
    """
    asked = requests
    for name in ("course_types", "clubs", "relaxations"):
        asked = asked.withColumn(name, _list(name))
    asked = _wanted_clubs(students(asked), categories).withColumn("wish", _wish(F.col("terms"), F.col("clubs")))
    asked = _plain(asked)
    limit = F.coalesce("commute_limit", F.lit(DEFAULT_LIMIT)) + F.when(F.array_contains("relaxations", "commute_15"), RELAXED_MINUTES).otherwise(0)
    asked = asked.withColumn("suggest", F.coalesce(F.col("dept") == TECHNICAL, F.lit(False)) & (F.size("course_types") == 0)).withColumn("most", limit)
    mode = F.col("access_mode") if "access_mode" in commute.columns else F.lit(None).cast("string")
    times = commute.select("station", "school", F.col("minutes"), F.col("via"), mode.alias("access_mode"))
    within = asked.where(~F.coalesce("no_commute_limit", F.lit(False))).join(times, "station").where(F.col("minutes") <= F.col("most")).join(_small(schools), "school")
    free = asked.where(F.coalesce("no_commute_limit", F.lit(False)))
    open_ = _of_course(free, schools).join(times, ["station", "school"], "left")
    rows = within.unionByName(open_.select(*within.columns))
    course = (
        F.when(F.col("chooses"), (F.col("wants_evening") & F.col("courses").contains(EVENING)) | (F.col("wants_college") & (F.col("courses") == COLLEGE)))
        .otherwise(F.col("courses").contains(FULL_TIME) | (F.col("suggest") & (F.col("courses") == COLLEGE)))
    )
    rows = rows.where(~F.coalesce("no_admission", F.lit(False)) & F.coalesce(course, F.lit(False)))
    rows = rows.where(F.col("dept").isNull() | F.coalesce(F.col("departments").contains(F.col("dept")), F.lit(False)))
    sets = None if clubs is None else _club_sets(asked, clubs)
    return _counted(_tiered(rows), sets), sets


def _plain(asked: DataFrame) -> DataFrame:
    """Requests with what candidates ask of their arrays and of the student, so that none of these is shuffled."""
    no = F.lit(False)
    return asked.withColumns(
        {
            "n_wanted": F.size("clubs"),
            "chooses": F.size("course_types") > 0,
            "wants_evening": F.coalesce(F.array_contains("course_types", EVENING), no),
            "wants_college": F.coalesce(F.array_contains("course_types", COLLEGE), no),
            "similar": F.coalesce(F.array_contains("relaxations", "club_similar"), no),
            "relaxed": F.coalesce(F.array_contains("relaxations", "score_range"), no),
            "score": F.col("student.score"),
            "rough": F.coalesce("student.rough", no),
        }
    )


def _tiered(rows: DataFrame) -> DataFrame:
    """Candidates with tier, gap and what later steps ask of a request and a school together, so that few columns are shuffled."""
    no = F.lit(False)
    tier = scoring.tier(*(F.col(c) for c in ("selection_type", "target_score", "score", "rough", "relaxed")))
    foreign = F.coalesce(F.col("wants_evening") & F.col("courses").contains(EVENING) & F.col("courses").contains(FULL_TIME), no)
    scored, exempt = F.col("score").isNotNull(), F.coalesce(F.col("selection_type") == "no_exam", no)
    return rows.withColumns(
        {
            "tier": F.when(~foreign, tier),
            "gap": F.when(~foreign & ~exempt, F.col("score") - F.col("target_score")),
            "fits": F.coalesce(F.col("departments").contains(F.col("dept")), no),
            "scored": scored,
            "exempt": exempt,
            "college": F.coalesce(F.col("courses") == COLLEGE, no) & F.col("suggest") & scored,
        }
    )


def judged(rows: DataFrame) -> DataFrame:
    """Candidates with match score, and position by travel time (null last, then school)."""
    scored = rows.withColumn(
        "match_score", scoring.match_score(F.col("minutes"), F.col("tier"), F.col("priority"), F.col("academic"), F.col("designation"), F.col("fits"), F.col("n_matched"), F.col("n_exact"), F.col("n_wanted"))
    )
    near = Window.partitionBy("req_id").orderBy(F.col("minutes").asc_nulls_last(), "school")
    return scored.withColumn("pos", F.row_number().over(near))


def pick(rows: DataFrame) -> DataFrame:
    """The rows shown for each request, with ``mode``, ``role`` and the order in which they are shown.

    Without a score the four nearest. With one: quotas by tier (best match first), the four nearest if no tier
    has any, one school without examination where the estimate is rough or safe choices are few, and one
    suggested college.
    """
    whole = Window.partitionBy("req_id")
    by_tier = Window.partitionBy("req_id", "tier").orderBy(F.col("match_score").desc(), "pos")
    quota = F.when(F.col("tier") == "c", F.when(F.coalesce("academic", F.lit(False)), 2).otherwise(QUOTA["c"])).when(F.col("tier") == "m", QUOTA["m"]).when(F.col("tier") == "s", QUOTA["s"])
    ranked = rows.withColumn("in_tier", F.row_number().over(by_tier))
    ranked = ranked.withColumn("pool", F.count_if(F.col("tier").isNotNull()).over(whole))
    tiered = F.col("scored") & F.col("tier").isNotNull() & (F.col("in_tier") <= quota)
    ranked = ranked.withColumn("main", tiered | ((~F.col("scored") | (F.col("pool") == 0)) & (F.col("pos") <= 4)))
    ranked = ranked.withColumn("exempt_pos", F.min(F.when(F.col("exempt"), F.col("pos"))).over(whole)).withColumn("safe", F.count_if(F.col("main") & (F.col("tier") == "s")).over(whole))
    encourage = (
        F.col("scored") & ~F.col("main") & (F.col("pos") == F.col("exempt_pos")) & (F.col("rough") | (F.col("safe") == 0) | (F.col("pool") < 3))
    )
    ranked = ranked.withColumn("encourage", F.coalesce(encourage, F.lit(False)))
    college = F.col("college") & ~F.col("main") & ~F.col("encourage")
    ranked = ranked.withColumn("college_pos", F.min(F.when(college, F.col("pos"))).over(whole))
    ranked = ranked.withColumn("suggested", college & (F.col("pos") == F.col("college_pos")))
    role = F.when(F.col("main"), F.when(F.col("tier").isNotNull() & F.col("scored"), "tier").otherwise("near")).when(F.col("encourage"), "encourage").when(F.col("suggested"), "suggested")
    shown = ranked.withColumn("role", role).where("role is not null").withColumn("mode", F.when(F.col("scored"), "scored").otherwise("commute_only"))
    group = F.when(F.col("role") == "tier", F.coalesce(*(F.when(F.col("tier") == k, v) for k, v in ORDER.items()))).when(F.col("role") == "near", 3).when(F.col("role") == "encourage", 4).otherwise(5)
    nearness = F.when(F.col("priority") == "commute", F.coalesce("minutes", F.lit(NO_MINUTES))).otherwise(0)
    within = F.when(F.col("role") == "tier", F.col("in_tier")).otherwise(F.col("pos"))
    final = Window.partitionBy("req_id").orderBy(nearness, F.col("match_score").desc(), group, within)
    return shown.withColumn("rank", F.row_number().over(final))


def search(requests: DataFrame, schools: DataFrame, commute: DataFrame, clubs: DataFrame | None = None, categories: dict[str, list[str]] = CLUB_CATEGORIES) -> DataFrame:
    """What each request is shown; names of clubs and reasons are added to what is shown only."""
    rows, sets = _admissible(requests, schools, commute, clubs, categories)
    why = scoring.reasons(*(F.col(c) for c in ("minutes", "via", "access_mode", "tier", "priority", "academic", "designation", "dept", "fits", "matched")))
    return _named(pick(judged(rows)), sets).withColumn("why", why)


def attach(shown: DataFrame, achievements: DataFrame, uniforms: DataFrame) -> DataFrame:
    """Details of the shown schools only, as arrays; texts that are null read as empty."""
    keys = shown.select("school").distinct()
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in achievements.dtypes if c != "school"]
    listed = achievements.join(keys, "school", "left_semi").groupBy("school").agg(F.array_sort(F.collect_list(F.struct(*texts))).alias("achievements"))
    worn = uniforms.join(keys, "school", "left_semi").groupBy("school").agg(F.array_sort(F.collect_list(F.struct(*(c for c in uniforms.columns if c != "school")))).alias("uniforms"))
    return shown.join(listed, "school", "left").join(worn, "school", "left")


def relaxation_options(requests: DataFrame) -> DataFrame:
    """The relaxations that a request can still be offered, in order."""
    report = scoring.converted_report(*(F.col(k) for k in ("naishin", "naishin5", "jitsugi", "sonai")))
    useful = F.array_compact(F.array(F.lit("commute_15"), F.when(F.size(_list("clubs")) > 0, "club_similar"), F.when(report.isNotNull(), "score_range")))
    options = F.array_except(useful, _list("relaxations"))
    return requests.withColumn("options", options).withColumn("exhausted", F.size("options") == 0)


def listing(schools: DataFrame, *, ward: str | None = None, designation: str | None = None, q: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of schools by conjunctive filters, in order of their number; q is part of either name, in any case."""
    return filtered(schools, ward=ward, designation=designation, q=q).orderBy("school").offset(max(offset, 0)).limit(min(limit or 50, 200))


def filtered(schools: DataFrame, *, ward: str | None = None, designation: str | None = None, q: str | None = None) -> DataFrame:
    conditions = [F.col(k) == v for k, v in (("ward", ward), ("designation", designation)) if v]
    if q:
        conditions.append(F.contains(F.lower("name"), F.lower(F.lit(q))) | F.coalesce(F.contains(F.lower("kana"), F.lower(F.lit(q))), F.lit(False)))
    for c in conditions:
        schools = schools.where(c)
    return schools


def detail(schools: DataFrame, stats: DataFrame, school: Column | int | str) -> DataFrame:
    """One school with its yearly figures, newest first."""
    return schools.where(F.col("school") == school).join(stats, "school").orderBy(F.col("year").desc(), "department")


# Fixed value: the source of travel times that every answer names.
COMMUTE_SOURCE = "駅間所要時間の自前計算（station_database CC BY-SA 4.0 / 急行補正済）"


def answers(shown: DataFrame) -> DataFrame:
    """Shown rows as a user reads them: ranges, labels, notes and the sources of their figures.

    Columns of sources, layers and notes that the schools lack are null.
    """

    def own(name: str) -> Column:
        return F.col(name).cast("string") if name in shown.columns else F.lit(None).cast("string")

    foreign = F.coalesce(F.array_contains("course_types", EVENING) & F.col("courses").contains(EVENING) & F.col("courses").contains(FULL_TIME), F.lit(False))
    reason = scoring.tier_reason(F.col("selection_type"), F.col("target_score"), F.col("student.score"), F.col("tier"), F.col("gap"), F.col("courses"), foreign)
    sources = F.struct(own("source_master").alias("master"), own("source_designation").alias("designation"), own("source_target_score").alias("target_score"), F.lit(COMMUTE_SOURCE).alias("commute"))
    return shown.select(
        "req_id", "rank", "school", "name", "ward", "departments", "designation", F.col("minutes").alias("commute_minutes"), scoring.commute_range(F.col("minutes")).alias("commute_range"),
        "tier", F.coalesce(*(F.when(F.col("tier") == k, v) for k, v in scoring.TIER_LABELS.items())).alias("tier_label"), F.coalesce(reason, F.lit("")).alias("tier_reason"), F.when(F.col("target_score").isNotNull(), F.col("gap")).alias("score_gap"), "target_score", "selection_type",
        scoring.selection_note(own("selection_note"), F.col("selection_type")).alias("selection_note"), own("score_layer").alias("score_layer"), F.col("encourage"), F.col("courses").alias("course_types"),
        F.coalesce(F.size("course_types") > 0, F.lit(False)).alias("requested_course"), F.coalesce(F.col("role") == "suggested", F.lit(False)).alias("suggested_course"), F.col("matched").alias("matched_clubs"), "match_score", "why", sources.alias("sources"),
    )


def responses(requests: DataFrame, shown: DataFrame, commute: DataFrame) -> DataFrame:
    """Per request: status (400 without a station, 404 for an unknown one, else 200), number of rows, and offers if there are none."""
    known = commute.select("station").distinct().withColumn("__known", F.lit(True))
    counts = shown.groupBy("req_id").agg(F.count("*").alias("__n"))
    joined = relaxation_options(requests).join(known, "station", "left").join(counts, "req_id", "left")
    blank = F.coalesce(F.trim(F.col("station").cast("string")) == "", F.lit(True))
    status = F.when(blank, 400).when(F.col("__known").isNull(), 404).otherwise(200)
    n = F.when(status == 200, F.coalesce("__n", F.lit(0))).otherwise(0)
    error = F.when(blank, "station_required").when(F.col("__known").isNull(), "station_not_found")
    return joined.select("req_id", status.alias("status"), error.alias("error"), n.alias("count"), F.when((status == 200) & (n == 0), F.col("options")).alias("options"), ((status == 200) & (n == 0) & F.col("exhausted")).alias("exhausted"))
