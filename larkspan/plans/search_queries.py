"""Search, scoring and listing over the stand-ins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.api import Engine
from larkspan.functions import scoring
from larkspan.operators import explain, model, rollups, search
from larkspan.plans import standins as S
from larkspan.session import shared_folder
from larkspan.sources.snapshots import Store

#: Categories of similar clubs for the stand-in names.
CATEGORIES = {"metal": ["gear", "bolt", "rod"], "flat": ["plate", "ring"]}

QUERIES, ORACLES, query = S.registry()


def _strings(*values: Column) -> Column:
    return F.array_compact(F.array(*values))


def requests(spark: SparkSession, sf_dir: str, *, clubs: bool = False, relaxations: tuple[str, ...] = ()) -> DataFrame:
    base = S.of(spark, sf_dir, S.REQUESTS)
    wanted = F.when(F.col("req_id") % 2 == 0, F.array(F.lit("gear"))).otherwise(F.array(F.lit("bolt"), F.lit("plate"))) if clubs else F.array().cast("array<string>")
    return base.select("*", _strings(F.col("course")).alias("course_types"), wanted.alias("clubs"), F.array(*map(F.lit, relaxations)).cast("array<string>").alias("relaxations")).drop("course")


def _result(shown: DataFrame) -> DataFrame:
    return shown.select("req_id", "school", "rank", "role", "mode", "tier", "gap", "minutes", "match_score", F.array_join("matched", ",").alias("clubs"), F.array_join("why", "/").alias("why"))


def _run(spark: SparkSession, sf_dir: str, asked: DataFrame, schools: DataFrame | None = None, with_clubs: bool = False) -> DataFrame:
    schools = S.of(spark, sf_dir, S.SCHOOLS) if schools is None else schools
    clubs = S.of(spark, sf_dir, S.CLUBS) if with_clubs else None
    return search.search(asked, schools, S.of(spark, sf_dir, S.COMMUTE), clubs, CATEGORIES)


def _oracle(*, requests: str = "SELECT * FROM r0", schools: str = "SELECT * FROM s0", clubs: bool = False, similar: bool = False, final: str = "") -> str:
    terms = "CASE WHEN req_id % 2 = 0 THEN ['gear'] ELSE ['bolt', 'plate'] END" if clubs else "CAST([] AS VARCHAR[])"
    wide = "CASE WHEN req_id % 2 = 0 THEN ['gear', 'bolt', 'rod'] ELSE ['bolt', 'plate', 'gear', 'rod', 'ring'] END" if similar else terms
    kept = "TRUE" if similar or not clubs else "len(matched) > 0"
    return f"""{S.ctes(r0=S.REQUESTS, s0=S.SCHOOLS, c0=S.COMMUTE, k0=S.CLUBS)},
r1 AS ({requests}), s1 AS ({schools}),
r2 AS (SELECT *, CASE WHEN naishin5 BETWEEN 5 AND 25 AND jitsugi BETWEEN 4 AND 20 THEN naishin5 + 2 * jitsugi END AS kansan,
  CASE WHEN toujitsu BETWEEN 0 AND 500 THEN toujitsu END AS given, CASE WHEN esat BETWEEN 0 AND 20 THEN esat END AS e,
  dept IS NOT NULL AND dept = '工' AND course IS NULL AS suggest, {terms} AS wanted, {wide} AS terms FROM r1),
r3 AS (SELECT *, coalesce(given, CAST(floor(CAST(kansan AS DOUBLE) / 65 * 500 * CAST(0.95 AS DOUBLE) + 0.5) AS INT)) AS exam, given IS NULL AND kansan IS NOT NULL AS rough FROM r2),
r AS (SELECT *, CAST(floor(exam * CAST(1.4 AS DOUBLE) + kansan * (CAST(300 AS DOUBLE) / 65) + coalesce(e, 12) + CAST(0.5 AS DOUBLE)) AS INT) AS score FROM r3),
j0 AS (
  SELECT r.*, s.* EXCLUDE (school), c.school, c.minutes, c.via, c.access_mode,
    coalesce((SELECT list_sort(list_distinct(list(k.raw_name))) FROM k0 k WHERE k.school = c.school AND len(list_filter(r.terms, lambda t: contains(lower(k.raw_name), t) OR contains(lower(k.normalized), t))) > 0), CAST([] AS VARCHAR[])) AS matched
  FROM r JOIN c0 c ON c.station = r.station AND c.minutes <= r.commute_limit JOIN s1 s ON s.school = c.school
  WHERE NOT no_admission
    AND CASE course WHEN '定時制' THEN contains(courses, '定時制') WHEN '高専' THEN courses = '高専' ELSE contains(courses, '全日制') OR (suggest AND courses = '高専') END
    AND (dept IS NULL OR contains(departments, dept))),
j1 AS (SELECT *, coalesce(course = '定時制' AND contains(courses, '全日制'), FALSE) AS strange, score - target_score AS d FROM j0 WHERE {kept}),
j2 AS (SELECT *, CASE WHEN strange OR selection_type = 'no_exam' THEN NULL
  WHEN d > CASE WHEN rough THEN 280 ELSE 220 END THEN NULL WHEN d >= CASE WHEN rough THEN 90 ELSE 60 END THEN 's'
  WHEN d >= CASE WHEN rough THEN -90 ELSE -60 END THEN 'm' WHEN d >= CASE WHEN rough THEN -210 ELSE -160 END THEN 'c' END AS tier,
  CASE WHEN strange OR selection_type = 'no_exam' THEN NULL ELSE d END AS gap, CAST(greatest(0, floor((60 - minutes) / 2.0 + 0.5)) AS INT) AS near,
  len(list_filter(matched, lambda m: len(list_filter(wanted, lambda w: contains(m, w))) > 0)) AS exact FROM j1),
j3 AS (SELECT *, CAST(near * CASE WHEN priority = 'commute' THEN 2 ELSE 1 END
  + CASE tier WHEN 'm' THEN 40 WHEN 'c' THEN 25 WHEN 's' THEN 15 ELSE 0 END
  + CASE WHEN priority = 'reachable' AND tier = 's' THEN 40 WHEN priority = 'reachable' AND tier = 'm' THEN 10 ELSE 0 END
  + CASE WHEN academic AND designation IS NOT NULL THEN CASE WHEN priority = 'academic' THEN 40 ELSE 10 END ELSE 0 END
  + CASE WHEN dept IS NOT NULL THEN 40 ELSE 0 END
  + CASE WHEN len(matched) > 0 THEN 30 + CASE WHEN priority = 'club' THEN CASE WHEN exact > 0 THEN 30 * least(exact, greatest(len(wanted), 1)) ELSE 10 END ELSE 0 END ELSE 0 END AS INT) AS match_score,
  concat_ws('/', concat('通学', minutes, '分（', via || '駅から', CASE access_mode WHEN 'bus' THEN 'バス' ELSE '徒歩' END, '）'), CASE tier WHEN 's' THEN '安全圏' WHEN 'm' THEN '適正圏' WHEN 'c' THEN '挑戦圏' END,
    CASE WHEN priority = 'reachable' AND tier = 's' THEN 'いま届きそう' END, CASE WHEN academic AND designation IS NOT NULL THEN concat('大学進学重視 → ', designation) END,
    CASE WHEN dept IS NOT NULL THEN concat('学科の希望「', dept, '」に一致') END, CASE WHEN len(matched) > 0 THEN concat('希望の部活: ', array_to_string(matched, '・')) END) AS why,
  row_number() OVER (PARTITION BY req_id ORDER BY minutes, school) AS pos FROM j2),
j4 AS (SELECT *, row_number() OVER (PARTITION BY req_id, tier ORDER BY match_score DESC, pos) AS in_tier, count(tier) OVER (PARTITION BY req_id) AS pool FROM j3),
j5 AS (SELECT *, (score IS NOT NULL AND tier IS NOT NULL AND in_tier <= CASE tier WHEN 'c' THEN CASE WHEN academic THEN 2 ELSE 1 END WHEN 'm' THEN 2 ELSE 1 END)
  OR ((score IS NULL OR pool = 0) AND pos <= 4) AS main FROM j4),
j6 AS (SELECT *, min(CASE WHEN selection_type = 'no_exam' THEN pos END) OVER (PARTITION BY req_id) AS exempt_pos, count(*) FILTER (main AND tier = 's') OVER (PARTITION BY req_id) AS safe FROM j5),
j7 AS (SELECT *, coalesce(score IS NOT NULL AND NOT main AND pos = exempt_pos AND (rough OR safe = 0 OR pool < 3), FALSE) AS encourage FROM j6),
j8 AS (SELECT *, courses = '高専' AND suggest AND score IS NOT NULL AND NOT main AND NOT encourage AS college FROM j7),
j9 AS (SELECT *, min(CASE WHEN college THEN pos END) OVER (PARTITION BY req_id) AS college_pos FROM j8),
shown AS (SELECT *, CASE WHEN main THEN CASE WHEN tier IS NOT NULL AND score IS NOT NULL THEN 'tier' ELSE 'near' END WHEN encourage THEN 'encourage' WHEN college AND pos = college_pos THEN 'suggested' END AS role,
  CASE WHEN score IS NULL THEN 'commute_only' ELSE 'scored' END AS mode FROM j9),
ranked AS (SELECT req_id, school, row_number() OVER (PARTITION BY req_id ORDER BY CASE WHEN priority = 'commute' THEN minutes ELSE 0 END, match_score DESC,
    CASE role WHEN 'tier' THEN CASE tier WHEN 'c' THEN 0 WHEN 'm' THEN 1 ELSE 2 END WHEN 'near' THEN 3 WHEN 'encourage' THEN 4 ELSE 5 END, CASE WHEN role = 'tier' THEN in_tier ELSE pos END) AS rank,
  role, mode, tier, gap, minutes, match_score, array_to_string(matched, ',') AS clubs, why FROM shown WHERE role IS NOT NULL)
{final or 'SELECT * FROM ranked'}"""


@query("search_tiered", _oracle())
def search_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(_run(spark, sf_dir, requests(spark, sf_dir)))


@query("search_commute_only", _oracle(requests="SELECT * REPLACE (CAST(NULL AS INT) AS naishin5) FROM r0"))
def search_commute_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(_run(spark, sf_dir, requests(spark, sf_dir).withColumn("naishin5", F.lit(None).cast("int"))))


@query("search_club_filter", _oracle(clubs=True))
def search_club_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(_run(spark, sf_dir, requests(spark, sf_dir, clubs=True), with_clubs=True))


@query("search_club_similar", _oracle(clubs=True, similar=True))
def search_club_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(_run(spark, sf_dir, requests(spark, sf_dir, clubs=True, relaxations=("club_similar",)), with_clubs=True))


@query("search_fallback_top4", _oracle(schools="SELECT * REPLACE (CAST(NULL AS INT) AS target_score) FROM s0"))
def search_fallback_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(_run(spark, sf_dir, requests(spark, sf_dir), S.of(spark, sf_dir, S.SCHOOLS).withColumn("target_score", F.lit(None).cast("int"))))


@query("search_encourage_append", _oracle(requests="SELECT * REPLACE ('工' AS dept, CAST(NULL AS VARCHAR) AS course) FROM r0", final="SELECT * FROM ranked WHERE role IN ('encourage', 'suggested')"))
def search_encourage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).withColumn("dept", F.lit("工")).withColumn("course_types", F.array().cast("array<string>"))
    return _result(_run(spark, sf_dir, asked)).where(F.col("role").isin("encourage", "suggested"))


@query("tier_tally", _oracle(final="""
, l AS (SELECT req_id, CASE tier WHEN 's' THEN '安全圏' WHEN 'm' THEN '適正圏' WHEN 'c' THEN '挑戦圏' ELSE '判定なし' END AS label, count(*) AS n, min(rank) AS first FROM ranked GROUP BY ALL)
SELECT req_id, string_agg(concat(label, n, '校'), '、' ORDER BY first) AS tally FROM l GROUP BY req_id"""))
def tier_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.tier_tally(_run(spark, sf_dir, requests(spark, sf_dir)))


@query(
    "condition_text",
    f"""{S.ctes(r0=S.REQUESTS)} SELECT req_id, concat_ws('・', station || '駅から', concat(commute_limit, '分以内'), '学科は' || dept, CASE WHEN academic THEN '進学を重視' END) AS text FROM r0""",
)
def condition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("req_id", explain.condition_text().alias("text"))


@query(
    "relaxation_options",
    f"""{S.ctes(r0=S.REQUESTS)} SELECT req_id, concat_ws(',', CASE WHEN req_id % 4 <> 0 THEN 'commute_15' END, 'club_similar', CASE WHEN naishin5 BETWEEN 5 AND 25 AND jitsugi BETWEEN 4 AND 20 THEN 'score_range' END) AS options, FALSE AS exhausted FROM r0""",
)
def relaxation_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.when(F.col("req_id") % 4 == 0, F.array(F.lit("commute_15"))).otherwise(F.array().cast("array<string>"))
    asked = requests(spark, sf_dir, clubs=True).withColumn("relaxations", used)
    return search.relaxation_options(asked).select("req_id", F.array_join("options", ",").alias("options"), "exhausted")


@query("list_filter_page", f"""{S.ctes(s0=S.SCHOOLS)} SELECT school, name, ward, designation FROM s0 WHERE designation = 'ASIA' AND contains(lower(name), 'supplier') ORDER BY school LIMIT 50 OFFSET 2""")
def list_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.listing(S.of(spark, sf_dir, S.SCHOOLS), designation="ASIA", q="SUPPLIER", offset=2).select("school", "name", "ward", "designation")


@query("list_total", f"""{S.ctes(s0=S.SCHOOLS)} SELECT count(*) AS total, count(*) FILTER (designation IS NOT NULL) AS designated FROM s0 WHERE contains(lower(name), '1')""")
def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(S.of(spark, sf_dir, S.SCHOOLS), q="1").agg(F.count("*").alias("total"), F.count_if(F.col("designation").isNotNull()).alias("designated"))


@query("detail_stats_desc", f"""{S.ctes(s0=S.SCHOOLS, t0=S.STATS)} SELECT school, name, year, department, capacity, applicants FROM s0 JOIN t0 USING (school)""")
def detail_stats_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = search.detail(S.of(spark, sf_dir, S.SCHOOLS), S.of(spark, sf_dir, S.STATS), F.col("school"))
    return joined.select("school", "name", "year", "department", "capacity", "applicants")


@query(
    "detail_attach",
    f"""{S.ctes(s0=S.SCHOOLS, a0=S.RESULTS, k0=S.CLUBS)},
a AS (SELECT school, count(*) AS n_results, min(rank) AS first_rank FROM a0 GROUP BY school), k AS (SELECT school, count(*) AS n_uniforms FROM k0 GROUP BY school)
SELECT s0.school, coalesce(n_results, 0) AS n_results, first_rank, coalesce(n_uniforms, 0) AS n_uniforms FROM s0 LEFT JOIN a USING (school) LEFT JOIN k USING (school)""",
)
def detail_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.attach(S.of(spark, sf_dir, S.SCHOOLS).select("school"), S.of(spark, sf_dir, S.RESULTS).select("school", "rank"), S.of(spark, sf_dir, S.CLUBS).select("school", "raw_name", "brand"))
    return found.select("school", F.size(F.coalesce("achievements", F.array())).cast("long").alias("n_results"), F.get("achievements", F.lit(0))["rank"].alias("first_rank"), F.size(F.coalesce("uniforms", F.array())).cast("long").alias("n_uniforms"))


@query("health_counts", "SELECT 'supplier' AS name, count(*) AS n, 100 AS expected, count(*) = 100 AS ok FROM supplier UNION ALL SELECT 'nation', count(*), 25, count(*) = 25 FROM nation UNION ALL SELECT 'region', count(*), NULL, FALSE FROM region")
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: S.table(spark, sf_dir, n) for n in ("supplier", "nation", "region")}
    return rollups.expected_counts(tables, {"supplier": 100, "nation": 25})


@query(
    "engine_health",
    f"""{S.ctes(s0=S.SCHOOLS, c0=S.COMMUTE)} SELECT 'schools' AS name, count(*) AS n, 100 AS expected, count(*) = 100 AS ok FROM s0 UNION ALL SELECT 'commute', count(*), NULL, false FROM c0
UNION ALL SELECT 'join', count(*), NULL, count(*) > 0 FROM s0 WHERE school IN (SELECT school FROM c0) UNION ALL SELECT 'store', 1, 1, true""",
)
def engine_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables counted, schools joined to ways, and a value put and read back."""
    engine = Engine(S.of(spark, sf_dir, S.SCHOOLS), S.of(spark, sf_dir, S.COMMUTE))
    return engine.health({"schools": 100}, Store(spark, shared_folder(spark, "health")))


@query("health_join", "SELECT count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 1")
def health_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").where("o_custkey = 1")
    lines = S.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(S.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).agg(F.count("*").alias("n"))


_RAW = """SELECT c_custkey AS req_id, CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 70 AS INT) END AS naishin, CAST(c_custkey % 28 AS INT) AS naishin5,
  CASE WHEN c_custkey % 4 <> 1 THEN CAST(c_custkey % 23 AS INT) END AS jitsugi, CAST(c_custkey % 50 AS INT) AS sonai,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 540 AS INT) END AS toujitsu, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 25 AS INT) END AS esat FROM {customer}"""
_VALID = "naishin BETWEEN 9 AND 65", "naishin5 BETWEEN 5 AND 25", "jitsugi BETWEEN 4 AND 20", "sonai BETWEEN 9 AND 45", "toujitsu BETWEEN 0 AND 500", "esat BETWEEN 0 AND 20"
_ESTIMATE = f"""{S.ctes(x0=_RAW)},
x1 AS (SELECT *, CASE WHEN {_VALID[0]} THEN naishin WHEN {_VALID[1]} AND {_VALID[2]} THEN naishin5 + 2 * jitsugi END AS exact FROM x0),
x2 AS (SELECT *, coalesce(exact, CASE WHEN {_VALID[3]} THEN CAST(floor(CAST(sonai * 13 AS DOUBLE) / 9 + 0.5) AS INT) END) AS kansan, CASE WHEN {_VALID[4]} THEN toujitsu END AS given FROM x1),
x3 AS (SELECT *, CASE WHEN kansan IS NOT NULL THEN coalesce(given, CAST(floor(CAST(kansan AS DOUBLE) / 65 * 500 * CAST(0.95 AS DOUBLE) + 0.5) AS INT)) END AS exam FROM x2),
x4 AS (SELECT req_id, kansan, exam, given IS NULL AND kansan IS NOT NULL AS exam_rough, exact IS NULL AND kansan IS NOT NULL AS report_rough,
  CAST(floor(exam * CAST(1.4 AS DOUBLE) + kansan * (CAST(300 AS DOUBLE) / 65) + coalesce(CASE WHEN {_VALID[5]} THEN esat END, 12) + CAST(0.5 AS DOUBLE)) AS INT) AS score,
  concat_ws(',', {", ".join(f"CASE WHEN {v.split()[0]} IS NOT NULL AND NOT {v} THEN '{v.split()[0]}' END" for v in (_VALID[1], _VALID[2], _VALID[0], _VALID[3], _VALID[4], _VALID[5]))}) AS invalid FROM x3)"""


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.of(spark, sf_dir, _RAW)
    names = ("naishin", "naishin5", "jitsugi", "sonai", "toujitsu", "esat")
    return raw.withColumn("student", scoring.estimate(*(F.col(k) for k in names))).withColumn("invalid", F.array_join(scoring.invalid_names(**{k: F.col(k) for k in scoring.RANGES}), ","))


@query("student_estimate", _ESTIMATE + " SELECT * FROM x4")
def student_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimated(spark, sf_dir).select("req_id", "student.kansan", "student.exam", "student.exam_rough", "student.report_rough", "student.score", "invalid")


@query(
    "tier_matrix",
    _ESTIMATE
    + f""", s0 AS ({S.duck(S.SCHOOLS)}), g AS (SELECT DISTINCT target_score, selection_type FROM s0), m AS (SELECT DISTINCT score, exam_rough OR report_rough AS rough FROM x4 WHERE score IS NOT NULL),
b AS (SELECT *, score - target_score AS d, relaxed * 80 AS bonus FROM m, g, (VALUES (0), (1)) AS v(relaxed))
SELECT rough, relaxed = 1 AS relaxed, CASE WHEN selection_type = 'no_exam' THEN NULL WHEN d > CASE WHEN rough THEN 280 ELSE 220 END + bonus THEN NULL WHEN d >= CASE WHEN rough THEN 90 ELSE 60 END THEN 's'
  WHEN d >= CASE WHEN rough THEN -90 ELSE -60 END - bonus THEN 'm' WHEN d >= CASE WHEN rough THEN -210 ELSE -160 END - bonus THEN 'c' END AS tier, count(*) AS n, min(d) AS least, max(d) AS most FROM b GROUP BY ALL""",
)
def tier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _estimated(spark, sf_dir).select("student.score", "student.rough").where("score is not null").distinct()
    targets = S.of(spark, sf_dir, S.SCHOOLS).select("target_score", "selection_type").distinct()
    # scores and targets have a few hundred values each, however many rows there are
    both = scores.crossJoin(targets).withColumn("relaxed", F.explode(F.array(F.lit(False), F.lit(True))))
    tier = scoring.tier(F.col("selection_type"), F.col("target_score"), F.col("score"), F.col("rough"), F.col("relaxed"))
    gap = F.col("score") - F.col("target_score")
    return both.groupBy("rough", "relaxed", tier.alias("tier")).agg(F.count("*").alias("n"), F.min(gap).alias("least"), F.max(gap).alias("most"))


@query(
    "request_validation",
    f"""{S.ctes(x0=_RAW)} SELECT req_id, CASE WHEN {_VALID[1]} THEN naishin5 END AS naishin5, CASE WHEN {_VALID[4]} THEN toujitsu END AS toujitsu,
  CASE WHEN req_id % 200 BETWEEN 1 AND 180 THEN CAST(req_id % 200 AS INT) END AS commute_limit, CASE WHEN req_id % 2 = 0 THEN 'club' END AS priority,
  'a,b,c,d,e' AS clubs, '定時制' AS course_types, CASE WHEN req_id % 3 = 0 THEN 10 ELSE 2 END AS n_free FROM x0""",
)
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.of(spark, sf_dir, _RAW).select(
        "req_id",
        *(F.col(k).cast("string").alias(k) for k in scoring.RANGES),
        (F.col("req_id") % 200).cast("string").alias("commute_limit"),
        F.when(F.col("req_id") % 2 == 0, "club").otherwise("speed").alias("priority"),
        F.array(*map(F.lit, (" a", "b", "", "c", "d", "e", "f"))).alias("clubs"),
        F.array(F.lit("夜間"), F.lit("定時制")).alias("course_types"),
        F.when(F.col("req_id") % 3 == 0, F.array_repeat(F.lit("x"), 12)).otherwise(F.array(F.lit("y"), F.lit("z"))).alias("free_text"),
    )
    out = search.validated(raw)
    return out.select("req_id", "naishin5", "toujitsu", "commute_limit", "priority", F.array_join("clubs", ",").alias("clubs"), F.array_join("course_types", ",").alias("course_types"), F.size("free_text").alias("n_free"))


@query("commute_range", f"""{S.ctes(c0=S.COMMUTE)} SELECT station, school, concat(greatest(5, CAST(floor(minutes / 15) AS INT) * 15), '〜', greatest(5, CAST(floor(minutes / 15) AS INT) * 15) + 15, '分') AS text FROM c0""")
def commute_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of(spark, sf_dir, S.COMMUTE).select("station", "school", scoring.commute_range(F.col("minutes")).alias("text"))


@query("selection_note", f"""{S.ctes(s0=S.SCHOOLS)} SELECT school, coalesce(CASE WHEN school % 5 = 0 THEN concat('n', school) END, CASE WHEN selection_type = 'no_exam' THEN '学力検査なし（面接・作文で選抜）' END) AS note FROM s0""")
def selection_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("school") % 5 == 0, F.concat(F.lit("n"), F.col("school").cast("string"))).otherwise("")
    return S.of(spark, sf_dir, S.SCHOOLS).select("school", scoring.selection_note(own, F.col("selection_type")).alias("note"))


#: One request without a limit from each nation.
_OPEN = """
SELECT n_nationkey AS req_id, CAST(n_nationkey AS STRING) AS station, CAST(NULL AS INT) AS commute_limit, TRUE AS no_commute_limit,
  CAST(NULL AS INT) AS naishin, CAST(5 + n_nationkey % 21 AS INT) AS naishin5, CAST(4 + n_nationkey % 17 AS INT) AS jitsugi, CAST(NULL AS INT) AS sonai,
  CAST(NULL AS INT) AS toujitsu, CAST(NULL AS INT) AS esat, CAST(NULL AS STRING) AS priority, FALSE AS academic, CASE WHEN n_nationkey % 5 = 0 THEN '工' END AS dept,
  CASE WHEN n_nationkey % 7 = 0 THEN '定時制' WHEN n_nationkey % 11 = 0 THEN '高専' END AS course
FROM {nation}"""


@query(
    "search_no_limit",
    f"""{S.ctes(r0=_OPEN, s0=S.SCHOOLS, c0=S.COMMUTE)}
SELECT req_id, s0.school, c0.minutes FROM r0 CROSS JOIN s0 LEFT JOIN c0 ON c0.station = r0.station AND c0.school = s0.school
WHERE NOT no_admission AND CASE course WHEN '定時制' THEN contains(courses, '定時制') WHEN '高専' THEN courses = '高専' ELSE contains(courses, '全日制') OR (dept IS NOT NULL AND course IS NULL AND courses = '高専') END
  AND (dept IS NULL OR contains(departments, dept))""",
)
def search_no_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.of(spark, sf_dir, _OPEN)
    none = F.array().cast("array<string>")
    asked = asked.select("*", _strings(F.col("course")).alias("course_types"), none.alias("clubs"), none.alias("relaxations")).drop("course")
    return search.candidates(asked, S.of(spark, sf_dir, S.SCHOOLS), S.of(spark, sf_dir, S.COMMUTE)).select("req_id", "school", "minutes")


_LABEL = "CASE tier WHEN 's' THEN '安全圏' WHEN 'm' THEN '適正圏' WHEN 'c' THEN '挑戦圏' END"
_REASON = f"""CASE WHEN course = '定時制' AND contains(courses, '全日制') AND contains(courses, '定時制') THEN '{scoring.NO_TIER["併設"]}' WHEN selection_type = 'no_exam' THEN '{scoring.NO_TIER["no_exam"]}'
  WHEN target_score IS NULL THEN CASE WHEN courses = '高専' THEN '{scoring.NO_TIER["高専"]}' WHEN courses = '定時制' THEN '{scoring.NO_TIER["定時制"]}' ELSE '{scoring.NO_TIER["target"]}' END
  WHEN score IS NULL THEN '{scoring.NO_TIER["score"]}' WHEN tier = 's' THEN '{scoring.TIER_REASONS["s"]}' WHEN tier = 'm' THEN '{scoring.TIER_REASONS["m"]}' WHEN tier = 'c' THEN '{scoring.TIER_REASONS["c"]}'
  WHEN gap > 0 THEN '{scoring.NO_TIER["above"]}' ELSE '{scoring.NO_TIER["below"]}' END"""
_ANSWERED = f"""
, a AS (SELECT k.req_id, k.school, k.rank, k.tier, k.minutes, {_LABEL.replace("tier", "k.tier")} AS tier_label, r.course, s1.name, s1.ward, s1.designation, s1.courses, CASE WHEN s1.target_score IS NOT NULL THEN k.gap END AS score_gap,
  CASE WHEN s1.selection_type = 'no_exam' THEN '学力検査なし（面接・作文で選抜）' END AS selection_note, k.role, {_REASON.replace("gap", "k.gap").replace("tier =", "k.tier =")} AS tier_reason
  FROM ranked k JOIN r USING (req_id) JOIN s1 ON s1.school = k.school)
SELECT req_id, school, rank, tier_label, tier_reason, score_gap, concat(greatest(5, CAST(floor(minutes / 15) AS INT) * 15), '〜', greatest(5, CAST(floor(minutes / 15) AS INT) * 15) + 15, '分') AS commute_range, selection_note,
  course IS NOT NULL AS requested_course, role = 'suggested' AS suggested_course, role = 'encourage' AS encourage,
  concat_ws('。', concat(name, 'は', ward, 'にある学校で、通学はおよそ', minutes, '分です'),
    CASE WHEN tier_label IS NOT NULL THEN concat('合格の見込みは', tier_label, coalesce(concat('（目安点との差 ', CASE WHEN score_gap > 0 THEN '+' ELSE '' END, CAST(score_gap AS VARCHAR), '点）'), '')) ELSE tier_reason END,
    designation || 'に指定されています', CASE WHEN role = 'encourage' THEN '学力検査によらない選抜のため、点数では判定していませんが候補に残しています' END, CASE WHEN role = 'suggested' THEN 'ものづくり系をお探しなので、5年制の高専も挙げています' END,
    CASE WHEN course IS NOT NULL THEN CASE WHEN courses = '高専' THEN 'ご希望の高専です' WHEN contains(courses, '全日制') THEN '全日制と定時制の両方がある学校で、ご希望の定時制課程があります' ELSE 'ご希望の定時制です' END END,
    selection_note) || '。' AS text FROM a"""


@query("search_answers", _oracle(final=_ANSWERED))
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = search.answers(_run(spark, sf_dir, requests(spark, sf_dir))).withColumn("text", explain.school_text())
    return told.select("req_id", "school", "rank", "tier_label", "tier_reason", "score_gap", "commute_range", "selection_note", "requested_course", "suggested_course", "encourage", "text")


_PRIORITY_SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in explain.PRIORITY_SAID.items())


@query("search_summary", _oracle(final=f"""
, l AS (SELECT req_id, {_LABEL} AS label, count(*) AS n, min(rank) AS first FROM ranked GROUP BY ALL),
t AS (SELECT req_id, CAST(sum(n) AS BIGINT) AS n, string_agg(label || n || '校', '・' ORDER BY first) AS tally FROM l GROUP BY req_id),
c AS (SELECT r.*, concat_ws('、', concat(station, '駅から', commute_limit, '分以内'), course || 'のある学校', concat('学科は「' || dept, '」'), CASE WHEN academic THEN '大学進学に力を入れている学校' END, CASE priority {_PRIORITY_SAID} END,
  CASE WHEN score IS NOT NULL THEN concat('お子さんの成績（換算内申', kansan, CASE WHEN rough THEN '・概算' ELSE '' END, '）') END) AS said FROM r)
SELECT req_id, CASE WHEN n IS NULL THEN said || 'で探しましたが、条件をすべて満たす学校は見つかりませんでした。' ELSE concat(said, 'で、', n, '校が見つかりました。',
  CASE WHEN score IS NULL THEN '成績の入力がないため、合格の見込みは判定せず、通学の近い順にご案内しています。' WHEN rough THEN '成績が概算のため、合格の見込みは幅を広めに取っています。' ELSE '' END, coalesce('内訳は' || tally || 'です。', '')) END AS text FROM c LEFT JOIN t USING (req_id)""").replace("concat('学科は「' || dept, '」')", "'学科は「' || dept || '」'"))
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir)
    return explain.summaries(asked, _run(spark, sf_dir, asked))


def _stub(prompt: str) -> str:
    """A model that says how many schools the facts tell of, lies about one in three and fails for one in five."""
    found = json.loads(prompt.partition("\n\n")[0])
    if found["件数"] % 5 == 4:
        raise TimeoutError
    return f"<think>{found['件数'] + 90000}</think>{found['件数']}校です。" if found["件数"] % 3 else f"{found['件数'] + 90000}校です。"


@query("search_rewrite", _oracle(final="""
, l AS (SELECT req_id, count(*) AS n FROM ranked GROUP BY 1), c AS (SELECT req_id, coalesce(n, 0) AS n, req_id % 6 = 5 AS spent FROM r LEFT JOIN l USING (req_id))
SELECT req_id, CASE WHEN spent THEN 'template(budget_exhausted)' WHEN n % 5 = 4 OR n % 3 = 0 THEN 'template(llm_failed)' ELSE 'llm' END AS source, CASE WHEN NOT spent AND n % 5 <> 4 AND n % 3 <> 0 THEN concat(n, '校です。') END AS said,
  CAST(CASE WHEN spent THEN 0 WHEN n % 5 = 4 OR n % 3 = 0 THEN 2 ELSE 1 END AS INT) AS attempts FROM c"""))
def search_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations by a model that fails, and lies, and has no budget for some requests; what it may not say is the template."""
    asked = requests(spark, sf_dir)
    allowed = asked.select("req_id", (F.col("req_id") % 6 != 5).alias("allowed"))
    told = model.explained(asked, _run(spark, sf_dir, asked), _stub, allowed=allowed)
    return told.select("req_id", "source", F.when(F.col("source") == "llm", F.col("text")).alias("said"), "attempts")


@query("search_status", _oracle(
    requests="SELECT * REPLACE (CASE WHEN req_id % 10 = 3 THEN ' ' WHEN req_id % 10 = 4 THEN '-' ELSE station END AS station) FROM r0",
    final="""
SELECT req_id, CASE WHEN station = ' ' THEN 400 WHEN station NOT IN (SELECT station FROM c0) THEN 404 ELSE 200 END AS status, count(rank) AS count,
  CASE WHEN station IN (SELECT station FROM c0) AND count(rank) = 0 THEN concat_ws(',', 'commute_15', CASE WHEN any_value(kansan) IS NOT NULL THEN 'score_range' END) END AS options FROM r LEFT JOIN ranked USING (req_id) GROUP BY req_id, station""",
))
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("req_id") % 10
    asked = requests(spark, sf_dir).withColumn("station", F.when(key == 3, " ").when(key == 4, "-").otherwise(F.col("station")))
    got = search.responses(asked, _run(spark, sf_dir, asked), S.of(spark, sf_dir, S.COMMUTE))
    return got.select("req_id", "status", "count", F.array_join("options", ",").alias("options"))
