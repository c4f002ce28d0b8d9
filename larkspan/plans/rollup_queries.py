"""Aggregations, ranks, histograms, sets and checks over the stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import dates, ranks, text
from larkspan.operators import graph, joins, quality, rollups, sequences
from larkspan.plans import standins as S
from larkspan.session import shared_folder
from larkspan.sources import readers, sinks, snapshots

QUERIES, ORACLES, query = S.registry()

_POINTS = """CASE WHEN rank = '優勝' THEN 100 WHEN rank = '準優勝' THEN 95
  WHEN regexp_matches(rank, '^ベスト\\d+') THEN greatest(50, 90 - CAST(regexp_extract(rank, '(\\d+)', 1) AS INT))
  WHEN regexp_matches(rank, '\\d+位') THEN greatest(20, 92 - 2 * CAST(regexp_extract(rank, '(\\d+)', 1) AS INT))
  WHEN regexp_matches(rank, '^\\d+回戦') THEN 10 + CAST(regexp_extract(rank, '(\\d+)', 1) AS INT) ELSE 5 END"""
_LEVEL = "CASE meet WHEN '全国大会' THEN 3 WHEN '関東大会' THEN 2 ELSE 1 END"
_STRENGTH = """CASE WHEN rank = '準優勝' THEN 999 WHEN rank = '優勝' THEN 1000
  WHEN regexp_matches(rank, '^\\d+位$') THEN 998 - CAST(regexp_extract(rank, '(\\d+)', 1) AS INT) ELSE 0 END"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of(spark, sf_dir, S.RESULTS)


@query(
    "best_achievement",
    f"""{S.ctes(a0=S.RESULTS)}, a AS (SELECT *, {_LEVEL} AS level, {_POINTS} AS points FROM a0)
SELECT school, division, year, meet, rank, level, points, CASE WHEN level >= 2 AND ((regexp_matches(rank, '^\\d+位$') AND coalesce(TRY_CAST(regexp_extract(rank, '(\\d+)', 1) AS INT), 0) > 8) OR regexp_matches(rank, '^\\d+回戦$')) THEN '出場' ELSE rank END AS shown
FROM a QUALIFY row_number() OVER (PARTITION BY school, division ORDER BY official DESC, level DESC, points DESC, seq) = 1""",
)
def best_achievement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.best_achievement(_results(spark, sf_dir), ["school", "division"]).select("school", "division", "year", "meet", "rank", "level", "points", "shown")


@query("strength_best", f"""{S.ctes(a0=S.RESULTS)} SELECT school, year, meet, max_by(rank, [{_STRENGTH}, 0]) AS rank, max({_STRENGTH}) AS strength FROM (SELECT * FROM a0 ORDER BY rank) GROUP BY ALL""".replace(f"max_by(rank, [{_STRENGTH}, 0])", f"arg_max(rank, concat(lpad(CAST({_STRENGTH} AS VARCHAR), 5, '0'), rank))"))
def strength_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.strongest(_results(spark, sf_dir), ["school", "year", "meet"])


_GAMES = "SELECT l_suppkey AS school, CAST(year(l_shipdate) AS INT) AS year, l_orderkey % 8 + 1 AS stage, l_returnflag = 'A' AS won FROM {lineitem}"


@query(
    "furthest_stage",
    f"""{S.ctes(g0=_GAMES)}, b AS (SELECT school, year, max(stage * 2 + CAST(won AS INT)) AS m FROM g0 GROUP BY ALL), c AS (SELECT school, year, m // 2 AS stage, m % 2 = 1 AS won FROM b)
SELECT *, CASE WHEN stage = 8 THEN CASE WHEN won THEN '優勝' ELSE '準優勝' END WHEN stage = 7 THEN CASE WHEN won THEN '決勝進出' ELSE 'ベスト4' END WHEN stage = 6 THEN CASE WHEN won THEN 'ベスト4' ELSE 'ベスト8' END
  WHEN stage + CAST(won AS INT) = 1 THEN '一回戦出場' ELSE ['一回戦', '二回戦', '三回戦', '四回戦', '五回戦', '準々決勝'][stage + CAST(won AS INT)] || '進出' END AS label FROM c""",
)
def furthest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.furthest_stage(S.of(spark, sf_dir, _GAMES), ["school", "year"])


@query(
    "stage_order",
    f"""SELECT DISTINCT concat(CASE l_linenumber % 7 WHEN 0 THEN '準々決勝' WHEN 1 THEN '準決勝' WHEN 2 THEN '決勝' WHEN 3 THEN '2回戦' ELSE '４回戦' END, l_returnflag) AS stage,
  CASE l_linenumber % 7 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 WHEN 3 THEN 2 ELSE 4 END AS n FROM lineitem""",
)
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT DISTINCT concat(CASE l_linenumber % 7 WHEN 0 THEN '準々決勝' WHEN 1 THEN '準決勝' WHEN 2 THEN '決勝' WHEN 3 THEN '2回戦' ELSE '４回戦' END, l_returnflag) AS stage FROM {lineitem}"
    return S.of(spark, sf_dir, sql).select("stage", ranks.stage_order(F.col("stage")).alias("n"))


@query("first_wins_dedupe", "SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem")
    out = rollups.first_wins(rows, ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return out.select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_quantity")


_NAMES = "SELECT p_partkey AS seq, p_brand AS brand, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '部') WHEN 1 THEN concat(substr(p_name, 2), substr(p_name, 1, 1)) WHEN 2 THEN concat(p_name, '同好会') ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS category FROM {part}"


@query(
    "fuzzy_dedupe",
    f"""{S.ctes(n0=_NAMES)}, k AS (SELECT *, array_to_string(list_sort(string_split(regexp_replace(name, '(同好会|愛好会|クラブ|部|班)$', ''), '')), '') AS key, NOT regexp_matches(name, '(同好会|愛好会|クラブ|部|班)$') AS plain FROM n0)
SELECT brand, key, arg_min(name, seq + CASE WHEN plain THEN 1000000000 ELSE 0 END) AS name, arg_min(category, seq) FILTER (category IS NOT NULL) AS category, count(*) AS spellings FROM k GROUP BY brand, key""",
)
def fuzzy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.fuzzy_dedupe(S.of(spark, sf_dir, _NAMES), ["brand"], "name", "category", "seq")


_COURSES = "SELECT l_suppkey AS school, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, concat(p_type, '科') AS department, CASE WHEN l_linenumber = 3 THEN '-' ELSE concat(CAST(1 + l_linenumber AS STRING), ',', '000') END AS students, CASE WHEN l_returnflag = 'R' THEN '定時制' ELSE '全日制' END AS course FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@query(
    "master_rollup",
    f"""{S.ctes(c0=_COURSES)}, d AS (SELECT school, department, min(pos) AS first FROM c0 GROUP BY ALL), e AS (SELECT school, string_agg(department, '・' ORDER BY first, department) AS departments FROM d GROUP BY school)
SELECT school, departments, CAST(sum(TRY_CAST(replace(students, ',', '') AS BIGINT)) AS BIGINT) AS students, bool_or(course = '全日制') AS full_time, bool_or(course = '定時制') AS evening FROM c0 JOIN e USING (school) GROUP BY school, departments""",
)
def master_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.rollup_courses(S.of(spark, sf_dir, _COURSES), "school")


_RATIOS = "SELECT l_suppkey AS school, CAST(year(l_shipdate) AS INT) AS year, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_returnflag AS department, l_quantity / 32 AS ratio FROM {lineitem}"


@query(
    "ratio_avg_fallback",
    f"""{S.ctes(r0=_RATIOS)}, y AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY school, year ORDER BY department = 'N' DESC, CASE WHEN department = 'N' THEN -seq ELSE seq END, ratio) = 1)
SELECT school, round(avg(ratio), 2) AS ratio_avg, count(*) AS years, arg_max(ratio, year) AS ratio_last FROM y GROUP BY school""",
)
def ratio_avg_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.ratio_average(S.of(spark, sf_dir, _RATIOS), F.col("department") == "N")


@query("histogram", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.histogram(S.table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


@query("histogram_top", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def histogram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.histogram(S.table(spark, sf_dir, "part"), F.col("p_name"), 10)


@query("bucket_histogram", "SELECT CASE WHEN p_size <= 5 THEN '<=5' WHEN p_size <= 10 THEN '<=10' WHEN p_size <= 20 THEN '<=20' ELSE '>20' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.bucket_histogram(S.table(spark, sf_dir, "part"), F.col("p_size"), [5, 10, 20])


@query("latest_n_groups", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY y DESC LIMIT 2) GROUP BY 1")
def latest_n_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"))
    return rollups.latest_groups(rows, "y", 2).groupBy("y").agg(F.count("*").alias("n"))


@query("latest_n_within", "WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM d QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY day DESC) <= 2")
def latest_n_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return rollups.latest_groups(rows, "day", 2, ["o_custkey"]).groupBy("o_custkey", "day").agg(F.count("*").alias("n"))


@query("upsert_counter", "SELECT user_id, count(*) AS n, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS last FROM events GROUP BY user_id")
def upsert_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select("user_id", F.lit(1).cast("long").alias("n"), F.col("ts").alias("at"), F.col("event_type").alias("last"))
    half = F.col("at") < F.lit("2024-01-15").cast("timestamp")
    stored = rollups.upsert_counter(rows.where(half), rows.where(F.lit(False)), "user_id")
    return rollups.upsert_counter(stored, rows.where(~half), "user_id")


@query("dictionary_encode", "WITH w AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS number FROM (SELECT DISTINCT p_name FROM part)), g AS (SELECT DISTINCT p_brand, number FROM part JOIN w USING (p_name)) SELECT p_brand, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM g GROUP BY p_brand")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, coded = rollups.encode(S.table(spark, sf_dir, "part"), "p_brand", "p_name")
    return coded.select("p_brand", F.array_join("numbers", ",").alias("numbers"))


@query("spelling_counts", f"""{S.ctes(k0=S.CLUBS)} SELECT raw_name, count(DISTINCT school) AS holders, count(DISTINCT brand) AS kinds FROM k0 GROUP BY raw_name""")
def spelling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.spelling_counts(S.of(spark, sf_dir, S.CLUBS), "raw_name", "school", "brand")


@query("singletons", "SELECT p_name, p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1")
def singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["p_name", "p_brand", "p_type", "p_size"]
    return S.table(spark, sf_dir, "part").groupBy(*keys).agg(F.count_distinct("p_partkey").alias("n")).where("n = 1").select(*keys)


@query("mixed_kinds", "SELECT p_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.table(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))
    return found.where(F.size("kinds") > 1).select("p_name", F.array_join("kinds", ",").alias("kinds"))


@query("calibration_factor", "SELECT CAST(l_suppkey AS VARCHAR) AS line, round(least(1.0, (min(l_quantity / 30) + avg(l_quantity / 30)) / 2), 2) AS factor, count(*) AS n FROM lineitem GROUP BY 1")
def calibration_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("line"), (F.col("l_quantity") / 30).alias("ratio"), F.col("l_orderkey").cast("string").alias("evidence"))
    return rollups.calibration(rows, "line", "ratio", "evidence").select("line", "factor", F.size(F.split("evidence", " / ")).cast("long").alias("n"))


@query("tagged_union", "SELECT 'supplier' AS source, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: S.table(spark, sf_dir, n).select(F.col(f"{n[0]}_{'supp' if n == 'supplier' else 'cust'}key").alias("id"), F.col(f"{n[0]}_name").alias("name")) for n in ("supplier", "customer")}
    return quality.tagged_union(parts)


@query("union_defaults", "SELECT n_nationkey AS id, n_name AS name, NULL AS note FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 'extra' FROM region")
def union_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    extra = S.table(spark, sf_dir, "region").select((100 + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit("extra").alias("note"))
    return base.unionByName(extra, allowMissingColumns=True)


@query("incremental_replace", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey >= 5 UNION ALL SELECT s_suppkey, concat(s_name, '*') FROM supplier WHERE s_nationkey < 5")
def incremental_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "supplier")
    new = rows.where("s_nationkey < 5").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"))
    return graph.replace_keys(rows.select("s_suppkey", "s_name"), new, "s_suppkey")


@query("append_absent", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier WHERE s_suppkey + 1000 NOT IN (SELECT c_custkey FROM customer)")
def append_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = S.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"))
    return sinks.append_absent(existing, new, "id")


@query("nested_injection", "SELECT s_suppkey AS id, s_name AS name, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS most, count(*) FILTER (l_returnflag = 'R') > 0 AS has FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL")
def nested_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.struct(F.lit(1).alias("x")).alias("info"))
    values = S.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("id")).agg(F.max("l_quantity").alias("most"))
    return sinks.inject(base, values, "id", "info").select("id", "name", "info.most", F.col("info").isNotNull().alias("has"))


_LOAD = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' 12.7 ' WHEN 2 THEN 'x' WHEN 3 THEN '-3' ELSE '8e1' END AS raw FROM {customer}"


@query("typed_load", f"""{S.ctes(x0=_LOAD)} SELECT CAST(id AS VARCHAR) AS id, CASE raw WHEN ' 12.7 ' THEN 12 WHEN '-3' THEN -3 WHEN '8e1' THEN 80 END AS as_int, CASE raw WHEN ' 12.7 ' THEN 12.7 WHEN '-3' THEN -3.0 WHEN '8e1' THEN 80.0 END AS as_double, raw <> '' AS flag FROM x0""")
def typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.of(spark, sf_dir, _LOAD).select(F.col("id").cast("string").alias("id"), F.col("raw").alias("as_int"), F.col("raw").alias("as_double"), F.col("raw").alias("flag"))
    out = sinks.typed(raw, {"as_int": "int", "as_double": "double", "flag": "boolean"})
    return out


@query("valid_split", "SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size BETWEEN 10 AND 600 THEN 'size' END, CASE WHEN length(p_name) > 10 THEN 'name' END) AS reasons FROM part WHERE NOT (p_size BETWEEN 10 AND 600 AND length(p_name) <= 10)")
def valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = quality.split_valid(S.table(spark, sf_dir, "part"), {"size": F.col("p_size").between(10, 600), "name": F.length("p_name") <= 10})
    return bad.select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query("duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(S.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("reference_gaps", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = S.table(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("key"))
    return quality.orphans(S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), parent, "key")


@query("thin_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 5")
def thin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.thin(S.table(spark, sf_dir, "orders"), "o_custkey", 5)


#: Cells of results as they come, names of persons in some: attached and apart, and words that only look like them.
_CELLS = ("山田太郎さん", "田中くん", "鈴木選手", "選手権大会 優勝", "応援団と選手団", "山田 太郎選手", "王子総合高校", "作：佐藤", "三番 捕手", "新宿　総合", "若君太鼓", "優勝", "高校君が代斉唱", "本塁打 2", "作 佐藤")
_PERSONS = f"""
SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'attributed' WHEN 1 THEN 'baseball' WHEN 2 THEN 'drama' WHEN 3 THEN 'dance' WHEN 4 THEN 'art' WHEN 5 THEN 'athletics' ELSE 'other' END AS source,
  concat(c_name, CASE (c_custkey * 3 + c_nationkey) % {len(_CELLS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_CELLS))} END) AS school,
  CASE (c_custkey * 5 + c_nationkey) % {len(_CELLS) + 1} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_CELLS))} END AS rank,
  concat(c_mktsegment, CASE (c_custkey * 11 + c_nationkey) % {len(_CELLS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_CELLS))} END) AS line
FROM {{customer}}"""
#: The same checks without looking ahead: a word of a person, and then neither of two characters.
_PERSON_SQL = r"""CASE source WHEN 'baseball' THEN c <> 'line' AND (v LIKE '%さん%' OR v LIKE '%君%' OR v LIKE '%くん%' OR regexp_matches(v, '選手([^権団]|$)') OR v LIKE '%投手%' OR v LIKE '%捕手%' OR v LIKE '%本塁打%')
  WHEN 'drama' THEN c <> 'line' AND (v LIKE '%作：%' OR v LIKE '%さん%' OR v LIKE '%君%' OR v LIKE '%くん%')
  WHEN 'dance' THEN c = 'line' AND (v LIKE '%さん%' OR v LIKE '%くん%' OR regexp_matches(v, '[^校]君') OR regexp_matches(v, '選手([^権団]|$)') OR v LIKE '%作:%' OR v LIKE '%作：%')
  WHEN 'art' THEN c = 'school' AND regexp_matches(v, '[一-龥][ 　]+[一-龥]')
  WHEN 'athletics' THEN false ELSE regexp_matches(v, '(さん|君|くん|選手)([^権団]|$)') OR regexp_matches(v, '[一-龥][ 　][一-龥]{1,2}[ 　]*(さん|君|選手)') END"""


@query(
    "privacy_gate",
    f"""{S.ctes(p0=_PERSONS)}, c0 AS (SELECT id, source, 'school' AS c, school AS v FROM p0 UNION ALL SELECT id, source, 'rank', rank FROM p0 UNION ALL SELECT id, source, 'line', line FROM p0)
SELECT id, source, c AS "column", v AS value FROM c0 WHERE {_PERSON_SQL}""",
)
def privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.check_columns(S.of(spark, sf_dir, _PERSONS))
    return quality.person_cells_by_source(rows, "id", "source", ["school", "rank", "line"])


@query(
    "gated_release",
    f"""{S.ctes(p0=_PERSONS)}, c0 AS (SELECT 'results' AS part, 'school' AS c, school AS v, 'other' AS source FROM p0 UNION ALL SELECT 'results', 'rank', rank, 'other' FROM p0 UNION ALL SELECT 'results', 'line', line, 'other' FROM p0),
n AS (SELECT c, count(*) AS n FROM c0 WHERE {_PERSON_SQL} GROUP BY c)
SELECT 'results' AS release, c AS what, n, false AS committed FROM n UNION ALL SELECT 'results', 'rows', count(*), false FROM p0
UNION ALL SELECT 'orders', 'rows', count(*), true FROM orders UNION ALL SELECT 'orders', 'read back', count(*), true FROM orders""",
)
def gated_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases: one that names persons, which is counted and not committed, and one that is."""
    root = shared_folder(spark, "release")
    rows = S.of(spark, sf_dir, _PERSONS)
    told: list[tuple[str, str, int, bool]] = []
    results, orders = snapshots.Store(spark, f"{root}/results"), snapshots.Store(spark, f"{root}/orders")
    try:
        results.publish({"results": rows}, checks={"results": quality.PERSON_RULES["attributed"].broken(["school", "rank", "line"])})
    except snapshots.GateError:
        told += [("results", what, n, results.current() is not None) for what, n in results.counts["results"].items()]
    orders.publish({"orders": S.table(spark, sf_dir, "orders")}, checks={"orders": {"no key": F.col("o_orderkey").isNull(), "negative": F.col("o_totalprice") < 0}})
    told += [("orders", what, n, orders.current() is not None) for what, n in orders.counts["orders"].items()]
    back = orders.read("orders").agg(F.lit("orders").alias("release"), F.lit("read back").alias("what"), F.count("*").alias("n"), F.lit(True).alias("committed"))
    return spark.createDataFrame(told, "release string, what string, n long, committed boolean").unionByName(back)


@query("allow_list", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = S.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return S.table(spark, sf_dir, "customer").join(master, "c_nationkey", "left_semi").select("c_custkey")


@query("name_lookup_strict", "SELECT s_suppkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def name_lookup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("n_name"))
    return joins.strict_lookup(rows, S.table(spark, sf_dir, "nation"), "n_name").select("s_suppkey", "n_name", "n_regionkey")


@query("unmatched_names", "SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT DISTINCT p_name FROM part WHERE p_size > 48)")
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    return joins.unmatched(part, part.where("p_size > 48").select("p_name").distinct(), "p_name")


@query("dict_normalise", "SELECT p_partkey, CASE WHEN p_name LIKE '%gizmo' THEN replace(p_name, 'gizmo', 'gear') WHEN p_name LIKE 'old %' THEN 'old' ELSE p_name END AS normal FROM part")
def dict_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    names = part.select("p_name").distinct()
    changed = F.when(F.col("p_name").endswith("gizmo"), F.replace("p_name", F.lit("gizmo"), F.lit("gear"))).when(F.col("p_name").startswith("old "), "old")
    dictionary = names.select("p_name", changed.alias("normal")).where("normal is not null")
    return joins.normalise(part, dictionary, "p_name", "normal").select("p_partkey", "normal")


@query("lookup_chain", "SELECT s_suppkey, n_name, r_name, coalesce(q, 0) AS q FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = S.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    out = S.table(spark, sf_dir, "supplier").join(S.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    out = out.join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(totals, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", "n_name", "r_name", F.coalesce("q", F.lit(0)).alias("q"))


@query("semi_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = S.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("id_conflicts", "SELECT p_name, a, b FROM (SELECT p_name, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY p_name) WHERE a <> b")
def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    return joins.id_conflicts(part.groupBy("p_name").agg(F.min("p_partkey").alias("a")), part.groupBy("p_name").agg(F.max("p_partkey").alias("b")), "p_name", "a", "b")


@query("sort_missing_last", "SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, 0) DESC, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice ELSE -1 END, o_orderkey) AS pos FROM orders")
def sort_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    band = F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")), F.lit(0))
    ratio = F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")), F.lit(-1.0))
    rows = orders.select("o_orderkey", band.alias("band"), ratio.alias("ratio"))
    return rollups.positions(rows, F.col("band").desc(), "ratio", "o_orderkey").select("o_orderkey", "pos")


@query(
    "insert_statements",
    """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos, '(' || c_custkey || ', ' || chr(39) || replace(c_name || chr(39) || 's', chr(39), chr(39) || chr(39)) || chr(39) || ', ' || CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR) END || ')' AS t FROM customer)
SELECT CAST((pos - 1) // 250 AS BIGINT) AS chunk, 'INSERT INTO customer (id, name, nation) VALUES' || chr(10) || '  ' || string_agg(t, ',' || chr(10) || '  ' ORDER BY pos) || ';' AS statement FROM p GROUP BY 1""",
)
def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("'s")).alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("nation"))
    return sinks.insert_statements(rows, "customer", {"id": False, "name": True, "nation": False}, ["id"], 250)


@query("positional_zip", "SELECT o_orderkey, n_name AS name, CAST(o_orderkey % 100 + n_nationkey AS BIGINT) AS value FROM orders, nation WHERE n_nationkey < 4")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", F.array(*((F.col("o_orderkey") % 100 + k).cast("long") for k in range(4))).alias("values"))
    names = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    return sequences.positional(rows, ["o_orderkey"], "values", names)


@query("subject_filter", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 OR p_size % 2 = 0")
def subject_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("sport"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ").alias("event"))
    return quality.with_subject(rows, "sport", "event").select("p_partkey")


@query("csv_round_trip", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'a, \"' || s_nationkey || '\"' AS note FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text, written and read again."""
    path = shared_folder(spark, "csv")
    rows = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit('a, "'), F.col("s_nationkey").cast("string"), F.lit('"')).alias("note"))
    sinks.write_csv(rows, path, ["id", "name", "note"])
    return readers.read_csv(spark, path)


@query("json_round_trip", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance FROM customer")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped JSON lines, written and read again."""
    path = shared_folder(spark, "json")
    rows = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"))
    sinks.write_json_gz(rows, path)
    return readers.read_json_gz(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("sitemap_slugs", "SELECT DISTINCT 'nation-' || n_name AS slug FROM nation")
def sitemap_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "sitemap")
    nation = S.table(spark, sf_dir, "nation")
    nation.select(F.concat(F.lit("<url><loc>https://h.example/s/nation-"), "n_name", F.lit("/</loc></url>"))).write.text(path)
    return readers.read_sitemap(spark, path)


@query("extremes", "(SELECT 'near' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL (SELECT 'far', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    near = rows.orderBy("c_acctbal", "c_custkey").limit(5).withColumn("side", F.lit("near"))
    return near.unionByName(rows.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).withColumn("side", F.lit("far")))


@query("distinct_keys", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@query("group_to_list", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def group_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return listed.select("o_custkey", F.array_join("l", ",").alias("orders"))


@query("unpivot_ranks", "UNPIVOT (SELECT o_orderkey, o_orderstatus AS first, substr(o_orderpriority, 3) AS second, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS third FROM orders) ON first, second, third INTO NAME place VALUE who")
def unpivot_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("first"), F.substring("o_orderpriority", F.lit(3), F.length("o_orderpriority")).alias("second"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("third"))
    return wide.unpivot(["o_orderkey"], ["first", "second", "third"], "place", "who").where("who is not null")


@query(
    "param_grid",
    "SELECT year, flag, r_name AS region FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders), (SELECT DISTINCT l_returnflag AS flag FROM lineitem), (SELECT DISTINCT r_name FROM region)",
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, kinds and regions that the tables have, each with each."""
    years = S.table(spark, sf_dir, "orders").select(F.year("o_orderdate"))
    return readers.grid_of(year=years, flag=S.table(spark, sf_dir, "lineitem").select("l_returnflag"), region=S.table(spark, sf_dir, "region").select("r_name"))


@query(
    "report_lines",
    """WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), l AS (SELECT row_number() OVER (ORDER BY p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size END NULLS FIRST, n) + 4 AS pos, '| ' || p_brand || ' \\| x | ' || CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END || ' | ' || n || ' |' AS line FROM g)
SELECT pos, line FROM l UNION ALL SELECT * FROM (VALUES (0, '# Parts'), (1, 'by brand'), (2, ''), (3, '| brand | size | n |'), (4, '| --- | --- | --- |')) v(pos, line)""",
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as the lines of a report, bars in cells escaped, cells without a value empty."""
    counts = S.table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    cells = counts.select(F.concat("p_brand", F.lit(" |\n x")).alias("brand"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"), "n")
    return sinks.report(cells, "Parts", ["brand", "size", "n"], summary="by brand")


@query(
    "structure_drift",
    """WITH x AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS cells, html FROM pages)
SELECT page_id, 'header of menu' AS problem FROM x WHERE len(cells) < 2 OR cells[1] <> 'the' OR cells[2] <> 'and' UNION ALL SELECT page_id, 'no article' FROM x WHERE NOT contains(html, '<article>')
UNION ALL SELECT page_id, 'no notice' FROM x WHERE NOT contains(html, 'icen')""",
)
def structure_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose menu doesn't begin as it should, or that lack what all had."""
    cells = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), 1)
    markers = {"article": (F.col("html"), "<article>"), "notice": (F.col("html"), "icen")}
    return quality.drift(S.table(spark, sf_dir, "pages"), "page_id", headers={"menu": (cells, ["the", "and"])}, markers=markers)


@query(
    "fiscal_year",
    """WITH x AS (SELECT o_orderkey, o_orderdate, CASE WHEN month(o_orderdate) <= 3 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS f FROM orders)
SELECT o_orderkey, f AS fiscal, f - 2018 AS era, '令和' || CASE WHEN f + 25 - 2018 = 1 THEN '元' ELSE CAST(f + 25 - 2018 AS VARCHAR) END || '年度' AS text, f + 25 - 2018 AS parsed, strftime(o_orderdate, '%Y-%m-%dT%H') AS hour, f - 1960 - 63 + 5 AS edition FROM x""",
)
def fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = dates.fiscal_year(F.col("o_orderdate"))
    said = dates.era_text(year + 25)
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey", year.cast("long").alias("fiscal"), dates.era_year(F.col("o_orderdate")).cast("long").alias("era"), said.alias("text"), dates.era_number(said).cast("long").alias("parsed"),
        dates.hour(F.col("o_orderdate")).alias("hour"), dates.edition_year(year - 1960, 63, 5).cast("long").alias("edition"),
    )


@query(
    "reconcile_conflicts",
    f"""{S.ctes(a0=S.RESULTS)},
o AS (SELECT school AS entity, year, substr(meet, 1, 2) AS m, [CAST(part % 7 AS VARCHAR), CAST(part % 5 AS VARCHAR)] AS sports, rank FROM a0 WHERE official AND line_no = 1),
p AS (SELECT seq, school AS entity, year, substr(meet, 1, 2) AS m, [CAST(part % 7 AS VARCHAR), 'x'] AS sports, rank FROM a0 WHERE NOT official AND line_no = 2),
j AS (SELECT seq, o.rank AS orank, p.rank AS prank, len(list_intersect(p.sports, o.sports)) > 0 AS same FROM p LEFT JOIN o USING (entity, year, m))
SELECT seq AS report_id, count(orank) AS n_official, CASE WHEN count(orank) = 0 THEN 'B' WHEN bool_or(same AND orank = prank) THEN 'A' WHEN bool_or(same) THEN 'C' ELSE 'D' END AS class,
  coalesce(string_agg(DISTINCT CASE WHEN same THEN orank END, ',' ORDER BY CASE WHEN same THEN orank END), '') AS official FROM j GROUP BY seq""",
)
def reconcile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumnRenamed("school", "entity")

    def key(n: int) -> Column:
        return (F.col("part") % n).cast("string")

    official = rows.where("official and line_no = 1").withColumn("sports", F.array(key(7), key(5)))
    reported = rows.where("not official and line_no = 2").select(F.col("seq").alias("report_id"), "entity", "year", "meet", "rank", F.array(key(7), F.lit("x")).alias("sports"))
    return joins.reconcile(official, reported)


@query("band_of_designation", f"""{S.ctes(s0=S.SCHOOLS)} SELECT school, CASE school % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 END AS band, CASE school % 3 WHEN 0 THEN '3位' WHEN 1 THEN '準優勝' END AS plain, CASE WHEN school % 2 = 0 THEN '卓球,柔道' ELSE '' END AS sports FROM s0""")
def band_of_designation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, ("進学指導重点校", "進学指導特別推進校", "進学指導推進校", ""))), (F.col("school") % 4 + 1).cast("int"))
    said = F.when(F.col("school") % 3 == 0, "大会で第 3 位").when(F.col("school") % 3 == 1, "準優勝した").otherwise("出場")
    sports = F.when(F.col("school") % 2 == 0, "柔道部と卓球部、柔道").otherwise("書道")
    return S.of(spark, sf_dir, S.SCHOOLS).select("school", ranks.band(named).alias("band"), ranks.plain_rank(said).alias("plain"), F.array_join(ranks.sports(sports), ",").alias("sports"))


@query("display_label", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN CASE WHEN length(split_part(p_name, ' ', 1) || p_name) <= 16 THEN split_part(p_name, ' ', 1) || p_name ELSE split_part(p_name, ' ', 1) END WHEN length(p_type || p_name) <= 16 THEN p_type || p_name ELSE p_type END AS label FROM part")
def display_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    sport = F.when(F.col("p_partkey") % 3 == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_type"))
    return S.table(spark, sf_dir, "part").select("p_partkey", text.label(sport, event).alias("label"))
