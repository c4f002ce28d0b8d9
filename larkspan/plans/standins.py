"""The roles of the domain played by the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

REQUESTS = """
SELECT c_custkey AS req_id, CAST(c_custkey AS STRING) AS station, CAST(10 + c_custkey % 40 AS INT) AS commute_limit, FALSE AS no_commute_limit,
  CAST(NULL AS INT) AS naishin, CAST(5 + c_custkey % 21 AS INT) AS naishin5, CAST(4 + c_custkey % 17 AS INT) AS jitsugi, CAST(NULL AS INT) AS sonai,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 501 AS INT) END AS toujitsu,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 25 AS INT) END AS esat,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'commute' WHEN 'BUILDING' THEN 'reachable' WHEN 'FURNITURE' THEN 'club' WHEN 'MACHINERY' THEN 'academic' END AS priority,
  c_custkey % 2 = 0 AS academic, CASE WHEN c_custkey % 5 = 0 THEN '工' END AS dept,
  CASE WHEN c_custkey % 7 = 0 THEN '定時制' WHEN c_custkey % 11 = 0 THEN '高専' END AS course
FROM {customer}"""

SCHOOLS = """
SELECT s_suppkey AS school, s_name AS name, CAST(NULL AS STRING) AS kana, n_name AS ward, CASE WHEN s_suppkey % 3 = 0 THEN r_name END AS designation,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(470 + (s_suppkey * 37) % 451 AS INT) END AS target_score,
  CASE WHEN s_suppkey % 29 = 0 THEN 'no_exam' ELSE 'std' END AS selection_type, s_suppkey % 23 = 0 AS no_admission,
  CASE s_suppkey % 6 WHEN 0 THEN '全日制・定時制' WHEN 1 THEN '定時制' WHEN 2 THEN '高専' ELSE '全日制' END AS courses,
  CASE s_suppkey % 3 WHEN 0 THEN '普・工' WHEN 1 THEN '普' ELSE '工・商' END AS departments
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

COMMUTE = """
SELECT CAST(o_custkey AS STRING) AS station, l_suppkey AS school, CAST(min(l_quantity) AS INT) AS minutes,
  CASE WHEN min(l_partkey) % 11 <> 0 THEN CAST(min(l_quantity * 100000000 + l_partkey) AS BIGINT) % 100000000 END AS via, CASE min(l_partkey) % 5 WHEN 0 THEN 'bus' WHEN 1 THEN NULL ELSE 'walk' END AS access_mode
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey"""

CLUBS = """
SELECT DISTINCT l_suppkey AS school, p_name AS raw_name, replace(p_name, 'gizmo', 'gear') AS normalized, p_brand AS brand
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

STATS = """
SELECT l_suppkey AS school, CAST(year(l_shipdate) AS INT) AS year, l_returnflag AS department, CAST(sum(l_quantity) AS BIGINT) AS capacity, count(*) AS applicants
FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), l_returnflag"""

#: Results of contests: official ones, self-reported ones, with rank words.
RESULTS = """
SELECT l_suppkey AS school, l_returnflag AS division, CAST(year(o_orderdate) AS INT) AS year,
  CASE o_orderstatus WHEN 'P' THEN '全国大会' WHEN 'F' THEN '関東大会' ELSE '東京都大会' END AS meet,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '優勝' WHEN '2' THEN '準優勝' WHEN '3' THEN concat(CAST(1 + l_linenumber * 3 AS STRING), '位')
    WHEN '4' THEN concat('ベスト', CAST(4 + l_linenumber AS STRING)) ELSE concat(CAST(l_linenumber AS STRING), '回戦') END AS rank,
  l_linestatus = 'O' AS official, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, l_linenumber AS line_no, l_partkey AS part
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

#: Lines of stations: one line per region, and one per five neighbouring numbers, so that every station is on two.
STOPS = """
SELECT concat('R', CAST(n_regionkey AS STRING)) AS line, n_nationkey AS pos, n_name AS station, CAST(n_nationkey * 7 % 25 AS DOUBLE) * 0.01 + 35 AS lat, CAST(n_nationkey * 11 % 25 AS DOUBLE) * 0.01 + 139 AS lon FROM {nation}
UNION ALL
SELECT concat('B', CAST(floor(n_nationkey / 5) AS INT)) AS line, n_nationkey AS pos, n_name AS station, CAST(n_nationkey * 7 % 25 AS DOUBLE) * 0.01 + 35 AS lat, CAST(n_nationkey * 11 % 25 AS DOUBLE) * 0.01 + 139 AS lon FROM {nation}"""

#: Utterances with numbers in them, made of a conversation's key and turn.
UTTERANCES = """
SELECT conv_id AS session, turn,
  concat(CASE (conv_id + turn) % 9
    WHEN 0 THEN concat('渋谷駅から', CAST(20 + (conv_id * 3 + turn) % 60 AS STRING), '分以内で探しています')
    WHEN 1 THEN concat('5教科は', CAST((conv_id + turn * 5) % 30 AS STRING), '、実技は', CAST((conv_id + turn) % 22 AS STRING), 'です')
    WHEN 2 THEN concat('当日は', CAST((conv_id * 7 + turn) % 520 AS STRING), '点くらいです')
    WHEN 3 THEN 'サッカー部とプログラミングがやりたいです'
    WHEN 4 THEN '近いところがいちばん大事です。工業系がいい'
    WHEN 5 THEN concat('内申は', CAST((conv_id + turn) % 50 AS STRING), 'です。大学進学を重視したい')
    WHEN 6 THEN 'まだ決めてないです。わかりません'
    WHEN 7 THEN '練馬のあたりに住んでいます。定時制も見たい'
    ELSE concat('通学は', CAST((conv_id + turn * 11) % 200 AS STRING), '分まで。吹奏楽部がある普通科') END, '') AS text
FROM {conversations}"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The stand-in as a DataFrame."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql})


def duck(sql: str) -> str:
    """The stand-in as DuckDB's SQL."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def ctes(**named: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({duck(v)})" for k, v in named.items())


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries, their SQL, and the decorator that registers both."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query
