"""Sources and sinks, written out of the stand-ins and read again, and table functions over lines made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import extraction
from larkspan.plans import standins as S
from larkspan.session import shared_folder
from larkspan.sources import files, readers, sinks, snapshots

QUERIES, ORACLES, query = S.registry()


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _pick(key: str, *values: str) -> Column:
    """One of the values, by the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@query("station_lines", "SELECT r_regionkey AS line, r_name AS line_name, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INT) AS pos, n_name AS station, n_nationkey % 7 <> 3 AS open FROM nation JOIN region ON n_regionkey = r_regionkey QUALIFY open")
def station_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of lines with their stops, of which closed ones don't count."""
    path = shared_folder(spark, "lines")
    stop = F.struct(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lit(35.5).alias("lat"), F.lit(139.5).alias("lng"), (F.col("n_nationkey") % 7 == 3).alias("closed"))
    named = S.table(spark, sf_dir, "nation").join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = named.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(stop)).alias("station_list"))
    each = F.struct(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"), "station_list")
    lines.agg(F.to_json(F.collect_list(each)).alias("value")).write.text(path)
    return readers.read_lines(spark, path).select("line", "line_name", "pos", "station", F.lit(True).alias("open"))


@query("key_urls", "SELECT 'n' || n_nationkey AS key, 'https://h.example/' || n_name AS url FROM nation")
def key_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "urls")
    lines = F.array(F.lit("# sources"), F.lit(""), F.concat(F.lit("  n"), _text("n_nationkey"), F.lit("\t https://h.example/"), F.regexp_replace("n_name", " ", "%20")))
    S.table(spark, sf_dir, "nation").select(F.explode(lines)).write.text(path)
    return readers.read_key_urls(spark, path).select("key", F.regexp_replace("url", "%20", " ").alias("url"))


@query("decoded_bytes", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '<meta charset=\"Shift_JIS\">写真部' ELSE '写真部' END AS text FROM supplier")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared, UTF-8 and undeclared legacy bytes."""
    legacy = F.unhex(F.lit("写真部".encode("cp932").hex()))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.encode(F.lit('<meta charset="Shift_JIS">'), "utf-8"), legacy)).when(F.col("s_suppkey") % 3 == 1, legacy).otherwise(F.encode(F.lit("写真部"), "utf-8"))
    return S.table(spark, sf_dir, "supplier").select("s_suppkey", readers.decoded(raw).alias("text"))


@query("table_lookup", "SELECT c_custkey, c_name, TRUE AS found, FALSE AS other FROM customer WHERE c_custkey = 7")
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row by its key, and probes for two keys."""
    customer = S.table(spark, sf_dir, "customer")
    probes = [F.lit(readers.exists(customer, c_custkey=k)).alias(n) for k, n in ((7, "found"), (-1, "other"))]
    return readers.lookup(customer, c_custkey=7).select("c_custkey", "c_name", *probes)


@query("key_value_store", "SELECT 'n7' AS key, n_name || '!' AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def key_value_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put with a time to live over older ones, and one read by its key."""

    def pairs(name: Column) -> DataFrame:
        return S.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("key"), F.to_json(F.struct(name.alias("name"), F.col("n_regionkey").alias("region"))).alias("value"))

    stale = pairs(F.col("n_name")).withColumn("expires_at", F.lit("2001-01-01").cast("timestamp"))
    live = sinks.put(stale, pairs(F.concat("n_name", F.lit("!"))), "1 HOUR")
    return readers.key_value(live, "n7", "name string, region long").select("key", "value.name", "value.region")


@query("refreshed_tables", "SELECT r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def refreshed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children switched together, twice, and joined from the newest version."""
    store = snapshots.Store(spark, shared_folder(spark, "refresh"))
    for _ in range(2):
        store.publish({n: S.table(spark, sf_dir, n) for n in ("region", "nation")}, checks={"nation": {"no region": F.col("n_regionkey").isNull()}})
    region, nation = store.read("region"), store.read("nation")
    return region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"))


@query("workbook_sheets", "SELECT p_brand AS sheet, p_partkey AS id, p_name || ' <&> 学校' AS name, p_size AS size FROM part WHERE p_brand <> 'Brand#11'")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as workbooks with a sheet for each brand, read sheet by sheet, without those of one brand."""
    files.register(spark)
    path = shared_folder(spark, "workbooks")
    rows = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" <&> 学校")).alias("name"), F.col("p_size").alias("size"))
    rows.repartition("sheet").sortWithinPartitions("sheet", "id").write.format("workbook").mode("append").save(path)
    cells = spark.read.format("workbook").load(path).where("sheet <> 'Brand#11' AND row_no > 1")
    return cells.select("sheet", F.col("cells")["A"].cast("long").alias("id"), F.col("cells")["B"].alias("name"), F.col("cells")["C"].cast(rows.schema["size"].dataType).alias("size"))


@query(
    "zipped_points",
    "SELECT 'n' || c_nationkey || '.geojson' AS member, c_name AS name, CAST(c_custkey % 360 AS DOUBLE) / 2 AS lon, CAST(c_custkey % 180 AS DOUBLE) / 4 AS lat FROM customer WHERE c_nationkey < 10",
)
def zipped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, one GeoJSON file for each nation, in archives."""
    files.register(spark)
    path = shared_folder(spark, "points")
    key = F.col("c_custkey")
    rows = S.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".geojson")).alias("member"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("none"), F.lit(None).cast("string")).alias("properties"),
        ((key % 360).cast("double") / 2).alias("lon"), ((key % 180).cast("double") / 4).alias("lat"),
    )
    rows.repartition("member").sortWithinPartitions("member").write.format("zipped_points").mode("append").save(path)
    wanted = [f"n{k}.geojson" for k in range(10)]
    return spark.read.format("zipped_points").load(path).where(F.col("member").isin(wanted)).select("member", F.col("properties")["name"].alias("name"), "lon", "lat")


@query("legacy_text", "SELECT CAST(s_suppkey AS VARCHAR) AS number, '都立「' || s_name || '」' AS name, CAST(NULL AS VARCHAR) AS ward FROM supplier")
def legacy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.register(spark)
    path = shared_folder(spark, "legacy")
    rows = S.table(spark, sf_dir, "supplier").select(F.lit("x,y").alias("other"), F.concat(F.lit("都立「"), "s_name", F.lit("」")).alias("name"), _text("s_suppkey").alias("number"))
    rows.write.format("legacy_csv").option("encoding", "cp932").mode("append").save(path)
    return spark.read.format("legacy_csv").option("encoding", "cp932").schema("number string, name string, ward string").load(path)


@query("site_files", "SELECT CAST(s_suppkey AS VARCHAR) AS number, 'k' || s_nationkey || '-h' AS slug, '<p>写真部 ' || s_name || '</p>' AS html FROM supplier")
def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a supplier in a file of its own, in one of three charsets, which the reader finds out."""
    files.register(spark)
    path = shared_folder(spark, "site")
    html = F.concat(F.lit("<p>写真部 "), "s_name", F.lit("</p>"))
    encode = F.pandas_udf(lambda x, k: pd.Series([v.encode(("utf-8", "cp932", "euc-jp")[i % 3]) for v, i in zip(x, k, strict=True)]), "binary")
    name = F.concat(_text("s_suppkey"), F.lit("_k"), _text("s_nationkey"), F.lit("-h.html"))
    S.table(spark, sf_dir, "supplier").select(name.alias("name"), encode(html, F.col("s_suppkey")).alias("content")).write.format("named_files").mode("append").save(path)
    return readers.read_html(spark, path)


@query("extracted_pages", "SELECT CAST(p_partkey AS VARCHAR) AS file, 1 AS page, CAST(n AS INT) AS line_no, CASE n WHEN 0 THEN p_name ELSE p_type END AS text FROM part, range(2) AS r(n)")
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "pages")
    S.table(spark, sf_dir, "part").select(_text("p_partkey").alias("file"), F.lit(1).alias("page"), F.concat_ws("\n", "p_name", "p_type").alias("text")).write.parquet(path)
    return readers.read_pdf_text(spark, path)


@query("extracted_cells", "SELECT CAST(p_partkey AS VARCHAR) AS file, 1 AS table_no, p_size AS row_no, p_name || '|' || p_brand AS cells FROM part")
def extracted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "cells")
    S.table(spark, sf_dir, "part").select(_text("p_partkey").alias("file"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.col("p_size").cast("int").alias("row_no"), F.array("p_name", "p_brand").alias("cells")).write.parquet(path)
    return readers.read_pdf_cells(spark, path).select("file", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query("robots_rules", "SELECT o_orderkey, o_orderkey % 4 IN (1, 3) AS blocked FROM orders")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = [F.struct(F.lit(a).alias("allow"), F.lit(p).alias("prefix")) for a, p in ((False, "/a/"), (True, "/a/open"), (False, "/a/open/not"), (False, ""))]
    path = _pick("o_orderkey", "/b/x", "/a/x", "/a/open/x", "/a/open/not/x")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", readers.is_blocked(path, F.array(*rule)).alias("blocked"))


@query(
    "applicant_tables",
    """WITH x AS (SELECT s_suppkey AS file, s_suppkey % 4 AS k, 'K' || chr(CAST(65 + s_suppkey % 26 AS INT)) AS name, 100 + s_suppkey % 200 AS capacity, 200 + s_suppkey % 300 AS wanted FROM supplier),
r(kinds, page, department, name, capacity, wanted, ratio) AS (VALUES
  ([0], 1, '普通科', '', 0, 0, 1.58), ([1], 1, '普通科', '-', 50, 0, 1.10), ([2], 1, '普通科', '', 0, 0, 1.58), ([0], 1, '農業科', '園芸科', 35, 30, 0.86), ([1, 2], 1, '農業科', '-', 20, 30, 0.86), ([0, 1, 2], 2, '農業科', '会計', 40, 50, 1.25))
SELECT file, page, department, CASE r.name WHEN '' THEN x.name WHEN '-' THEN '' ELSE r.name END AS name, CAST(CASE WHEN r.capacity = 0 THEN x.capacity ELSE r.capacity END AS INT) AS capacity,
  CAST(CASE WHEN r.wanted = 0 THEN x.wanted ELSE r.wanted END AS INT) AS applicants, CAST(ratio AS DOUBLE) AS ratio FROM x JOIN r ON list_contains(kinds, k)""",
)
def applicant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files whose heading tells boys and girls, which has layouts of nine and five numbers, of files that only have them, of files of three numbers, and summaries."""
    k, name = F.col("s_suppkey") % 4, F.concat(F.lit("K"), F.char(65 + F.col("s_suppkey") % 26))
    capacity, wanted = (100 + F.col("s_suppkey") % 200).cast("string"), (200 + F.col("s_suppkey") % 300).cast("string")
    head = F.when(k == 0, "男　女 計 ").when(k == 3, "令和 総括表 ").otherwise("応募状況 ")
    nine = F.concat(name, F.lit(" 50 50 "), capacity, F.lit(" 99 50 "), wanted, F.lit(" 1.10 1.20 1.58"))
    main = F.when(k < 2, nine).otherwise(F.concat(name, F.lit("（注） "), capacity, F.lit(" "), wanted, F.lit(" 1.58")))
    first = F.concat(head, F.lit("1［普通科］ "), main, F.lit(" 計 500 900 1.80 某校 900 950 1.06 訂正 20 30 1.50 誤記でしました 20 30 1.50 2［農業科］ 園芸科 35 10 20 30 0.86"))
    pages = F.array(F.struct(F.lit(1).alias("page"), first.alias("text")), F.struct(F.lit(2).alias("page"), F.lit("会計 ４０ 50 1.25").alias("text")))
    files = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(pages).alias("p")).select("file", "p.*")
    return extraction.applicants(files, ["file", "page"]).select("file", "page", "department", "name", "capacity", "applicants", "ratio")


@query(
    "result_cells",
    """SELECT s_suppkey AS tbl, '卓球' AS sport, '' AS event, '男' AS division, '1位' AS rank, 'K' || s_suppkey AS text FROM supplier UNION ALL SELECT s_suppkey, '卓球', '', '女', '3位', 'L' || s_suppkey FROM supplier
UNION ALL SELECT s_suppkey, '陸上競技', '100m', '男', '3位', 'K' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, '陸上競技', '200m', '女', '優勝', 'L' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, '陸上競技', '100m', '男', '12位', 'M' FROM supplier""",
)
def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of teams and one of persons, whose columns are not read."""
    key = _text("s_suppkey")

    def table(*rows: tuple) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("row_no"), F.array(*(F.lit(c) if isinstance(c, str) else c for c in row)).alias("cells")) for i, row in enumerate(rows)]
        return S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tbl"), F.explode(F.array(*cells)).alias("r")).select("tbl", "r.*")

    k, ell = F.concat(F.lit("K"), key), F.concat(F.lit("L"), key)
    team = table(("", "種目", "", "１位", "２位", "３位", "４位"), ("", "卓球", "男", k, "", "", ""), ("", "", "女", "", "", ell, ""))
    solo = table(
        ("種目", "選手名", "学校名", "成績", "種目", "選手名", "学校名", "成績"), ("1.2.陸上競技", "", "", "", "", "", "", ""), ("100m", "某", k, "3位", "200m", "某", ell, "優勝"), ("", "某", "M", "12 位", "", "", "", "")
    )
    teams = extraction.team_table(team, ["tbl"]).select("tbl", F.coalesce("sport", F.lit("")).alias("sport"), F.lit("").alias("event"), "division", "rank", "text")
    return teams.unionByName(extraction.individual_table(solo, ["tbl"]).select("tbl", "sport", "event", "division", "rank", "text"))


@query(
    "game_sides",
    """WITH x AS (SELECT s_suppkey AS page_id, s_suppkey % 5 AS a, s_suppkey % 3 + 5 AS b FROM supplier)
SELECT page_id, '東東京大会 2024' AS meet, 2 AS stage, school, school = '日比谷' AS won FROM x, (VALUES ('立川国際'), ('府中'), ('日比谷')) AS v(school)""",
)
def game_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game a page, of a joint team and another; every school of a side has its result."""
    home, away = (F.col("s_suppkey") % 5).cast("string"), (F.col("s_suppkey") % 3 + 5).cast("string")
    html = F.concat(
        F.lit('<li>東東京大会 2024</li><table class="score_table"><td class="senko_name">立川国際・府中</td><td class="gokei">計</td><td class="gokei">'), home,
        F.lit('</td><td class="koko_name">日比谷</td><td class="gokei x">'), away, F.lit("&nbsp;</td></table>【２回戦】"),
    )
    found = extraction.games(S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")))
    return extraction.team_games(found).select("page_id", "meet", "stage", "school", "won")


@query(
    "dance_lists",
    """SELECT 'K' || s_suppkey AS name, '2024' AS year, '東京都大会' AS meet, CASE s_suppkey % 2 WHEN 0 THEN '優勝' ELSE '都大会出場' END AS rank FROM supplier
UNION ALL SELECT 'K' || s_suppkey, '2024', '全国決勝大会', (s_suppkey % 6 + 3) || '位' FROM supplier""",
)
def dance_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    school = F.concat(F.lit("東京都 東京都立K"), _text("s_suppkey"), F.lit("高等学校"))
    entered = F.struct(F.lit("syutsujou_tokyo").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("1 優勝 "), school)).otherwise(school).alias("line"))
    scored = F.struct(F.lit("tokuten_final").alias("kind"), F.concat((F.col("s_suppkey") % 6 + 3).cast("string"), F.lit(" 4 "), school, F.lit(" 37")).alias("line"))
    final = F.struct(F.lit("syutsujou_kessyou").alias("kind"), school.alias("line"))
    rows = S.table(spark, sf_dir, "supplier").select(F.lit("2024").alias("year"), F.explode(F.array(entered, scored, final)).alias("x")).select("year", "x.*")
    return extraction.dance_results(rows).select("name", "year", "meet", "rank")


_LONG = "本校は自主自律の精神を重んじ、生徒一人一人の個性を伸ばす教育を行い、伝統ある行事を大切にしています。"
#: Lines that could be a description, and whether they are one.
_SAID = (
    (_LONG, True), ("私は" + _LONG, False), ("トップ > 学校案内 > " + _LONG, False), ("教育課程" + _LONG, False), ("年間授業計画の概要、" + _LONG, False), ("災害時の対応と" + _LONG, False),
    ("本校には奨学金があり、" + _LONG, True), ("奨学金のある" + _LONG, False), ("グランドデザインに沿い" + _LONG, True), (_LONG + "グランドデザイン", False), ("資料 (1.2 MB) " + _LONG, False), ("１２【" + _LONG, False),
)


@query(
    "school_mottos",
    f"SELECT p_partkey AS id, '１ 自主自律の人間を育てる ／ 心身を鍛え、健やかに' AS motto, CASE p_partkey % {len(_SAID)} {' '.join(f"WHEN {i} THEN '{x if good else ''}'" for i, (x, good) in enumerate(_SAID))} END AS spirit FROM part",
)
def school_mottos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines after the first are the motto; a description counts, an address of one's own voice, a crumb or a heading of another page doesn't."""
    last = F.element_at(F.array(*(F.lit(x) for x, _ in _SAID)), (F.col("p_partkey") % len(_SAID) + 1).cast("int"))
    lines = F.array(*map(F.lit, ("目標とするところ", "１ 自主自律の人間を育てる", "心身を鍛え、健やかに")))
    said = extraction.spirit(F.concat(lines, extraction.refine(F.array(last))))
    # few bytes of keys are much work each, so that a part of a file is more than one task should have
    keys = S.table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return keys.select(F.col("p_partkey").alias("id"), said.alias("s")).select("id", "s.motto", "s.spirit")
