from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspan.sources import files
from tests.test_sources import _workbook


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    files.register(spark)


def test_workbooks_round_trip_sheet_by_sheet(spark, tmp_path):
    rows = spark.createDataFrame([("b & <c>", 1, "x\n「y」 ", 1.5, None), ("a", 2, None, 2.0, True), ("b & <c>", 3, "ä", None, False)], "sheet string, n int, t string, d double, f boolean")
    rows.repartition(1).sortWithinPartitions("sheet", "n").write.format("workbook").mode("overwrite").save(f"file://{tmp_path}/w")
    got = spark.read.format("workbook").load(f"file://{tmp_path}/w")
    cells = {(r.sheet, r.row_no): r.cells for r in got.collect()}
    assert cells == {
        ("a", 1): {"A": "n", "B": "t", "C": "d", "D": "f"}, ("a", 2): {"A": "2", "C": "2.0", "D": "True"}, ("b & <c>", 1): {"A": "n", "B": "t", "C": "d", "D": "f"},
        ("b & <c>", 2): {"A": "1", "B": "x\n「y」 ", "C": "1.5"}, ("b & <c>", 3): {"A": "3", "B": "ä", "D": "False"},
    }


def test_a_workbook_of_many_sheets_is_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).select(F.format_string("s%02d", F.col("id") % 40).alias("sheet"), "id")
    rows.repartition(1).sortWithinPartitions("sheet").write.format("workbook").mode("append").save(str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.xlsx"))) == 1
    found = spark.read.format("workbook").load(str(tmp_path / "w"))
    assert found.rdd.getNumPartitions() == 40 and found.count() == 440
    two = found.where("sheet IN ('s07', 's08')")
    assert two.rdd.getNumPartitions() == 2 and {r.sheet for r in two.collect()} == {"s07", "s08"} and two.count() == 22
    assert found.where("sheet = 'none'").count() == 0
    assert found.where("sheet = 's01' AND row_no > 5").count() == 6


def test_rows_that_are_not_sorted_write_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "sheet string, n int").coalesce(1)
    with pytest.raises(Exception, match="not sorted"):
        rows.write.format("workbook").mode("append").save(str(tmp_path / "w"))
    assert list((tmp_path / "w").glob("*.xlsx")) == []


def test_shared_strings_without_their_phonetic_parts(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook())
    got = {r.row_no: r.cells for r in spark.read.format("workbook").load(str(tmp_path / "*.xlsx")).collect()}
    assert got == {1: {"A": "学校", "C": "URL"}, 2: {"A": "7"}}


def test_points_of_archives_member_by_member(spark, tmp_path):
    point = {"geometry": {"type": "Point", "coordinates": [139.5, 35.5, 9]}, "properties": {"name": "x", "n": 3, "z": None}}
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("1.geojson", "﻿" + json.dumps({"features": [point, {"geometry": None}, {"geometry": {"type": "LineString", "coordinates": []}}]}))
            z.writestr("2.json", json.dumps({"features": None}))
            z.writestr("readme.txt", "x")
    found = spark.read.format("zipped_points").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 4
    assert [(r.file.rpartition("/")[2], r.member, r.properties, r.lon, r.lat) for r in found.orderBy("file").collect()] == [(f"{n}.zip", "1.geojson", {"name": "x", "n": "3", "z": None}, 139.5, 35.5) for n in ("a", "b")]
    assert found.where(F.col("member") == "2.json").rdd.getNumPartitions() == 2


def test_points_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m1.json", {"k": "v「"}, 1.25, 2.5), ("m2.json", {}, -1.0, 0.0)], "member string, properties map<string,string>, lon double, lat double")
    rows.coalesce(1).sortWithinPartitions("member").write.format("zipped_points").mode("append").save(str(tmp_path / "p"))
    assert sorted(tuple(r)[1:] for r in spark.read.format("zipped_points").load(str(tmp_path / "p")).collect()) == sorted(tuple(r) for r in rows.collect())


def test_delimited_text_in_an_old_charset(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("学校番号,学校名,他\r\n007,\"日比\r\n谷\",x\r\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes("学校名,学校番号\n青山,402\n".encode("cp932"))
    found = spark.read.format("legacy_csv").schema("`学校番号` string, `学校名` string, `所在` string").load(str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("007", "日比\r\n谷", None), ("402", "青山", None)]
    named = spark.read.format("legacy_csv").schema("file string, `学校名` string").load(str(tmp_path / "b.csv"))
    assert [(r.file.rpartition("/")[2], r["学校名"]) for r in named.collect()] == [("b.csv", "青山")]
    with pytest.raises(Exception, match="needs a schema"):
        spark.read.format("legacy_csv").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="none.csv"):
        spark.read.format("legacy_csv").schema("a string").load(str(tmp_path / "none.csv")).collect()


def test_legacy_text_round_trips_and_is_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a,\"b\"", "日\n本"), ("", "x")], "p string, q string")
    for _ in range(2):
        rows.write.format("legacy_csv").mode("overwrite").save(str(tmp_path / "c"))
    back = spark.read.format("legacy_csv").schema("p string, q string").load(str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert not list((tmp_path / "c").glob("_*"))
