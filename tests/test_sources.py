"""Sources and sinks, with files made here."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspan.sources import readers, sinks


def test_csv_drops_the_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿number,name\n001,\"a,b\"\n", encoding="utf-8")
    row = readers.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert row.number == "001" and row.name == "a,b"


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("学校番号,学校名\n007,日比谷\n".encode("cp932"))
    row = readers.read_legacy_csv(spark, str(tmp_path / "a.csv"), ["学校番号", "学校名"]).first()
    assert row["学校番号"] == "007" and row["学校名"] == "日比谷"


@pytest.mark.parametrize("charset", ["utf-8", "cp932", "euc-jp"])
def test_charsets(charset):
    assert readers.decode_bytes("部活動の一覧です。写真部".encode(charset)) == "部活動の一覧です。写真部"
    declared = f'<meta charset="{charset}">'.encode()
    assert readers.decode_bytes(declared + "新聞".encode(charset)).endswith("新聞")


def test_broken_bytes_are_replaced():
    assert "�" in readers.decode_bytes(b"\xff\xfe\xff\x80\x81")


def test_lines_and_stations(spark, tmp_path):
    line = {"code": 1, "name": "L", "station_list": [{"code": 1, "name": "A", "lat": 1.0, "lng": 2.0}, {"code": 2, "name": "B", "closed": True}, {"code": 3, "name": "C", "lat": 1.5, "lng": 2.5}]}
    (tmp_path / "1.json").write_text(json.dumps(line))
    (tmp_path / "s.json").write_text(json.dumps([{"code": 1, "name": "A"}, {"code": 2, "name": "B", "closed": True}]))
    got = readers.read_lines(spark, str(tmp_path / "1.json")).orderBy("pos").collect()
    assert [(r.pos, r.station) for r in got] == [(0, "A"), (2, "C")]
    assert [r.name for r in readers.read_stations(spark, str(tmp_path / "s.json")).collect()] == ["A"]


def test_zipped_geojson(spark, tmp_path):
    feature = {"geometry": {"type": "Point", "coordinates": [139.5, 35.5]}, "properties": {"name": "x", "n": 3, "z": None}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.geojson", json.dumps({"features": [feature, {"geometry": None}]}))
    row = readers.read_zipped_geojson(spark, str(tmp_path / "a.zip")).first()
    assert (row.lon, row.lat) == (139.5, 35.5) and row.properties == {"name": "x", "n": "3", "z": None}


def _workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>学校</t><rPh sb=\"0\" eb=\"2\"><t>ガッコウ</t></rPh></si><si><t>URL</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_sheet(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook())
    got = readers.read_sheets(spark, str(tmp_path / "a.xlsx"), ["学校", "URL"]).orderBy("row_no").collect()
    assert got[0].cells == {"A": "学校", "C": "URL"} and got[1].cells == {"A": "7"}
    with pytest.raises(ValueError, match="begins with"):
        readers.parse_sheet(_workbook(), ["name"])


def test_html_files(spark, tmp_path):
    (tmp_path / "402_aoyama-h.html").write_bytes("<p>写真部</p>".encode("euc-jp"))
    row = readers.read_html(spark, str(tmp_path)).first()
    assert (row.number, row.slug) == ("402", "aoyama-h") and "写真部" in row.html


def test_lists_and_grids(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\n\nA http://x/1\nB   http://x/2\n")
    assert {(r.key, r.url) for r in readers.read_key_urls(spark, str(tmp_path / "u.txt")).collect()} == {("A", "http://x/1"), ("B", "http://x/2")}
    assert readers.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    (tmp_path / "m.xml").write_text("<loc>http://h/a-h/</loc><loc>http://h/b-h</loc><loc>http://h/a-h/</loc>")
    assert {r.slug for r in readers.read_sitemap(spark, str(tmp_path / "m.xml")).collect()} == {"a-h", "b-h"}


def test_pdf_contract(spark, tmp_path):
    spark.createDataFrame([("a.pdf", 1, "x\ny")], readers.PDF_TEXT).write.parquet(str(tmp_path / "t"))
    assert [r.text for r in readers.read_pdf_text(spark, str(tmp_path / "t")).orderBy("line_no").collect()] == ["x", "y"]
    spark.createDataFrame([("a.pdf", 1, 0, 0, ["x", None])], readers.PDF_CELLS).write.parquet(str(tmp_path / "c"))
    assert readers.read_pdf_cells(spark, str(tmp_path / "c")).first().cells == ["x", None]


def test_key_values(spark):
    table = spark.createDataFrame([("a", '{"n": 1}', None)], "key string, value string, expires_at timestamp")
    table = sinks.put(table, spark.createDataFrame([("b", '{"n": 2}')], "key string, value string"), "24 hours")
    assert readers.key_value(table, "b", "n int").first().value.n == 2
    later = F.current_timestamp() + F.expr("INTERVAL 25 HOURS")
    assert readers.key_value(table, "b", "n int", later).isEmpty()
    assert readers.key_value(table, "a", "n int", later).count() == 1
    assert readers.exists(table, key="a") and not readers.exists(table, key="z")


def test_robots(spark):
    rules = F.array(F.struct(F.lit(False).alias("allow"), F.lit("/a").alias("prefix")), F.struct(F.lit(True).alias("allow"), F.lit("/a/b").alias("prefix")))
    got = spark.createDataFrame([("/a/x",), ("/a/b/x",), ("/c",)], "p string").select(readers.is_blocked(F.col("p"), rules).alias("b")).collect()
    assert [r.b for r in got] == [True, False, False]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    sinks.write_csv(rows, str(tmp_path / "csv"), ["id", "name"], files=1)
    assert readers.read_csv(spark, str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError, match="not expected"):
        sinks.write_csv(rows, str(tmp_path / "csv"), ["id"])
    sinks.write_json_gz(rows, str(tmp_path / "json"))
    assert readers.read_json_gz(spark, str(tmp_path / "json"), "id int, name string").count() == 2
    assert [r.json for r in sinks.to_documents(rows).orderBy("json").collect()] == ['{"id":1,"name":"a"}', '{"id":2}']
    sinks.refresh({"t": rows}, str(tmp_path / "db"))
    sinks.refresh({"t": rows.limit(1)}, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/t")).count() == 1
    assert sinks.write_valid(rows, rows.where("id = 2"), str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert not sinks.write_valid(rows, rows.where("id = 9"), str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    report = sinks.markdown(rows, "T", most=1)
    assert "… 1 more rows" in report and report.startswith("# T")


def test_embedded_json_over_lines_and_brackets(spark):
    page = 'x\nconst D = {"a": "};\\n]",\n "b": [1, {"c": 2}]};\nconst E = 1;'
    got = spark.range(1).select(readers.embedded_json(F.lit(page), "const D ="), readers.embedded_json(F.lit(page), "const F ="), readers.embedded_json(F.lit(page), "const ")).first()
    assert json.loads(got[0]) == {"a": "};\n]", "b": [1, {"c": 2}]} and got[1] is None and got[2] is None


def test_grids_of_tables_are_bounded(spark):
    one, two = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int"), spark.createDataFrame([("a",), ("b",)], "y string")
    assert sorted(map(tuple, readers.grid_of(n=one, s=two).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert [r.n for r in readers.grid_of(n=one).orderBy("n").collect()] == [1, 2] and readers.grid_of(n=one.limit(0), s=two).count() == 0
    with pytest.raises(ValueError, match="4 combinations of n, s are more than 3"):
        readers.grid_of(3, n=one, s=two)


def test_reports_of_any_size(spark):
    rows = spark.createDataFrame([(2, "b|c\nd"), (1, None)], "n int, t string")
    lines = [r.line for r in sinks.report(rows, "T", ["n"]).orderBy("pos").collect()]
    assert lines == ["# T", "", "| n | t |", "| --- | --- |", "| 1 |  |", "| 2 | b\\|c d |"]
    assert sinks.report(rows.limit(0), "T", ["n"]).count() == 4
