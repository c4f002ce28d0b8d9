"""Sources: delimited text, nested JSON, archives, spreadsheets, HTML, embedded literals, lists, grids."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"
#: Charsets tried in turn after a declared one.
CHARSETS = ("utf-8", "cp932", "euc-jp")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by the header; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip(BOM) for c in df.columns))


def decode_bytes(raw: bytes) -> str:
    """Text of bytes: by the declared charset, else the first that fits, else with replacements."""
    declared = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", raw[:4096])
    names = [declared[1].decode("ascii").lower()] if declared else []
    for name in [*({"shift_jis": "cp932", "x-sjis": "cp932"}.get(n, n) for n in names), *CHARSETS]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Charset-sniffing decode of a binary column."""
    return content.map(lambda raw: None if raw is None else decode_bytes(raw))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _per_file(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that a parser makes of each file, with the file's path; files are parsed one at a time."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = parse(bytes(content))
                if rows:
                    yield pd.DataFrame({"path": [path] * len(rows), **{n: [r.get(n) for r in rows] for n in names}})

    return files.mapInPandas(run, f"path string, {schema}")


def read_legacy_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "cp932") -> DataFrame:
    """Named columns of delimited files in a charset that Spark's reader rejects."""

    def parse(raw: bytes) -> list[dict]:
        return [{c: r.get(c) for c in columns} for r in csv.DictReader(io.StringIO(raw.decode(encoding, "replace")))]

    return _per_file(read_files(spark, path), parse, ", ".join(f"`{c}` string" for c in columns))


STATION = "code long, name string, original_name string, lat double, lng double, prefecture long, closed boolean"
LINE = "code long, name string, station_list array<struct<code: long, name: string, lat: double, lng: double, closed: boolean>>"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a JSON array that are open."""
    return spark.read.schema(STATION).option("multiLine", True).json(path).where(~F.coalesce("closed", F.lit(False)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stops of each line in order, without closed ones: line, line_name, pos, station, lat, lon."""
    lines = spark.read.schema(LINE).option("multiLine", True).json(path)
    stops = lines.select(F.col("code").alias("line"), F.col("name").alias("line_name"), F.posexplode("station_list").alias("pos", "s")).where(~F.coalesce("s.closed", F.lit(False)))
    return stops.select("line", "line_name", "pos", F.col("s.name").alias("station"), F.col("s.lat").alias("lat"), F.col("s.lng").alias("lon"))


def read_zipped_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties (a map of strings), lon and lat of the point features of GeoJSON files in ZIP archives."""

    def parse(raw: bytes) -> list[dict]:
        out = []
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in sorted(n for n in z.namelist() if n.lower().endswith((".geojson", ".json"))):
                for f in json.loads(z.read(name).decode("utf-8-sig")).get("features", []):
                    geometry = f.get("geometry") or {}
                    if geometry.get("type") == "Point":
                        lon, lat = geometry["coordinates"][:2]
                        out.append({"properties": {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()}, "lon": float(lon), "lat": float(lat)})
        return out

    return _per_file(read_files(spark, path), parse, "properties map<string,string>, lon double, lat double")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_sheet(raw: bytes, expected: list[str] | None = None) -> list[dict]:
    """Rows of the first sheet of a workbook as cells by column letter; phonetic text is skipped.

    ``expected``: names that the first row must begin with.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                spoken = {id(t) for r in si.iter(f"{_MAIN}rPh") for t in r.iter(f"{_MAIN}t")}
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t") if id(t) not in spoken))
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    out = []
    for row in sheet.iter(f"{_MAIN}row"):
        cells = {}
        for c in row.iter(f"{_MAIN}c"):
            value, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
            text = value.text if value is not None else "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else None
            if text is not None:
                cells[re.match("[A-Z]+", c.get("r", "A"))[0]] = shared[int(text)] if c.get("t") == "s" else text
        out.append({"row_no": int(row.get("r", len(out) + 1)), "cells": cells})
    if expected is not None:
        head = [v for _, v in sorted(out[0]["cells"].items(), key=lambda p: (len(p[0]), p[0]))] if out else []
        if head[: len(expected)] != expected:
            raise ValueError(f"the sheet begins with {head}, not {expected}")
    return out


def read_sheets(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    return _per_file(read_files(spark, path), lambda raw: parse_sheet(raw, expected), "row_no int, cells map<string,string>")


#: What extraction of PDF files hands over; decoding them is outside the engine.
PDF_TEXT = T.StructType([T.StructField("file", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
PDF_CELLS = T.StructType([*(T.StructField(n, T.StringType() if n == "file" else T.IntegerType()) for n in ("file", "page", "table_no", "row_no")), T.StructField("cells", T.ArrayType(T.StringType()))])


def read_pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """file, page, line_no and text of extracted pages."""
    pages = spark.read.schema(PDF_TEXT).parquet(path)
    return pages.select("file", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def read_pdf_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PDF_CELLS).parquet(path)


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """number, slug and html of files named number_slug.html."""
    files = read_files(spark, path)
    name = F.regexp_extract("path", r"([^/]+)\.html?$", 1)
    return files.select(F.regexp_extract(name, "^([^_]+)_", 1).alias("number"), F.regexp_replace(name, "^[^_]+_", "").alias("slug"), decoded("content").alias("html"))


@F.pandas_udf(T.StringType())
def json_prefix(x: pd.Series) -> pd.Series:
    """The JSON value that a text begins with, over as many lines as it has; null where there is none."""

    def first(v: str | None) -> str | None:
        try:
            return None if v is None else v[: json.JSONDecoder().raw_decode(v)[1]]
        except ValueError:
            return None

    return x.map(first)


def embedded_json(page: Column, marker: str) -> Column:
    """The JSON text of the literal that follows a marker."""
    return json_prefix(F.nullif(F.regexp_extract(page, "(?s)" + marker + r"\s*(.*)", 1), F.lit("")))


def read_key_urls(spark: SparkSession, path: str) -> DataFrame:
    """key and url of lines ``key url``; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", r"\s+", 2)
    return lines.select(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("url"))


def lookup(table: DataFrame, **keys: object) -> DataFrame:
    """Rows of a table by key."""
    for name, value in keys.items():
        table = table.where(F.col(name) == value)
    return table


def exists(table: DataFrame, **keys: object) -> bool:
    return not lookup(table, **keys).isEmpty()


def key_value(table: DataFrame, key: str, schema: str, now: Column | None = None) -> DataFrame:
    """The JSON value of a key that hasn't expired; table: key, value, expires_at."""
    live = table.where((F.col("key") == key) & (F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now))))
    return live.select("key", F.from_json("value", schema).alias("value"))


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of a few parameter values."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


#: Combinations that a grid of values of tables may have.
GRID = 1_000_000


def grid_of(most: int = GRID, **axes: DataFrame) -> DataFrame:
    """All combinations of the distinct values of tables of one column, null not among them; more than ``most`` are an error before any is made."""
    listed = {name: df.select(F.col(df.columns[0]).alias("v")).where("v is not null").distinct() for name, df in axes.items()}
    size = 1
    for df in listed.values():
        size *= df.count()
    if size > most:
        raise ValueError(f"{size} combinations of {', '.join(axes)} are more than {most}")
    out = None
    for name, df in listed.items():
        values = df.agg(F.array_sort(F.collect_set("v")).alias(f"__{name}"))
        out = values if out is None else out.join(F.broadcast(values), F.lit(True))
    # one row of arrays, whose sizes are known
    for name in axes:
        out = out.withColumn(name, F.explode(f"__{name}")).drop(f"__{name}")
    return out.select(*axes)


def read_json_gz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_sitemap(spark: SparkSession, path: str, pattern: str = r"<loc>[^<]*/([^/<]+)/?</loc>") -> DataFrame:
    """The distinct slugs of a sitemap."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("slug"))
    return found.distinct()


def is_blocked(path: Column, rules: Column) -> Column:
    """Whether robots rules (array of struct(allow, prefix)) forbid a path: the longest rule that fits decides."""
    fitting = F.filter(rules, lambda r: (r["prefix"] != "") & F.startswith(path, r["prefix"]))
    longest = F.aggregate(fitting, F.struct(F.lit(True).alias("allow"), F.lit(-1).alias("n")), lambda a, r: F.when((F.length(r["prefix"]) > a["n"]) | ((F.length(r["prefix"]) == a["n"]) & r["allow"]), F.struct(r["allow"].alias("allow"), F.length(r["prefix"]).alias("n"))).otherwise(a))
    return ~longest["allow"]
