"""Files that Spark has no reader for, as data sources: workbooks, zipped GeoJSON, delimited text in old charsets.

``spark.read.format(name).load(path)`` after ``register(spark)``; ``path`` is a file, a folder or a pattern. A workbook is read by a task for each sheet and an archive
by a task for each member; a task seeks its member in the file and parses it row by row, so that no file is held whole. Filters on the file, sheet or member leave out
partitions before they are read. Writers make one file a task, in the folder that is named, and only committed ones stay.

The files are opened with Arrow's file systems, by their address; those must be known to it on all executors.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it; a path without a scheme is a local one."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!//)/?", "file:///", path))


def _files(path: str, ending: tuple[str, ...]) -> list[str]:
    """The files of a path, a folder or a pattern, in order; those of a folder by their ending."""
    system, plain = _system(path)
    folder, _, last = plain.rpartition("/")
    if any(c in last for c in "*?["):
        found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, last))
    info = system.get_file_info(plain)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [plain]
    found = system.get_file_info(pafs.FileSelector(plain, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.lower().endswith(ending) and not f.base_name.startswith((".", "_")))


@dataclass
class _Part(InputPartition):
    """A file, and which of its sheets or members."""

    file: str
    member: str | None = None
    name: str | None = None


class _Reader(DataSourceReader):
    """One partition for each member of each file, less those that pushed filters exclude."""

    #: Columns that tell partitions apart, and how a file is known by its ending.
    FILE, MEMBER, ENDING = "file", "member", (".zip",)

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and column[0] in (self.FILE, self.MEMBER) and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column[0]] = self.wanted.get(column[0], values) & values
            else:
                yield f

    def _has(self, column: str, value: str | None) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        found = [_Part(f, member, name) for f in _files(path, self.ENDING) if self._has(self.FILE, f) for member, name in self.members(f) if self._has(self.MEMBER, name)]
        return found or [_Part("")]

    def members(self, file: str) -> list[tuple[str | None, str | None]]:
        """Where each member is, and the name that rows have it by."""
        raise NotImplementedError

    def rows(self, part: _Part) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.file:
            yield from self.rows(partition)

    def opened(self, file: str) -> Any:
        system, _ = _system(self.options["path"])
        return system.open_input_file(file)


@dataclass
class _Written(WriterCommitMessage):
    pending: str
    final: str


class _Writer(DataSourceWriter):
    """One file a task: written beside its name, and renamed when all tasks are done."""

    ENDING = ".zip"

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.schema, self.options, self.overwrite = schema, options, overwrite

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, folder = _system(self.options["path"])
        system.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        done = _Written(f"{folder}/_{name}", f"{folder}/{name}{self.ENDING}")
        with system.open_output_stream(done.pending) as out:
            self.put(iterator, out)
        return done

    def put(self, rows: Iterator[Row], out: Any) -> None:
        raise NotImplementedError

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _system(self.options["path"])
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if old.is_file and old.base_name.endswith(self.ENDING):
                    system.delete_file(old.path)
        for m in messages:
            if m is not None:
                system.move(m.pending, m.final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _system(self.options["path"])
        for m in messages:
            if m is not None and system.get_file_info(m.pending).is_file:
                system.delete_file(m.pending)


class _Output(io.RawIOBase):
    """An output stream for a ZIP file that is written from front to back."""

    def __init__(self, out: Any) -> None:
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data: Any) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False


def _by_member(rows: Iterator[Row], member: str) -> Iterator[tuple[str, Iterator[Row]]]:
    """Runs of rows of one member; rows come sorted by it."""
    import itertools

    seen = set()
    for name, own in itertools.groupby(rows, key=lambda r: r[member]):
        if name in seen:
            raise ValueError(f"rows are not sorted by {member}: {name} comes again")
        seen.add(name)
        yield name, own


# --- workbooks --------------------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _texts(item: ElementTree.Element) -> str:
    """The text of a shared or inline string, without phonetic parts."""
    spoken = {id(t) for r in item.iter(f"{_MAIN}rPh") for t in r.iter(f"{_MAIN}t")}
    return "".join(t.text or "" for t in item.iter(f"{_MAIN}t") if id(t) not in spoken)


class _WorkbookReader(_Reader):
    MEMBER, ENDING = "sheet", (".xlsx", ".xlsm")

    def members(self, file: str) -> list[tuple[str | None, str | None]]:
        with self.opened(file) as raw, zipfile.ZipFile(raw) as z:
            names = set(z.namelist())
            if "xl/workbook.xml" not in names:
                return [(n, n.rpartition("/")[2].removesuffix(".xml")) for n in sorted(names, key=lambda n: (len(n), n)) if n.startswith("xl/worksheets/sheet")]
            links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
            found = [(links.get(s.get(_RELATION, ""), ""), s.get("name")) for s in sheets]
            return [(m.removeprefix("/") if m.startswith("/") else f"xl/{m}", name) for m, name in found if m]

    def rows(self, part: _Part) -> Iterator[tuple]:
        with self.opened(part.file) as raw, zipfile.ZipFile(raw) as z:
            shared: list[str] | None = None
            number = 0
            with z.open(part.member) as sheet:
                for _, row in ElementTree.iterparse(sheet):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells = {}
                    for c in row.iter(f"{_MAIN}c"):
                        value, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                        text = value.text if value is not None else _texts(inline) if inline is not None else None
                        if c.get("t") == "s" and text is not None:
                            if shared is None:
                                shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
                            text = shared[int(text)]
                        if text is not None:
                            cells[re.match("[A-Z]+", c.get("r", "A"))[0]] = text
                    number = int(row.get("r", number + 1))
                    yield part.file, part.name, number, cells
                    row.clear()


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


class _WorkbookWriter(_Writer):
    """Rows of ``sheet`` and further columns, sorted by sheet, as a workbook; the names of the columns are the first row of each sheet."""

    ENDING = ".xlsx"

    def put(self, rows: Iterator[Row], out: Any) -> None:
        columns = [f.name for f in self.schema if f.name != "sheet"]
        names: list[str] = []
        with zipfile.ZipFile(_Output(out), "w", zipfile.ZIP_DEFLATED) as z:
            for name, own in _by_member(rows, "sheet"):
                names.append(str(name))
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_NS}><sheetData>{self.row(1, columns)}'.encode())
                    for i, r in enumerate(own, 2):
                        sheet.write(self.row(i, [r[c] for c in columns]).encode())
                    sheet.write(b"</sheetData></worksheet>")
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
            z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
            relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f'<Relationship Id="r{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))}</Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{relation}"><sheets>{"".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))}</sheets></workbook>')

    @staticmethod
    def row(number: int, values: list) -> str:
        def cell(i: int, v: Any) -> str:
            at = f"{_letters(i)}{number}"
            if isinstance(v, int | float) and not isinstance(v, bool):
                return f'<c r="{at}"><v>{v}</v></c>'
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

        return f'<row r="{number}">{"".join(cell(i, v) for i, v in enumerate(values) if v is not None)}</row>'


class Workbook(DataSource):
    """``workbook``: file, sheet, row_no and cells (text by column letter) of spreadsheets."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row_no int, cells map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _WorkbookWriter(schema, dict(self.options), overwrite)


# --- zipped GeoJSON ---------------------------------------------------------------------------------------


class _PointsReader(_Reader):
    def members(self, file: str) -> list[tuple[str | None, str | None]]:
        with self.opened(file) as raw, zipfile.ZipFile(raw) as z:
            return [(n, n) for n in sorted(z.namelist()) if n.lower().endswith((".geojson", ".json"))]

    def rows(self, part: _Part) -> Iterator[tuple]:
        with self.opened(part.file) as raw, zipfile.ZipFile(raw) as z:
            features = json.loads(z.read(part.member).decode("utf-8-sig")).get("features") or []
        for f in features:
            geometry = f.get("geometry") or {}
            if geometry.get("type") == "Point":
                lon, lat = geometry["coordinates"][:2]
                yield part.file, part.name, {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()}, float(lon), float(lat)


class _PointsWriter(_Writer):
    """Rows of member, properties (a map), lon and lat, sorted by member."""

    def put(self, rows: Iterator[Row], out: Any) -> None:
        with zipfile.ZipFile(_Output(out), "w", zipfile.ZIP_DEFLATED) as z:
            for name, own in _by_member(rows, "member"):
                with z.open(str(name), "w") as member:
                    member.write(b'{"type": "FeatureCollection", "features": [')
                    for i, r in enumerate(own):
                        feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [r["lon"], r["lat"]]}, "properties": r["properties"]}
                        member.write((", " * (i > 0) + json.dumps(feature, ensure_ascii=False)).encode())
                    member.write(b"]}")


class Points(DataSource):
    """``zipped_points``: file, member, properties, lon and lat of the point features of GeoJSON files in ZIP archives."""

    @classmethod
    def name(cls) -> str:
        return "zipped_points"

    def schema(self) -> str:
        return "file string, member string, properties map<string,string>, lon double, lat double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PointsReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PointsWriter(schema, dict(self.options), overwrite)


# --- delimited text in old charsets -----------------------------------------------------------------------


class _LegacyReader(_Reader):
    ENDING = (".csv", ".txt")

    def members(self, file: str) -> list[tuple[str | None, str | None]]:
        return [(None, None)]

    def rows(self, part: _Part) -> Iterator[tuple]:
        names = [f.name for f in self.schema if f.name != "file"]
        with self.opened(part.file) as raw, io.TextIOWrapper(io.BufferedReader(raw), self.options.get("encoding", "cp932"), "replace", newline="") as lines:
            for r in csv.DictReader(lines):
                yield tuple(part.file if f.name == "file" else r.get(f.name) for f in self.schema) if len(names) < len(self.schema.fields) else tuple(r.get(n) for n in names)


class _LegacyWriter(_Writer):
    ENDING = ".csv"

    def put(self, rows: Iterator[Row], out: Any) -> None:
        names = [f.name for f in self.schema]
        lines = io.TextIOWrapper(io.BufferedWriter(_Output(out)), self.options.get("encoding", "cp932"), "replace", newline="")
        table = csv.writer(lines)
        table.writerow(names)
        table.writerows([r[n] for n in names] for r in rows)
        lines.flush()


class Legacy(DataSource):
    """``legacy_csv``: named columns (``schema``) of delimited files with a header, in a charset (``encoding``, cp932) that Spark's reader rejects; missing ones are null."""

    @classmethod
    def name(cls) -> str:
        return "legacy_csv"

    def schema(self) -> str:
        raise ValueError("legacy_csv needs a schema: the columns to read, as text")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LegacyReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LegacyWriter(schema, dict(self.options), overwrite)


# --- one file a row ---------------------------------------------------------------------------------------


class _EachWriter(_Writer):
    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, folder = _system(self.options["path"])
        pending = f"{folder}/_{uuid.uuid4().hex}"
        system.create_dir(pending, recursive=True)
        for r in iterator:
            if "/" in r["name"] or r["name"].startswith((".", "_")):
                raise ValueError(f"no name of a file: {r['name']}")
            with system.open_output_stream(f"{pending}/{r['name']}") as out:
                out.write(bytes(r["content"] or b""))
        return _Written(pending, folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _system(self.options["path"])
        for m in messages:
            if m is not None:
                for f in system.get_file_info(pafs.FileSelector(m.pending)):
                    system.move(f.path, f"{m.final}/{f.base_name}")
                system.delete_dir(m.pending)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _system(self.options["path"])
        for m in messages:
            if m is not None:
                system.delete_dir(m.pending)


class NamedFiles(DataSource):
    """``named_files``: a file for each row of name and content (bytes); ``binaryFile`` reads them."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _EachWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Workbook, Points, Legacy, NamedFiles):
        spark.dataSource.register(source)
