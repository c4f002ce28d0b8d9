"""WARC archives: records written by Spark, read back by length, and revisits resolved by payload digest.

Headers (id, digest, length) are aggregated by digest to name each group's response; a payload of at
least ``SMALL`` bytes that another record holds as well is written once, and its other records become
revisits that refer to the response. A record's id is made of the page's id and the payload's digest. Archives are gzip files of whole records,
``RECORDS`` at most, written with Spark's text writer (the record separator of the format is its line separator), so that they go to any file system that
Spark can write; a writer of binary files, which one gzip member for each record would need, it doesn't have. Reading parses records by their Content-Length, never by
searching in payloads, inflates an archive piece by piece and digests each payload again. Reading resolves revisits: they are joined to the responses that they name, by record id and digest.

Defined results: a null html is an empty payload; ids are of any type that can be ordered; null ids order first, so that they are a response only in a
group of nulls; rows of one group that share the largest id are all responses; rows equal in id and payload have one record id; an id of several payloads has a record for each; a null url has no target
header; control characters in a url are percent-encoded; a payload of any length is one record, which a task holds whole; an empty table gives an empty archive; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import store

#: Payloads of fewer bytes are never revisits.
SMALL = 1000
#: Digests of repeated payloads up to which their table is broadcast (about 100 bytes a row).
KEEPERS = 200_000
#: Records of one archive, at most.
RECORDS = 20_000

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:page:"


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, its bytes and digest of each row."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest")
    )


def resolve(found: DataFrame, *, small: int = SMALL, keepers: int = KEEPERS) -> DataFrame:
    """``records`` with record_type and refers_to: equal payloads keep the largest id as response."""
    groups = found.where(F.col("bytes") >= small).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    groups = store.written(groups, "keepers")
    side = F.broadcast(groups) if groups.count() <= keepers else groups
    joined = found.join(side, "digest", "left")
    again = F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("keeper")))
    return joined.select(*found.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def record_id(row_id: Column, digest: Column) -> Column:
    """The id of a record: of the page's id (with a sign before it, none for null) and the digest of its payload."""
    name = F.coalesce(F.concat(F.lit("="), F.url_encode(row_id.cast("string"))), F.lit(""))
    return F.concat(F.lit(f"<{_RECORD}"), name, F.lit(":"), digest, F.lit(">"))


def _record(row_id: Column, url: Column, kind: Column, refers: Column, digest: Column, size: Column, payload: Column, date: str) -> Column:
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f\x7f]", "%00")
    block = F.concat(F.lit(_HTTP), F.when(kind == "response", payload).otherwise(""))
    headers = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(row_id, digest)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(kind == "revisit", F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), record_id(refers, digest))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *headers), F.lit("\r\n\r\n"), block)


def write(resolved: DataFrame, path: str, *, date: str | None = None, most: int = RECORDS) -> None:
    """Archives of fresh headers, dated now unless told otherwise, and deduplicated payloads."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    value = _record(F.col("id"), F.col("url"), F.col("record_type"), F.col("refers_to"), F.col("digest"), F.col("bytes"), F.col("payload"), date)
    resolved.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class _Unzipped(io.RawIOBase):
    """The bytes of an archive; gzip members are inflated as they are read."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = memoryview(raw), 0
        self.zipped = raw[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)
        self.ready = b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.ready:
            if self.at >= len(self.raw):
                return 0
            piece = self.raw[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            if not self.zipped:
                self.ready = bytes(piece)
                continue
            self.ready = self.inflate.decompress(piece)
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-case) and block of each record of an archive, plain or gzip."""
    stream = io.BufferedReader(_Unzipped(raw), 1 << 16)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{headers.get('warc-record-id')} is cut short: {len(block)} of {size} bytes")
        yield headers, block


_COLUMNS = ["record_id", "url", "record_type", "refers_to_record", "digest", "declared_digest", "bytes", "payload"]


def read(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; digest and bytes are of the payload as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for headers, block in parse(batch.column(0)[i].as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                    refers, declared = headers.get("warc-refers-to"), headers.get("warc-payload-digest")
                    rows.append(
                        (headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-type"), refers, hashlib.sha1(body).hexdigest(), declared and declared.rpartition(":")[2], len(body), body if payload else None)
                    )
                    held += len(block)
                    if held > 1 << 22:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, url string, record_type string, refers_to_record string, digest string, declared_digest string, bytes long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)


def join_revisits(found: DataFrame) -> DataFrame:
    """Read records, each revisit with the digest and bytes of the response that it refers to.

    A revisit whose response is not there keeps its declared digest and null bytes. A response whose
    payload doesn't have the digest that its header declares ends the job.
    """
    good = F.col("declared_digest").isNull() | (F.col("declared_digest") == F.col("digest"))
    responses = found.where("record_type = 'response'").select("record_id", "url", "record_type", "refers_to_record", F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs: "), "record_id"))).alias("digest"), "bytes")
    revisits = found.where("record_type = 'revisit'").select("record_id", "url", "record_type", "refers_to_record", "declared_digest")
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record"), F.col("digest").alias("declared_digest")).agg(F.max("bytes").alias("bytes"), F.first("digest").alias("original"))
    resolved = revisits.join(originals, ["refers_to_record", "declared_digest"], "left")
    return responses.unionByName(resolved.select("record_id", "url", "record_type", "refers_to_record", F.coalesce("original", "declared_digest").alias("digest"), "bytes"))


def page_id(record_id: Column, kind: str = "long") -> Column:
    """The page's id that a record's id was made of."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, f"^<{_RECORD}=([^:>]*):", 1), F.lit(""))).cast(kind)


def archive(pages: DataFrame, path: str, **columns: str) -> DataFrame:
    """Write the deduplicated archives of ``pages`` to ``path``, read them back and resolve the revisits."""
    spark = pages.sparkSession
    write(resolve(records(pages, **columns)), path)
    # the headers as read, without payloads, once
    return join_revisits(store.written(read(spark, path, payload=False).drop("payload"), "headers"))
