from __future__ import annotations

import gzip
import hashlib

import pytest

from larkspan.llm import store, warc

BIG = "x" * 1000
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG + "y"), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/\r\n6", None), (7, "http://a/7", "é" * 500), (8, "http://a/8", "é" * 500), (9, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 60)]


def expected(rows):
    out = []
    for i, _, x in rows:
        raw = (x or "").encode()
        same = [j for j, _, y in rows if (y or "").encode() == raw]
        again = len(raw) >= 1000 and i != max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out)


def rows_of(found):
    from pyspark.sql import functions as F

    got = found.select(warc.page_id(F.col("record_id")).alias("i"), "bytes", "digest", "record_type", warc.page_id(F.col("refers_to_record")).alias("r"))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("keepers", [warc.KEEPERS, 0])
def test_archives_round_trip(spark, keepers):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    path = store.scratch(spark, "warc-test")
    warc.write(warc.resolve(warc.records(pages), keepers=keepers), path)
    assert rows_of(warc.join_revisits(warc.read(spark, path).drop("payload"))) == sorted(expected(ROWS), key=str)
    payloads = {r.record_id: bytes(r.payload) for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    by_page = {x.split(":")[2]: v for x, v in payloads.items()}
    assert by_page["=9"] == ROWS[8][2].encode() and by_page["=6"] == b""


def test_ties_nulls_and_none(spark):
    rows = [(5, "u", BIG), (5, "u", BIG), (3, "v", BIG), (None, "w", BIG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = rows_of(warc.archive(pages, store.scratch(spark, "warc-test")))
    assert [(r[0], r[3], r[4]) for r in got] == [(3, "revisit", 5), (5, "response", None), (5, "response", None), (None, "revisit", 5)]
    assert warc.archive(pages.limit(0), store.scratch(spark, "warc-test")).count() == 0


def test_an_id_of_several_payloads(spark):
    a, b = "a" * 1500, "b" * 2000
    rows = [(5, "u", a), (5, "u", b), (2, "v", b), (3, "w", a)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = {x: hashlib.sha1(x.encode()).hexdigest() for x in (a, b)}
    got = rows_of(warc.archive(pages, store.scratch(spark, "warc-test")))
    assert got == sorted([(5, 1500, digest[a], "response", None), (5, 2000, digest[b], "response", None), (2, 2000, digest[b], "revisit", 5), (3, 1500, digest[a], "revisit", 5)], key=str)


def test_ids_of_text_extra_columns_and_a_long_payload(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 300_000
    rows = [("a b:c>", "u", long, 1), ("é", "u", long, 1), ("", "u", long, 1), (None, "u", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, bytes int")
    found = warc.archive(pages, store.scratch(spark, "warc-test"))
    got = {(warc_id, r.record_type, to, r.bytes) for r in found.select("*", warc.page_id(found.record_id, "string").alias("p"), warc.page_id(found.refers_to_record, "string").alias("t")).collect() for warc_id, to in [(r.p, r.t)]}
    n = len(long.encode())
    assert got == {("é", "response", None, n), ("a b:c>", "revisit", "é", n), (None, "revisit", "é", n), (None, "response", None, 1)}


def test_archives_are_bounded_and_dated(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(95)], "page_id long, url string, html string").coalesce(1)
    warc.write(warc.resolve(warc.records(pages)), f"file://{tmp_path}/w", most=10)
    files = sorted((tmp_path / "w").glob("*.gz"))
    each = [list(warc.parse(f.read_bytes())) for f in files]
    assert len(files) == 10 and max(map(len, each)) == 10 and sum(map(len, each)) == 95
    ids = [h["warc-record-id"] for r in each for h, _ in r]
    assert len(set(ids)) == 95 and {h["warc-date"][:2] for r in each for h, _ in r} == {"20"}
    warc.write(warc.resolve(warc.records(pages)), f"file://{tmp_path}/v", date="2020-02-02T00:00:00Z")
    assert {h["warc-date"] for f in (tmp_path / "v").glob("*.gz") for h, _ in warc.parse(f.read_bytes())} == {"2020-02-02T00:00:00Z"}


def test_parser_reads_members_and_plain_text():
    def record(i, body):
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        return head + body + b"\r\n\r\n"

    bodies = [b"one", b"", b"WARC/1.0\r\n\r\n" * 5000]
    plain = b"".join(record(i, b) for i, b in enumerate(bodies))
    members = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))
    for raw in (plain, members, gzip.compress(plain)):
        assert [b for _, b in warc.parse(raw)] == bodies
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(plain[:-100]))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.parse(b"hello\r\n"))
