from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import fingerprint as fp

SMALL = st.text(alphabet="ab", max_size=30)


@settings(max_examples=200, deadline=None)
@given(SMALL, SMALL, st.integers(0, 30), st.integers(0, 30))
def test_extension_is_the_longest(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert fp.Prefix(fp.codes(a)).extension(i, fp.Prefix(fp.codes(b)), j) == n


@settings(max_examples=100, deadline=None)
@given(SMALL)
def test_equal_spans_have_equal_hashes(a):
    p = fp.Prefix(fp.codes(a))
    for i in range(len(a)):
        for j in range(i):
            n = min(3, len(a) - i)
            assert (a[i : i + n] == a[j : j + n]) == (p.span(i, i + n) == p.span(j, j + n))


def test_likeness_follows_overlap():
    words = [hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(1500)]
    a, b = " ".join(words[:500]), " ".join(words[500:1000])
    mixed = a[: len(a) * 2 // 3] + b[: len(a) // 3]
    prints = fp.sketches([fp.codes(x) for x in (a, b, mixed)])[0]
    assert fp.likeness(prints[0], prints[0]) == 1.0
    assert fp.likeness(prints[0], prints[1]) < 0.1
    assert 0.45 < fp.likeness(prints[0], prints[2]) < 0.85


DOCS = [(5, "the quick brown fox jumps over the lazy dog, twice"), (3, ""), (9, None), (7, "é中🙂" * 20), (1, "x"), (7, "second of seven"), (None, "null id"), (5, "the quick brown fox jumps over the lazy dog, twice")]


def brute(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    rows = sorted(rows, key=key)
    return rows, [((r[1] or ""), (rows[(i + 1) % len(rows)][1] or "")) for i, r in enumerate(rows)]


def test_neighbours(spark):
    unique = [r for r in DOCS if r[0] not in (7,)][:-1]
    docs = spark.createDataFrame([(*r, "n") for r in unique], "doc_id long, text string, n_chars string")
    got = {r.doc_id: r for r in fp.neighbours(docs).collect()}
    rows, pairs = brute(unique)
    assert len(got) == len(unique)
    for (i, _), (a, b) in zip(rows, pairs, strict=True):
        k = len(a) // 3
        changed = a[: len(a) - k] + b[:k]
        assert got[i].n_chars == len(a)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        prints = fp.sketches([fp.codes(x) for x in (a, changed, b)])[0]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (prints[0], prints[1])
        assert abs(got[i].near_edited - fp.likeness(prints[0], prints[1])) < 1e-9
        assert abs(got[i].near_next - fp.likeness(prints[0], prints[2])) < 1e-9


def test_repeated_rows_and_one_row_and_none(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = fp.neighbours(docs).collect()
    assert len(got) == len(DOCS)
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    alone = fp.neighbours(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fp.neighbours(docs.limit(0)).count() == 0


def test_many_tasks_lose_no_row(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in fp.neighbours(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 500
    for i, x in rows:
        k, after = len(x) // 3, rows[i - 1][1] if i else rows[-1][1]
        assert got[i].edited_sha256 == hashlib.sha256((x[: len(x) - k] + after[:k]).encode()).hexdigest()
