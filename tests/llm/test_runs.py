from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import queries, runs
from tests import oracle


def smallest_period(words):
    border = [0] * len(words)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    return len(words) - border[-1]


def brute(words, least=24, times=3):
    """Every maximal stretch of every distance, by comparing each word with the one that far on."""
    out = []
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, times * q) and smallest_period(words[start : start + length]) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


LETTERS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=6), st.integers(0, 12), LETTERS, st.sampled_from([(6, 3), (4, 2), (7, 3), (2, 2), (12, 4), (9, 2)]))
def test_all_runs_of_short_texts(before, unit, times, after, limits):
    words = before + unit * times + after
    assert runs.find(words, *limits) == brute(words, *limits)


def test_runs_of_long_texts_with_nested_and_touching_periods():
    rng = random.Random(5)
    for _ in range(60):
        words = []
        while len(words) < rng.choice([30, 300, 900]):
            unit = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.choice([1, 2, 3, 8, 9, 20, 60]))]
            part = unit * rng.randint(1, 9)
            words += part[: len(part) - rng.randrange(len(unit))]
            if rng.random() < 0.4:
                words += words[-rng.randint(1, 200) :] * 3
        words = words[:3000]
        assert runs.find(words) == brute(words)


def test_one_word_many_times_and_a_text_of_one_period():
    assert runs.find([b"la"] * 100_000) == [(0, 100_000, 1)]
    unit = [str(i).encode() for i in range(5000)]
    assert runs.find(unit * 4) == [(0, 20_000, 5000)]
    assert runs.find(unit) == [] and runs.find([b"a"] * 23) == [] and runs.find([b"a"] * 24) == [(0, 24, 1)]


def test_collapsed_keeps_the_first_period_of_each_run():
    words = [b"s", *[b"a", b"b"] * 15, b"t"]
    assert runs.find(words) == [(1, 30, 2)]
    assert runs.collapsed(words, [(1, 30, 2)]) == [b"s", b"a", b"b", b"t"]


def expected(doc_id, value):
    words = (value or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(value):
    return hashlib.sha256(value).hexdigest()


def fast(words):
    """Brute force again, each distance at once."""
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    out = []
    for q in range(1, len(words) // 3 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in edges.reshape(-1, 2).tolist():
            length = end - start + q
            if length >= max(24, 3 * q) and smallest_period(ids[start : start + length].tolist()) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_registered_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_runs(spark, oracle.SF).collect()}
    assert len(got) == len(rows)
    many = 0
    for doc_id, value in rows:
        words = expected(doc_id, value)
        found = fast(words)
        many += len(found) > 0
        row = got[doc_id]
        assert row.n_runs == len(found)
        if found:
            # exact comparison by cross products: 12 digits are more than any product here
            best = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert row.start is row.length is row.period is row.exponent_milli is None
        assert row.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode())
        kept = np.ones(len(words), bool)
        for s, n, q in found:
            kept[s + q : s + n] = False
        assert row.collapsed_sha256 == digest(b" ".join(w for w, k in zip(words, kept, strict=True) if k))
    assert many >= 5


def test_greatest_prefers_exponent_then_start_then_period(spark):
    cases = [
        ([(0, 24, 8), (30, 40, 10), (90, 41, 10)], (90, 41, 10)),
        ([(5, 60, 20), (2, 30, 10), (2, 33, 11)], (2, 30, 10)),
        ([], None),
    ]
    docs = spark.createDataFrame([(i, [dict(zip(("start", "length", "period"), r, strict=True)) for r in c]) for i, (c, _) in enumerate(cases)], "i int, runs array<struct<start:long,length:long,period:long>>")
    got = {r.i: r.best for r in docs.select("i", runs.greatest(docs.runs).alias("best")).collect()}
    assert {i: tuple(x) if x else None for i, x in got.items()} == {i: b for i, (_, b) in enumerate(cases)}


def test_nulls_repeats_other_columns_ids_of_text_and_none(spark):
    long = "no " + "one two three " * 50_000
    rows = [(None, "a " * 30, "r"), ("x", None, "r"), ("x", "", "r"), ("x", None, "r"), ("y", "a\x0b" * 12 + "a\u00a0a" + " a" * 30, "r"), ("z", long, "r")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, runs string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.scan(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(None, [(0, 30, 1)], "a"), ("x", [], ""), ("x", [], ""), ("x", [], ""), ("y", [(13, 30, 1)], "a " * 12 + "a\u00a0a a"), ("z", [(1, 150_000, 3)], "no one two three")], key=str
    )
    assert runs.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.scan(docs, times=1)
