from __future__ import annotations

import random

import pytest

from larkspan.operators import joins


@pytest.fixture
def many_ranges(spark):
    keys = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_names_that_texts_begin_with_over_ranges(spark, many_ranges, seed):
    rng = random.Random(seed)
    letters = ["a", "b", "é", "日", "\U0001f600"]
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    names = [word(6) for _ in range(80)] + ["aa", "a"] + [None]
    texts = [word(12) for _ in range(500)] + ["a" * 3000, None, ""]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, id int")
    gazetteer = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.text: r.names for r in joins.prefix_names(frame, gazetteer).collect()}
    expected = {t: sorted({n for n in names if n and t.startswith(n)}, key=len) for t in set(texts) if t}
    assert got == {t: n for t, n in expected.items() if n}
    longest = {r.id: r.name for r in joins.longest_prefix(frame, gazetteer).collect()}
    assert longest == {i: (expected[t][-1] if t and expected[t] else None) for i, t in enumerate(texts)}


def test_one_text_and_one_name(spark):
    one = spark.createDataFrame([("abc",)], "text string")
    name = spark.createDataFrame([("ab",)], "name string")
    assert joins.longest_prefix(one, name).first().name == "ab"
    assert joins.longest_prefix(one, name.limit(0)).first().name is None
    assert joins.longest_prefix(one.limit(0), name).count() == 0


def test_one_character_apart(spark):
    words = ["abcd", "abxd", "xbcd", "abcde", "abc", "日本語版", "日本語板", "aabb", "abab", "abcd"]
    got = {(r.a, r.b) for r in joins.one_character(spark.createDataFrame([(w,) for w in words], "name string")).collect()}
    expected = {(a, b) for a in words for b in words if a < b and len(a) == len(b) >= 4 and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert got == expected and len(got) == 3
