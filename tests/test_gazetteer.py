from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspan.operators import gazetteer

NAMES = ["八王子", "西八王子", "王子", "新宿", "新宿三", "三田", "平和台", "和", "", "八王子"]


def station_of(line, names):
    """The rule one name after the other, longest first."""

    def boards(name):
        return any(not re.match(r"\s*(行|方面|ゆき|経由)", line[m.end() : m.end() + 3]) and not re.match(r"\s*線", line[m.end() : m.end() + 3]) for m in re.finditer(re.escape(name) + r"[」』]?\s*駅?", line))

    ordered = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    for name in ordered:
        if len(name) >= 2 and re.search(re.escape(name) + r"[」』]?\s*駅", line) and boards(name):
            return name
    return next((n for n in ordered if len(n) >= 3 and n in line and boards(n)), None)


@pytest.mark.parametrize("shard", [gazetteer.SHARD, 5])
def test_boarding_against_the_rule(spark, shard):
    rng = random.Random(3)
    pieces = ["八王子", "西", "王子", "新宿", "三", "田", "平和台", "駅", "駅", "行き", "方面", "線", "ゆき", "経由", "」", "「", " ", "　", "から", "和"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, ""]
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    got = {r.id: r.name for r in gazetteer.boarded(rows, names, ["id"], "line", shard=shard).collect()}
    expected = {i: s for i, x in enumerate(lines) if x and (s := station_of(x, NAMES))}
    assert got == expected and len(set(expected.values())) > 4


@pytest.mark.parametrize("shard", [gazetteer.SHARD, 4])
def test_all_names_inside(spark, shard):
    names = ["a", "aa", "ab", "ba", "cab", "é"]
    texts = ["", None, "aaa", "cabab", "xéx a", "zzz"]
    rows = gazetteer.inside(spark.createDataFrame([(i, x, "f") for i, x in enumerate(texts)], "id int, t string, other string"), spark.createDataFrame([(n,) for n in names], "name string"), "t", marks={"b": "b"}, shard=shard)
    got = {r.id: [tuple(f) for f in r.found] for r in rows.collect()}

    def expected(t):
        out = []
        for n in names:
            at = [i for i in range(len(t or "")) if t.startswith(n, i)]
            if at:
                behind = [t.startswith("b", i + len(n)) for i in at]
                out.append((n, len(at), at[0], any(behind), all(behind)))
        return sorted(out, key=lambda f: (f[2], f[0]))

    assert got == {i: expected(t) for i, t in enumerate(texts)}
    assert rows.columns == ["id", "t", "other", "found"]


def test_no_names_and_no_texts(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, t string")
    none = spark.createDataFrame([], "name string")
    assert gazetteer.inside(rows, none, "t").first().found == []
    assert gazetteer.boarded(rows.limit(0), none, ["id"], "t").count() == 0


def test_a_long_text_and_many_names(spark):
    names = spark.range(20_000).select(F.format_string("name%05d", "id").alias("name"))
    text = " ".join(f"name{i:05}x" for i in range(0, 40_000, 7))
    found = gazetteer.inside(spark.createDataFrame([(1, text)], "id int, t string"), names, "t", shard=60_000).first().found
    assert [f.name for f in found] == [f"name{i:05}" for i in range(0, 20_000, 7)]


@pytest.mark.parametrize("shard", [gazetteer.SHARD, 3])
def test_words(spark, shard):
    lines = [(1, ["the", "gear", "is", "bolt"]), (2, ["bolt", "or", "rod"]), (3, ["of", "is"]), (4, []), (5, ["of"]), (6, ["plate", "rod", "plate"])]
    rows = spark.createDataFrame([(i, [(w, n) for w, n in zip(x, [*x[1:], None][: len(x)], strict=True)]) for i, x in lines], "line_id int, words array<struct<word: string, next: string>>").repartition(3)
    names = spark.createDataFrame([(n,) for n in ("gear", "bolt", "rod", "of", "plate")], "name string")
    got = {r.line_id: (r.name, r.suffixed) for r in gazetteer.words(rows, names, suffix="is", rejected=("or",), shard=shard).collect()}
    assert got == {1: ("gear", True), 2: ("rod", False), 3: ("of", True), 6: ("plate", False)}


def test_words_are_looked_up_a_few_lines_at_once(spark, monkeypatch):
    """Positions and words are right across slices of a batch, with null and empty lines between."""
    monkeypatch.setattr(gazetteer, "ROWS", 3)
    lines = [(i, None if i % 5 == 0 else [("the", f"n{i}"), (f"n{i}", None)] * (i % 4)) for i in range(23)]
    rows = spark.createDataFrame(lines, "line_id int, words array<struct<word: string, next: string>>").coalesce(1)
    names = spark.createDataFrame([(f"n{i}",) for i in range(10, 23)], "name string")
    got = {r.line_id: r.name for r in gazetteer.words(rows, names, suffix="is", rejected=("or",), least=(2, 3)).collect()}
    assert got == {i: f"n{i}" for i in range(10, 23) if i % 5 and i % 4}
    assert gazetteer.ROWS == 3
