from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from larkspan.sources.snapshots import Folded, GateError, Store


def _rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def _folders(root):
    return [f for f in os.listdir(root / "data") if not f.startswith(".")]


def test_readers_see_whole_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", kept=2)
    assert store.current() is None
    with pytest.raises(ValueError, match="no version of a"):
        store.read("a")
    assert store.publish({"a": _rows(spark, [1]), "b": _rows(spark, [1, 2])})
    old = store.read("a")
    with pytest.raises(Exception, match="no such luck"):
        store.publish({"a": _rows(spark, [9]), "b": _rows(spark, [9]).select(F.raise_error(F.lit("no such luck")).cast("int").alias("v"))})
    assert [r.v for r in store.read("a").collect()] == [1] and store.read("b").count() == 2
    assert store.publish({"a": _rows(spark, [3]), "b": _rows(spark, [])})
    assert [r.v for r in store.read("a").collect()] == [3] and store.read("b").count() == 0
    assert [r.v for r in old.collect()] == [1], "a reader of the version before goes on"
    for i in range(5):
        store.publish({"a": _rows(spark, [i]), "b": _rows(spark, [i])})
    assert len(_folders(tmp_path)) == 4  # two tables of two versions


def test_a_batch_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.publish({"a": _rows(spark, [1])}, batch=5)
    assert not store.publish({"a": _rows(spark, [2])}, batch=5) and not store.publish({"a": _rows(spark, [2])}, batch=4)
    assert [r.v for r in store.read("a").collect()] == [1]


def test_a_broken_check_commits_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    checks = {"a": {"negative": F.col("v") < 0, "null": F.col("v").isNull()}}
    with pytest.raises(GateError, match="a: negative: 2") as e:
        store.publish({"a": _rows(spark, [1, -2, -3, None]), "b": _rows(spark, [1])}, checks=checks)
    assert e.value.found == {"a": {"rows": 4, "negative": 2, "null": 1}}
    assert store.current() is None and _folders(tmp_path) == []
    assert store.publish({"a": _rows(spark, []), "b": _rows(spark, [1])}, checks=checks) and store.counts["a"] == {"rows": 0}


def test_two_writers_of_one_version(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    folder = one._written("a", _rows(spark, [1]), {})
    assert two.publish({"a": _rows(spark, [2])})
    with pytest.raises(Exception, match="exists"):
        one._commit(0, {"a": ([folder], _rows(spark, [1]))})
    assert [r.v for r in two.read("a").collect()] == [2]


def test_parts_are_folded_and_their_number_is_bounded(spark, tmp_path):
    counts = Folded(Store(spark, f"file://{tmp_path}", kept=1), "counts", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), parts=3)
    expected = {}
    for number in range(11):
        batch = [(k % 4, number) for k in range(number)]
        for k, n in batch:
            expected[k] = expected.get(k, 0) + n
        for _ in range(2):
            counts.add(spark.createDataFrame(batch, "k int, n long"), number)
        assert len(_folders(tmp_path)) <= 3
        assert {r.k: r.n for r in counts.read().collect()} == expected
