from __future__ import annotations

import random
import zlib

import numpy as np

from larkspan.llm import quality
from tests.oracle import SF


def _rows(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ta", "re", "mo", "li", "sun", "er", "and", "the", "of", "ing"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        good = i % 4 != 0
        out.append((i, " ".join(words if good else [w + rng.choice(["&&&", "###"]) for w in words]), int(good)))
    return out


def test_held_out_accuracy_and_columns(spark):
    rows = _rows(800)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_never_learned(spark):
    rows = _rows(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    a = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame(flip, "doc_id long, quality int"))
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score(docs, quality.train(docs, odd)).collect())
    assert quality.score(docs.limit(0), quality.train(docs, none)).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.5)
    rows = [np.arange(5)] * 60
    old, quality.SIZE = quality.SIZE, 5
    try:
        w, b = quality.descend(rows, list(x), y, cost, epochs=400)
    finally:
        quality.SIZE = old

    def loss(v):
        return 0.5 * (v @ v) + (cost * np.maximum(0, 1 - y * (x @ v[:5] + v[5])) ** 2).sum()

    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + 0.01 * rng.normal(size=6)) >= best - 1e-6 for _ in range(200))


def test_sample_bound(spark):
    rows = _rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, fit_rows=200)
    got = quality.score(docs, model).collect()
    assert len(got) == 600


def test_registered_query(spark):
    from larkspan.llm import queries

    assert queries.op5_quality(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
