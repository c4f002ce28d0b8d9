from __future__ import annotations

import random

import numpy as np
import pytest

from larkspan.llm import components, minhash
from tests.llm.test_words_and_bpe import words_of


@pytest.mark.parametrize("wanted", [0.2, 0.5, 0.8])
def test_signatures_estimate_jaccard(wanted):
    rng = np.random.default_rng(3)
    k, got, n = 280, [], 120
    for _ in range(25):
        common = round(2 * n * wanted / (1 + wanted))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common).astype(np.uint64)])
        s = minhash.signatures(np.repeat([0, 1], n), np.concatenate([a, b]), np.ones(2 * n), 2, k)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - common / (2 * n - common)) < 0.02


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    w1 = rng.gamma(1, 2, 80) + 0.05
    w2 = np.where(rng.random(80) < 0.5, w1, rng.gamma(1, 2, 80) + 0.05)
    got = []
    for _ in range(30):
        e = rng.integers(0, 2**63, 80).astype(np.uint64)
        s = minhash.signatures(np.repeat([0, 1], 80), np.concatenate([e, e]), np.concatenate([w1, w2]), 2, 200)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.02


def test_signature_depends_on_the_set_alone():
    e = np.arange(1, 40, dtype=np.uint64) * np.uint64(7919)
    alone = minhash.signatures(np.zeros(39, int), e, np.ones(39), 1, 60)[0]
    rest = np.arange(1, 500, dtype=np.uint64) * np.uint64(104729)
    both = minhash.signatures(np.concatenate([np.ones(39, int), np.zeros(499, int)]), np.concatenate([e[::-1], rest]), np.ones(538), 2, 60)[1]
    assert np.array_equal(alone, both)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(10, 40)] + [(5, 100), (7, 100), (3, 7), (50, 50)] + [(200, j) for j in range(201, 260)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 10 for i in range(10, 41))
    assert {got[i] for i in (3, 5, 7, 100)} == {3}
    assert {got[i] for i in range(200, 260)} == {200} and 50 not in got
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingles(x):
    w = words_of(x)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Least id of each row's class, by all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(x) for _, x in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        c = find(i)
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))]


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 150]))]
        rows.append((base * 10, " ".join(words)))
        for copy in range(rng.choice([0, 0, 1, 4])):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 2, 6])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((base * 10 + copy + 1, " ".join(changed).upper() if copy == 1 else " ".join(changed)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [minhash.BLOCK, 2])
def test_classes_are_those_of_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = {r.id: r.class_id for r in minhash.classes(docs, block=block).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute(rows), strict=True)}


ODD = [(1, None), (2, ""), (3, "!!"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (6, "a b c d e f"), (6, "other text of six words here"), (7, "a b c d e f")]


def test_defined_results(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = sorted(((r.id, r.class_id, r.stays) for r in minhash.classes(docs).collect()), key=str)
    assert len(got) == len(ODD)
    assert sorted(c for i, c, _ in got if i in (4, 5)) == [4, 4, 4]
    assert sum(s for i, c, s in got if c == 4) == 1
    assert all(s for i, _, s in got if i in (1, 2, 3))
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    left = sorted(map(str, map(tuple, kept.collect())))
    assert left == sorted(map(str, [(1, None), (2, ""), (3, "!!"), (4, "one"), (None, None), (6, "a b c d e f"), (6, "other text of six words here")]))
    assert minhash.dedup(docs.limit(0)).count() == 0


def test_dedup_by_joins_beyond_the_broadcast_bound(spark):
    rows = corpus(30, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted({c for c in brute(rows)})
    assert sorted(r.doc_id for r in minhash.dedup(docs, broadcast=0).collect()) == expected
    assert sorted(r.doc_id for r in minhash.dedup(docs).collect()) == expected


def test_counted_weights(spark):
    rows = [(1, "a b c d e " * 10), (2, "a b c d e " * 9), (3, "a b c d e " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.class_id for r in minhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.id: r.class_id for r in minhash.classes(docs, weights="count").collect()} == {1: 1, 2: 1, 3: 3}


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 900):
        changed = list(base)
        changed[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in minhash.classes(docs, block=128).collect()} == {0}
