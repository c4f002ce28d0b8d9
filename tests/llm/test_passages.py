from __future__ import annotations

import random

import numpy as np
import pytest

from larkspan.llm import passages


def test_compact_windows_are_the_cartesian_tree(seed=1):
    rng = np.random.default_rng(seed)
    for trial in range(60):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 5))])
        h = rng.integers(0, 2**39 if trial % 2 else 9, first[-1]).astype(np.uint64) << np.uint64(24)
        width = int(rng.integers(1, 12))
        got = set(zip(*(x.tolist() for x in passages.compact_windows(h, first, width, 1000)), strict=True))
        expected = set()
        for d in range(5):
            for c in range(first[d], first[d + 1]):
                low = high = c
                while low > first[d] and h[low - 1] > h[c]:
                    low -= 1
                while high < first[d + 1] - 1 and h[high + 1] >= h[c]:
                    high += 1
                if high - low + 1 >= width:
                    expected.add((c, low, high))
        assert got == expected


def corpus():
    rng = random.Random(3)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]

    shared, long = words(70), words(300)
    near = list(shared)
    near[35] = "changed"
    rows = {
        1: words(40) + shared + words(30),
        2: words(10) + shared,
        3: words(200),
        4: near + words(90),
        5: words(20) + shared[:30] + words(50),
        6: long,
        7: words(5) + long[:150] + ["in", "serted"] + long[150:],
        8: ["same"] * 200,
        9: words(3) + ["same"] * 120,
    }
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, " ".join(w), "x") for i, w in corpus().items()] + [(None, " ".join(corpus()[1]), "x"), (10, None, "x"), (11, "", "x"), (2, " ".join(corpus()[2]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    return docs, passages.passages(docs).collect()


def test_planted_passages_are_found_and_no_others(found):
    _, got = found
    assert {(r.id, r.first_id) for r in got} == {(2, 1), (4, 1), (7, 6), (9, 8)}
    spans = {r.id: (r.start, r.end) for r in got if r.id in (2, 7, 9)}
    assert spans[2] == (10, 80)
    assert spans[9][0] <= 3 and spans[9][1] >= 120
    near = [r for r in got if r.id == 4]
    assert min(r.start for r in near) == 0 and max(r.end for r in near) >= 65
    assert {r.first_start for r in got if r.id == 2} == {40}


def test_members_and_removal(spark, found):
    docs, _ = found
    whole = passages.passages(docs)
    assert {r.id for r in passages.members(whole).collect()} == {1, 2, 4, 6, 7, 8, 9}
    left = passages.remove(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[2].split() == corpus()[2][:10]
    assert texts[1] == " ".join(corpus()[1]) and texts[10] is None and texts[3] == " ".join(corpus()[3])


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert passages.passages(docs).count() == 0
    assert passages.passages(docs.limit(0)).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(1, " ".join(rows[1])), (5, " ".join(rows[3])), (5, " ".join(rows[2]))], "doc_id long, text string")
    got = passages.passages(docs).collect()
    assert [(r.id, r.start, r.end, r.first_id) for r in got] == [(5, 10, 80, 1)]


def test_copies_behind_a_document_that_shares_a_phrase_only(spark):
    rng = random.Random(5)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(50000)}" for _ in range(n)]

    rows, place = [], {}
    for k in range(24):
        passage = words(55)
        phrase = passage[8:48] if k % 2 else passage[:44]
        rows.append((k, " ".join(words(20) + phrase + words(20))))
        for copy in (1, 2, 3):
            before = words(15 + copy)
            place[100 * copy + k] = len(before)
            rows.append((100 * copy + k, " ".join(before + passage + words(30))))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.start - place[r.id], r.end - place[r.id]) for r in got} == {(100 * copy + k, 0, 55) for copy in (2, 3) for k in range(24)}
    assert all(r.id % 100 == r.first_id % 100 and r.first_id >= 100 for r in got)


def test_copy_of_a_later_place_of_the_least_document(spark):
    rng = random.Random(6)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(50000)}" for _ in range(n)]

    rows = []
    for k in range(12):
        passage = words(55)
        rows.append((k, " ".join(words(10) + passage[5:45] + words(300) + passage + words(10))))
        rows.append((100 + k, " ".join(words(20) + passage)))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.start, r.end, r.first_id, r.first_start) for r in got} == {(100 + k, 20, 75, k, 350) for k in range(12)}


def test_pieces_in_an_earlier_document_hide_no_exact_copy(spark):
    rng = random.Random(7)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(50000)}" for _ in range(n)]

    rows = []
    for k in range(60):
        passage = words(80)
        pieces = [w for i in range(0, 80, 24) for w in passage[i : i + 24] + words(8)]
        rows += [(k, " ".join(pieces)), (100 + k, " ".join(words(12) + passage + words(9))), (200 + k, " ".join(words(30) + passage + words(20)))]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.start, r.end, r.first_id, r.first_start) for r in got if r.first_id >= 100} == {(200 + k, 30, 110, 100 + k, 12) for k in range(60)}


def test_near_copies_of_passages_are_found(spark):
    """Recall of windows of 60 words of which every 21st is another (a similarity of about 0.62 to 0.9 by shingles)."""
    rng = random.Random(8)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(50000)}" for _ in range(n)]

    rows, near = [], []
    for k in range(150):
        passage = words(150)
        changed = [f"x{k}" if i == 75 else w for i, w in enumerate(passage)]
        rows += [(k, " ".join(words(40) + passage + words(40))), (1000 + k, " ".join(words(25) + changed + words(60)))]
        near.append(1000 + k)
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {d: set() for d in near}
    for r in got:
        assert r.first_id == r.id - 1000
        covered[r.id] |= set(range(r.start, r.end))
    assert sum(len(c & set(range(25, 175))) for c in covered.values()) >= 0.95 * 150 * 150


def test_columns_of_any_name_and_string_ids(spark):
    rows = [(str(i), " ".join(w), 1, 2, 3) for i, w in corpus().items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __id int, __cuts int, cuts int")
    left = passages.remove(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()}["2"].split() == corpus()[2][:10]
