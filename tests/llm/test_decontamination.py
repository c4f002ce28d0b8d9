from __future__ import annotations

import hashlib

import pytest

from larkspan.llm import decontamination
from tests.llm.test_words_and_bpe import words_of

TEN = "one two three four five six seven eight nine ten"
DOCS = [
    (1, f"Start {TEN} eleven end"),
    (2, "one two three"),
    (3, None),
    (4, ""),
    (5, "... !!"),
    (6, f"{TEN.upper()}; {TEN}"),
    (7, "nothing here of note, at all"),
    (1, f"Start {TEN} eleven end"),
    (None, f"x {TEN}"),
    (8, "é" * 10 + " ü ö"),
]
ITEMS = [(1, TEN + " eleven"), (2, "Two THREE"), (10, TEN), (3, None), (4, "?!"), (2, "two three"), (5, "ü ö"), (None, "nothing here")]
DOC_TYPE = "doc_id long, text string"


def brute(docs, items, n=10):
    out = []
    for i, x in docs:
        w = words_of(x)
        hit, found = set(), set()
        for item, y in items:
            if y is None:
                continue
            v = words_of(y)
            m = min(n, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == v[k : k + m]:
                        hit |= set(range(p, p + m))
                        found |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontamination.BLOCK, 2])
def test_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, DOC_TYPE)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.scan(docs, items, block=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS)


def test_windows_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight nine ten")], DOC_TYPE).coalesce(1)
    items = spark.createDataFrame([(1, TEN)], "item_id long, text string")
    assert decontamination.scan(docs, items).where("contaminated").count() == 0


def test_remove(spark):
    docs = spark.createDataFrame([(*r, "t") for r in DOCS], DOC_TYPE + ", items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontamination.remove(docs, items)
    assert kept.columns == docs.columns
    # the item without an id hits document 7
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5}
    cut = {r.doc_id: r.text for r in decontamination.remove(docs, items, what="span").collect()}
    assert cut[1] == "Start  end" and cut[3] is None and cut[6] == "" and cut[7] == " of note, at all"
    with pytest.raises(ValueError, match="document or span"):
        decontamination.remove(docs, items, what="x")


@pytest.mark.parametrize("block", [decontamination.BLOCK, 5, 1])
def test_cuts_do_not_depend_on_blocks(spark, block):
    docs = spark.createDataFrame([(1, "x1 a b c d e x2"), (2, "c d e, a b c"), (3, "a b"), (4, None)], DOC_TYPE)
    items = spark.createDataFrame([(1, "a b c"), (2, "c d e"), (3, "x2"), (4, "q " * 30)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontamination.remove(docs, items, n=3, what="span", block=block).collect()}
    assert cut == {1: "x1 ", 2: "", 3: "a b", 4: None}
    assert {r.doc_id for r in decontamination.remove(docs, items, n=3, block=block).collect()} == {3, 4}


@pytest.mark.parametrize("block", [3, 7])
def test_an_item_of_many_windows_goes_in_overlapping_pieces(spark, block):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([("long", " ".join(words)), ("short", "w1 W2")], "item_id string, text string")
    pieces = decontamination._pieces(items, "item_id", "text", 4, block).collect()
    assert all(len(p.words.split()) <= block + 3 for p in pieces)
    docs = [(i, " ".join(words[i : i + 4])) for i in range(37)] + [(99, "w1 w2 w4 w5")]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.scan(spark.createDataFrame(docs, DOC_TYPE), items, n=4, block=block).collect()}
    assert all("long" in got[i][1] and got[i][0] == 4 for i in range(37))
    assert got[99] == (2, ["short"])


def test_a_set_of_windows_takes_no_more_than_its_arrays():
    import sys

    windows = decontamination.Windows([(str(i), " ".join(f"word{i * 1000 + k}" for k in range(200))) for i in range(500)], 10)
    (known,) = windows.by_length.values()
    arrays = sum(a.nbytes for a in (known.hashes, known.first, known.start, known.end, known.owner))
    assert len(known.hashes) == 500 * 191 and arrays < 40 * len(known.hashes) and sys.getsizeof(windows.ids) < 10_000


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, DOC_TYPE), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(docs, items).where("n_hit > 0").count() == 0
    assert decontamination.scan(docs.limit(0), items).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 400_000 + TEN)], DOC_TYPE)
    got = decontamination.scan(docs, spark.createDataFrame([(1, TEN)], "item_id long, text string")).first()
    assert got.n_words == 800_010 and got.n_hit == 10
    assert got.spans[0].start == 800_000
