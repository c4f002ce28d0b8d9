from __future__ import annotations

import itertools
from collections import Counter

import pytest

from larkspan.llm import audit, queries
from tests import oracle


def fails(text, later):
    words = text.encode().split()
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if later:
        out.add("E")
    return out


def brute(docs, labels):
    """Every order applied to every document, one after the other."""
    marks = {}
    for i, good, toxic in labels:
        old = marks.get(i, (False, False))
        marks[i] = (old[0] or good == 1, old[1] or toxic == 1)
    marked = []
    for i, text, part in docs:
        text, part = text or "", part or ""
        later = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        marked.append((part, fails(text, later), *(marks.get(i, (False, False)) if i is not None else (False, False))))
    rows = []
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        shapley = Counter()
        made = []
        for order in itertools.permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                lost = [m for m in alive if f in m[1]]
                failing = [m for m in own if f in m[1]]
                alive = [m for m in alive if f not in m[1]]
                shapley[f] += len(lost)
                made.append((f, (part, "".join(order), step, len(alive), len(lost), len(failing) - len(lost), sum(m[1] == {f} for m in own), sum(m[2] for m in lost), sum(m[3] for m in lost))))
        rows += [(*row, shapley[f]) for f, row in made]
    return sorted(rows)


LONG = " ".join(f"w{i}" for i in range(220))
DOCS = [
    (5, "same text", "a"), (3, "same text", "b"), (3, "same text", "a"), (9, "same text", None), (None, "same text", "a"), (None, None, ""), (7, None, "a"), (8, "", "c"),
    (10, LONG, "a"), (11, LONG, "a"), (12, LONG + " #", "a"), (13, "x " * 300, "b"), (14, "ABC " + LONG, "b"), (15, "É" * 50 + "A", "b"), (2, "SAME TEXT", "b"), (1, LONG.replace(" ", "\u00a0"), "c"),
]
LABELS = [(5, 1, 0), (3, 0, 1), (3, 1, None), (10, 1, 0), (11, None, 1), (None, 1, 1), (99, 1, 1), (15, 1, 1)]


def frames(spark, docs=DOCS, labels=LABELS):
    return (
        spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, mask int, n int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_report_against_brute_force(spark):
    docs, labels = frames(spark)
    assert sorted(map(tuple, audit.report(docs.repartition(3), labels).collect())) == brute(DOCS, LABELS)


@pytest.mark.parametrize("held", [1, 200, 1 << 20])
def test_masks_do_not_depend_on_collisions_or_pieces(spark, held):
    docs = DOCS * 3 + [(100 + i, f"text {i % 7}", "d") for i in range(200)]
    frame, _ = frames(spark, docs)

    def counted(**options):
        out = Counter()
        for r in audit.masks(frame.repartition(5), held=held, **options).collect():
            out[r["id"], r["part"], r["mask"]] += r["n"]
        return out

    plain = counted()
    assert counted(hashed=lambda raw: 1) == plain  # one chain of all texts
    assert counted(hashed=len) == plain
    expected = Counter()
    for i, text, part in docs:
        later = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        failed = fails(text or "", later)
        expected[i, part or "", sum(1 << "ABCDE".index(f) for f in failed)] += 1
    assert plain == expected


def test_a_text_of_a_third_of_all_rows_is_met_once_for_each_task(spark):
    """What the chains of one task send on: a text's least id; duplicates go without a text, spread by id."""
    rows = [(i, "s", "hot" if i % 3 == 0 else f"own {i}") for i in range(900)]
    sent = list(audit._own_chains(iter(rows), audit.xxhash.xxh64_intdigest, 1 << 20))
    assert sum(raw == b"hot" for _, (raw, _) in sent) == 1
    assert len({key for key, (raw, _) in sent if raw is None}) == 299
    assert len(sent) == 900


def test_ids_of_text_long_texts_and_none(spark):
    docs = spark.createDataFrame([("b", "t " * 300_000, "s"), ("a", "t " * 300_000, "s"), ("c", "u", "s")], "doc_id string, text string, source string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in audit.report(docs, labels).collect()}
    assert len(got) == 600
    assert got["EABCD", 1].removed == 1 and got["EABCD", 1].good_lost == 1 and got["ABCDE", 2].removed == 2
    assert audit.report(docs.limit(0), labels).count() == 0
    assert audit.report(docs, labels.limit(0)).where("good_lost > 0").count() == 0


def test_registered_query_is_the_sql(spark):
    oracle.same(spark, oracle.connect(), queries.op11_audit, queries.OP11_SQL)
