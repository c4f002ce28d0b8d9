from __future__ import annotations

import random

from larkspan.llm import lines


def brute(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        d, x = rows[i]
        parts = (x or "").split("\n") if x is not None else []
        gone = set()
        for k in range(len(parts) - 2):
            window = tuple(p.strip(" ") for p in parts[k : k + 3])
            if any(window):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        out.append((d, len(parts), len(gone), None if x is None else "\n".join(p for k, p in enumerate(parts) if k not in gone)))
    return sorted(out, key=str)


def corpus(n=80):
    rng = random.Random(4)
    pool = ["", "alpha", " alpha ", "beta", "gamma", "delta", "e", "f"]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 9])))) for i in range(n)] + [(900, None), (None, "alpha\nbeta\ngamma"), (901, "\n\n\n\n")]


def test_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, a string")
    got = lines.report(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_dedup_drops_what_is_left_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "x\na\nb\nc\ny"), (4, ""), (5, None), (6, "a\nb")], "doc_id long, text string")
    kept = lines.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a\nb\nc", 3: "x\ny", 4: "", 5: None, 6: "a\nb"}


def test_repeats_within_one_document(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na\na")], "doc_id long, text string")
    assert lines.dedup(docs).first().text == "a"


def test_equal_rows_are_one_occurrence(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "z\na\nb\nc")], "doc_id long, text string")
    got = sorted(r.text for r in lines.dedup(docs).collect())
    assert len(got) >= 2 and lines.dedup(docs.limit(0)).count() == 0
