"""The registered queries against SQL or brute force, and the pipeline against its parts."""

from __future__ import annotations

import pytest

from larkspan.llm import queries
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, con, name):
    oracle.same(spark, con, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_for_each_operator(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


def test_near_duplicates_of_documents(spark):
    from tests.llm.test_minhash import brute

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op8_minhash(spark, oracle.SF).collect()}
    assert got == {d: c for (d, _), c in zip(docs, brute(docs), strict=True)}


def test_passages_cover_exact_repeats(spark):
    from tests.llm.test_words_and_bpe import words_of

    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    first: dict[tuple, int] = {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - 49):
            first.setdefault(tuple(docs[d][i : i + 50]), d)
    spans: dict[int, set[int]] = {}
    for r in queries.op4_passages(spark, oracle.SF).collect():
        if r.doc_id != r.first_doc_id:
            spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    lost = [(d, i) for d, w in docs.items() for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] != d and not set(range(i, i + 50)) <= spans.get(d, set())]
    assert lost == []


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_decontamination import brute as leaks
    from tests.llm.test_lines import brute as cut
    from tests.llm.test_minhash import brute as near

    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in pipeline.identify_language(spark, docs, oracle.SF).collect()]
    judged = {r.doc_id: r.accepted for r in queries.op3_language(spark, oracle.SF).collect()}
    assert {d for d, _ in rows} == {d for d, ok in judged.items() if ok}
    rows = [(d, x) for d, n, gone, x in cut(rows) if not n or gone < n]
    rows = [r for r, c in zip(rows, near(rows), strict=True) if r[0] == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{oracle.SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in leaks(rows, items) if not r[5]}
    got = pipeline.run(spark, oracle.SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == clean
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near", "decontamination", "tokens"]
