from __future__ import annotations

import random

import pytest

from larkspan.llm import language
from tests.oracle import SF

PARTS = {"en": ["the", "ing", "tion", "th", "er", "and"], "de": ["der", "ung", "sch", "ich", "ein", "zu"], "fr": ["eau", "le", "que", "ment", "ou", "dé"]}


def texts(n, lang, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k, (lang, host) in enumerate((("en", "a.example.com"), ("de", "b.example.de"), ("fr", "c.example.fr"))):
        rows += [(k * 1000 + i, t, lang, host) for i, t in enumerate(texts(120, lang, k))]
    wrong = [(9000 + i, t, "en", "b.example.de") for i, t in enumerate(texts(10, "de", 7))]
    odd = [(9100, None, "de", "b.example.de"), (9101, "", None, "c.example.fr"), (9102, texts(1, "fr", 8)[0], None, None), (None, texts(1, "en", 9)[0], "EN-us", "a.example.com"), (9103, "", None, None)]
    return spark.createDataFrame(rows + wrong + odd, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("small", [language.SMALL, 0])
def test_evidence_is_fused(docs, small, monkeypatch):
    monkeypatch.setattr(language, "SMALL", small)
    got = {r.id: r for r in language.identify(language.evidence(docs)).collect()}
    assert len(got) == docs.count()
    assert all(got[k * 1000 + i].language == lang for k, lang in enumerate(("en", "de", "fr")) for i in range(120))
    assert all(got[9000 + i].language == "de" for i in range(10))
    assert got[9100].language == "de" and got[9101].language == "fr" and got[9102].language == "fr" and got[None].language == "en"
    assert all(r.accepted for r in got.values() if r.id != 9103)


def test_stage_keeps_clean_documents_and_columns(docs):
    kept = language.keep_accepted(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert left >= {r.doc_id for r in docs.collect()} - {9103}
    only = language.keep_accepted(docs, accept=["de"])
    assert {r.doc_id for r in only.collect()} >= {1000 + i for i in range(120)}
    assert not {r.doc_id for r in only.collect()} & set(range(120))


def test_without_declared_languages(docs):
    bare = docs.drop("lang", "source")
    got = language.identify(language.evidence(bare, declared=None, host=None))
    assert {(r.language, r.accepted) for r in got.collect()} == {(None, True)}
    assert language.identify(language.evidence(docs.limit(0))).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    facts = language.page_evidence(pages)
    truth = {r.page_id: r.l for r in pages.selectExpr("page_id", "regexp_extract(html, 'lang=\"([a-z]+)\"', 1) l").collect()}
    got = language.identify(facts).collect()
    assert sum(r.language == truth[r.id] for r in got) >= 0.97 * len(truth)
    first = facts.first()
    assert first.suffix in ("com", "net", "org") and first.domain.count(".") == 1


def test_text_alone_is_right_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(language.evidence(docs)).collect()
    sure = [r for r in got if r.text_language is not None]
    assert sum(r.text_language == r.declared for r in sure) >= 0.95 * len(sure)


def test_every_declared_language_keeps_its_model(spark):
    rows = [(i, t, "en", "a.example.com") for i, t in enumerate(texts(400, "en", 1))] + [(1000 + i, t, "de", "b.example.de") for i, t in enumerate(texts(8, "de", 2))] + [(2000 + i, t, "fr", "c.example.fr") for i, t in enumerate(texts(6, "fr", 3))]
    facts = language.evidence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    (model,) = language.fit_text(facts, fit_rows=60)
    assert model.languages == ["de", "en", "fr", language.OTHER]
    assert all(r.language == r.declared for r in language.identify(facts, fit_rows=60).collect())
    assert [m.languages for m in language.fit_text(facts, block=2)] == [["de", "en"], ["fr", language.OTHER]]
    assert language.fit_text(facts.limit(0)) == []


@pytest.mark.parametrize("block", [1, 2])
def test_results_do_not_depend_on_blocks(docs, block):
    key = lambda r: (str(r.id), r.language, round(r.confidence, 9), r.text_language, r.accepted)
    facts = language.evidence(docs)
    assert sorted(map(key, language.identify(facts, block=block).collect())) == sorted(map(key, language.identify(facts).collect()))
    kept = lambda **o: sorted(str(r.doc_id) for r in language.keep_accepted(docs, **o).collect())
    assert kept(block=block) == kept()


def brute(rows, model):
    """Posteriors by loops: each vote counted again for each row, without the row's own."""
    import math

    import pyarrow as pa

    names = model.languages
    fits = model.likelihood(pa.array([r["text"] for r in rows], pa.string())).tolist()
    votes = [[k for k, x in enumerate(f) if x == 0.0] for f in fits]
    votes = [v[0] if len(v) == 1 else None for v in votes]
    out = {}
    for i, r in enumerate(rows):
        def counts(field, value, i=i):
            return [sum(votes[j] == k for j, o in enumerate(rows) if j != i and o[field] == value) for k in range(len(names))]

        every = [sum(v == k for j, v in enumerate(votes) if j != i) + 1 for k in range(len(names))]
        prior = [x / sum(every) for x in every]
        for field in ("domain", "host"):
            if r[field] is None or (field == "host" and r["host"] == r["domain"]):
                continue
            own = counts(field, r[field])
            prior = [(x + language.LEAN * p) / (sum(own) + language.LEAN) for x, p in zip(own, prior, strict=True)]
        score = [f + math.log(p) for f, p in zip(fits[i], prior, strict=True)]
        for field in ("declared", "suffix"):
            if r[field] is None:
                continue
            # values that any vote was counted for, this row's among them
            values = len({o[field] for j, o in enumerate(rows) if o[field] is not None and votes[j] is not None})
            own = counts(field, r[field])
            for k in range(len(names)):
                whole = sum(votes[j] == k for j, o in enumerate(rows) if j != i and o[field] is not None)
                score[k] += math.log((own[k] + language.CHANNEL) / (whole + language.CHANNEL * (values + 1)))
        top = max(score)
        weight = [math.exp(x - top) for x in score]
        best = max(range(len(names)), key=lambda k: (score[k], -k))
        out[r["id"]] = names[best], max(weight) / sum(weight), None if votes[i] is None else names[votes[i]]
    return out


def test_posteriors_against_loops(spark):
    rng = random.Random(4)
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de", "fr"])
        words = texts(1, lang, 100 + i)[0].split()[: rng.choice([0, 1, 2, 30])]
        host = rng.choice(["www.example.de", "m.example.de", "example.de", "a.test.fr", None])
        rows.append((i, " ".join(words), rng.choice([lang, "en", None]), host, rng.choice(["de", "fr", None])))
    frame = spark.createDataFrame(rows, "id int, text string, lang string, host string, tld string")
    facts = language.evidence(frame, id_col="id", declared="lang", host="host", suffix="tld")
    (model,) = language.fit_text(facts)
    expected = brute([r.asDict() for r in facts.collect()], model)
    for r in language.identify(facts).collect():
        best, share, text_says = expected[r.id]
        assert (r.text_language, round(r.confidence, 9)) == (text_says, round(share, 9)) and r.language == best


def test_texts_in_no_declared_language_are_rejected(spark):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = ["".join(chr(rng.randrange(0x410, 0x450)) if rng.random() < 0.85 else " " for _ in range(400)) for _ in range(8)]
    foreign += ["".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200)) for _ in range(8)]
    junk = ["".join(rng.choice("0123456789abcdef+/=;:{}") for _ in range(600)) for _ in range(8)]
    rows = [(10**6 + i, x, None, "src1", len(x)) for i, x in enumerate(foreign + junk)]
    mixed = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in language.keep_accepted(mixed).select("doc_id").collect()}
    assert not kept & {r[0] for r in rows}
    clean = {r.doc_id for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id").collect()}
    assert clean <= kept
    # of the documents as they are, nearly all are in a declared language
    assert len(kept) >= 0.97 * docs.count()
