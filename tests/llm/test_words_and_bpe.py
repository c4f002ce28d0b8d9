from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspan.llm import bpe, text

PATH = P.path("byte_bpe_50k.tiktoken")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = st.lists(st.text(alphabet=st.sampled_from("aBz09 _-.\né中🙂İ\x00'"), max_size=40), min_size=1, max_size=8)


def words_of(x):
    return WORD.findall((x or "").translate(FOLD))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_the_pattern(texts):
    got = text.Words(pa.array(texts))
    for d, x in enumerate(texts):
        a, b = got.first[d], got.first[d + 1]
        assert [got.lower[s:e].tobytes().decode() for s, e in zip(got.start[a:b], got.end[a:b], strict=True)] == words_of(x)


def test_hashes_follow_words():
    got = text.Words(pa.array(["alpha beta", None, "", "BETA alpha", "ab b a"]))
    h = dict(zip(["alpha", "beta"], got.hashes[:2], strict=True))
    assert got.hashes[2] == h["beta"] and got.hashes[3] == h["alpha"]
    assert len(set(got.hashes[4:].tolist())) == 3


def test_ngrams_of_short_texts_are_one():
    grams, at = text.ngrams(text.Words(pa.array(["a b c d e f", "a b", "", "a b"])), 5)
    assert np.diff(at).tolist() == [2, 1, 0, 1] and grams[2] == grams[3]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * n for n in (10, 0, 50, 3, 3)])], ["a", "b"])
    parts = list(text.slices(iter([batch]), 1, 12))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(5))
    assert max(p.num_rows for p in parts) < 5


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Encoding.load(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from("abethn 'sd\n\t-é中🙂"), max_size=300))
def test_same_ids_as_the_library(both, value):
    own, library = both
    ids = own.encode(value)
    assert ids == library.encode_ordinary(value)
    assert own.decode(ids) == value.encode()


@pytest.mark.parametrize("value", ["a" * 20_000, "-" * 10_000, " " * 5_000, "the" * 4_000, "<|endoftext|>", "\x00\x01", ""])
def test_long_pieces_and_special_strings(both, value):
    own, library = both
    assert own.encode(value) == library.encode_ordinary(value)


def test_joining_is_associative(both):
    own, _ = both
    raw = b"internationalisation of thththings"
    for i in range(1, len(raw) - 1):
        a, b = own._tree(raw[:i]), own._tree(raw[i:])
        assert b"".join(own.join(a, b)) == raw
        assert own.join(a, b) == own._tree(raw)


def test_round_trip_table(spark, both):
    _, library = both
    rows = [(1, "Hello world's  9 lives\n"), (2, None), (3, ""), (1, "Hello world's  9 lives\n"), (None, "zwölf 中文")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    expected = []
    for i, x in rows:
        ids = library.encode_ordinary(x or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "déjà vu, 中文 🙂"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {1: "déjà vu, 中文 🙂", 2: ""}
    assert {r.doc_id: len(r.ids) for r in bpe.round_trip(docs, PATH, P.PATTERN, with_ids=True).collect()}[2] == 0
