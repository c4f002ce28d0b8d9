"""What all filtering operators have in common: columns of any name, ids of any type, long texts, ties, empty tables."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from larkspan.llm import bpe, decontamination, fingerprint, language, lines, minhash, passages, quality

NAMES = ["__id", "__hash", "__pos", "__later", "__da", "__db", "__kid", "__ka", "__kb", "__declared", "__suffix", "__host", "__prior", "__cuts", "__row", "h", "place", "bands", "row", "node", "items", "spans", "language"]
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf".split()


def benchmark(spark):
    return spark.createDataFrame([(1, "never seen " * 6)], "item_id long, text string")


STAGES = {
    "language": lambda spark, docs: language.keep_accepted(docs),
    "lines": lambda spark, docs: lines.dedup(docs),
    "near": lambda spark, docs: minhash.dedup(docs),
    "decontamination": lambda spark, docs: decontamination.remove(docs, benchmark(spark)),
    "passages": lambda spark, docs: passages.remove(docs),
}


def table(spark, ids):
    long = " ".join(f"{w}{i}" for i in range(4000) for w in PROSE)
    texts = [" ".join(PROSE[k:] + PROSE[:k] + [f"n{k}"]) for k in range(4)] + ["", None, long]
    docs = spark.createDataFrame(list(zip(ids, texts, ["en"] * 7, ["web"] * 7, strict=True)), "doc_id string, text string, lang string, source string")
    return docs.select("*", *(F.lit("x").alias(n) for n in NAMES))


@pytest.mark.parametrize("name", STAGES)
@pytest.mark.parametrize("ids", [list("1234567"), ["b", "a", "c", "d", None, "", "z"]])
def test_columns_of_any_name_are_kept(spark, name, ids):
    if name == "passages" and "a" in ids:
        pytest.skip("passages has integer ids, or strings of digits")
    docs = table(spark, ids)
    got = STAGES[name](spark, docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert STAGES[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["lines", "near"])
def test_of_repeated_rows(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f\ng\nh"), (1, "a b c d e f\ng\nh"), (2, "a b c d e f\ng\nh")], "doc_id long, text string")
    got = [r.doc_id for r in STAGES[name](spark, docs).collect()]
    assert got == ([1] if name == "near" else [1, 1])


def test_reports_ignore_other_columns(spark):
    docs = table(spark, list("1234567"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    n = docs.count()
    assert lines.report(docs).count() == n
    assert decontamination.scan(docs, benchmark(spark)).count() == n
    assert bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == n
    assert minhash.classes(docs).count() == n
    assert language.identify(language.evidence(docs)).count() == n
    assert fingerprint.neighbours(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).count() == n
    assert quality.score(docs, quality.train(docs, labels)).count() == n
