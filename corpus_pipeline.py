"""The corpus pipeline: five operators one after the other, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All stages but the last return the columns of documents. A stage's scratch tables go when
the next stage begins, as its result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import bpe, decontamination, language, lines, minhash, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of the stage that ran last.
_SCRATCH: list[str] = []


def _stage(apply: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _SCRATCH:
            store.delete(spark, _SCRATCH.pop())
        with store.noted() as paths:
            out = apply(spark, docs, sf_dir)
        _SCRATCH.extend(paths)
        return out

    return run


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence."""
    return language.keep_accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out; documents with nothing left go."""
    return lines.dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", _stage(identify_language)),
    ("lines", _stage(dedup_lines)),
    ("near", _stage(dedup_near)),
    ("decontamination", _stage(decontaminate)),
    ("tokens", _stage(tokenize)),
]

#: Language posteriors, signatures and byte pair merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: str | None = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = store.scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        if before:
            store.delete(spark, before)
        before, docs = path, spark.read.schema(out.schema).parquet(path)
    return docs
