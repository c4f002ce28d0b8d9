"""Calls of a language model over rows: concurrent within a task, bounded in number and time, and their answers checked.

A model is a function of a prompt that runs in the Python workers. It may fail, hang, or say what isn't so; a row's answer then is what the rules say, with
the reason why. Models are never needed: without one all rows have the rules' answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import wait as wait_for
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import scoring
from larkspan.operators import explain, search

Model = Callable[[str], str]

#: Calls of one task at a time, attempts for each row, seconds of one attempt, characters of an answer.
CONCURRENCY, ATTEMPTS, SECONDS, LONGEST = 8, 2, 20.0, 600
# Fixed value: what is added to the prompt of a second attempt.
AGAIN = "（前回は規則に反していました。JSONの値だけを使い、200字以内の文章だけを返してください）"

_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")


@dataclass(frozen=True)
class Limits:
    concurrency: int = CONCURRENCY
    attempts: int = ATTEMPTS
    seconds: float = SECONDS
    longest: int = LONGEST
    #: What a further attempt adds to the prompt.
    again: str = AGAIN


def numbers(said: str) -> set[str]:
    """The numbers in a text, in any width of digits."""
    return {x.lstrip("0") or "0" for x in _NUMBER.findall(unicodedata.normalize("NFKC", said))}


def honest(answer: object, prompt: str, longest: int = LONGEST) -> str | None:
    """The answer, trimmed, if it is a text of some length that names no number that the prompt doesn't; else null."""
    if not isinstance(answer, str):
        return None
    plain = re.sub(r"(?is)<think>.*?(?:</think>|\Z)", "", answer).strip()
    return plain if plain and len(plain) <= longest and numbers(plain) <= numbers(prompt) else None


def ask(prompts: list[str], model: Model, limits: Limits = Limits(), check: Callable[[object, str], str | None] | None = None) -> list[tuple[str | None, int]]:
    """An answer that passes the check, or null, and the attempts made, for each prompt.

    As many calls run at once as ``concurrency`` says. One that takes longer than its seconds counts as failed; its thread is left to end by itself.
    """
    ok = check or (lambda a, p: honest(a, p, limits.longest))
    out: list[tuple[str | None, int]] = [(None, 0)] * len(prompts)
    todo = list(range(len(prompts)))
    for attempt in range(1, limits.attempts + 1):
        failed = []
        for start in range(0, len(todo), limits.concurrency):
            now = todo[start : start + limits.concurrency]
            pool = ThreadPoolExecutor(len(now))
            calls: dict[int, Future] = {i: pool.submit(model, prompts[i] if attempt == 1 or not limits.again else f"{prompts[i]}\n\n{limits.again}") for i in now}
            wait_for(calls.values(), timeout=limits.seconds)
            pool.shutdown(wait=False, cancel_futures=True)
            for i, call in calls.items():
                said = call.result() if call.done() and not call.cancelled() and call.exception() is None else None
                answer = ok(said, prompts[i])
                out[i] = answer, attempt
                if answer is None:
                    failed.append(i)
        todo = failed
    return out


Check = Callable[[object, str], str | None]


def answers(rows: DataFrame, key: str, prompt: str, model: Model | None, *, allowed: str | None = None, limits: Limits = Limits(), check: Check | None = None) -> DataFrame:
    """key, reply, source and attempts: ``llm``, or why there is no reply: ``ai_unavailable``, ``budget_exhausted`` (rows that aren't ``allowed``), ``llm_failed``."""
    may = F.lit(True) if allowed is None else F.coalesce(F.col(allowed), F.lit(False))
    view = rows.select(key, F.coalesce(F.col(prompt), F.lit("")).alias("prompt"), may.alias("may"))
    none = F.lit(None).cast("string")
    if model is None:
        return view.select(key, none.alias("reply"), F.when(F.col("may"), "ai_unavailable").otherwise("budget_exhausted").alias("source"), F.lit(0).alias("attempts"))
    field = view.schema[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = ask(pdf["prompt"].tolist(), model, limits, check)
            yield pd.DataFrame({key: pdf[key], "reply": [a for a, _ in found], "attempts": [n for _, n in found]})

    schema = T.StructType([T.StructField(field.name, field.dataType), T.StructField("reply", T.StringType()), T.StructField("attempts", T.IntegerType())])
    called = view.where("may").select(key, "prompt").mapInPandas(run, schema)
    called = called.select(key, "reply", F.when(F.col("reply").isNull(), "llm_failed").otherwise("llm").alias("source"), "attempts")
    return called.unionByName(view.where("not may").select(key, none.alias("reply"), F.lit("budget_exhausted").alias("source"), F.lit(0).alias("attempts")))


def facts(asked: DataFrame, shown: DataFrame) -> DataFrame:
    """req_id and prompt: what an explanation may say of each request's result, as JSON, and no more."""
    label = F.coalesce(*(F.when(F.col("tier") == k, v) for k, v in scoring.TIER_LABELS.items()))
    one = F.struct(
        F.col("rank").alias("rank"), F.col("name").alias("名前"), F.col("ward").alias("所在地"), F.col("minutes").alias("通学分"), label.alias("合格の見込み"), F.col("gap").alias("目安点との差"), F.col("matched").alias("一致した部活"),
        F.col("designation").alias("指定"), (F.col("selection_note") if "selection_note" in shown.columns else F.lit(None).cast("string")).alias("注意書き"),
    )
    listed = shown.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("rank")).alias("学校"), F.count("*").alias("n"))
    said = search.students(asked).withColumn("said", explain.conditions(F.col("student"))).join(listed, "req_id", "left")
    told = F.struct(
        F.col("said").alias("条件"), F.coalesce("n", F.lit(0)).alias("件数"), F.when(F.col("student.score").isNull(), "なし（通学時間順）").otherwise("あり").alias("成績判定"), F.coalesce("student.rough", F.lit(False)).alias("概算"), F.col("学校"),
    )
    return said.select("req_id", F.to_json(told).alias("prompt"))


def explained(asked: DataFrame, shown: DataFrame, model: Model | None, *, allowed: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """req_id, text, source and attempts: the model's explanation of each result, or the template with the reason. ``allowed``: req_id and whether a call is."""
    prompts = facts(asked, shown)
    if allowed is not None:
        prompts = prompts.join(allowed.select("req_id", "allowed"), "req_id", "left")
    told = answers(prompts, "req_id", "prompt", model, allowed=None if allowed is None else "allowed", limits=limits)
    template = explain.summaries(asked, shown).withColumnRenamed("text", "template")
    joined = template.join(told, "req_id")
    return joined.select("req_id", F.coalesce("reply", "template").alias("text"), F.when(F.col("source") == "llm", "llm").otherwise(F.concat(F.lit("template("), "source", F.lit(")"))).alias("source"), "attempts")
