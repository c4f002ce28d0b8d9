from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from larkspan.operators import model
from larkspan.plans import search_queries
from tests.oracle import SF


def test_answers_are_checked():
    facts = '{"通学分": 35, "差": -12, "比": 1.50, "名": "第１高校"}'
    assert model.honest(" 通学３５分です。 ", facts) == "通学３５分です。"
    assert model.honest("<think>99</think>35分", facts) == "35分" and model.honest("第1高校は1.50倍、012点", facts) is not None
    for bad in ("36分です", "", "  ", None, 35, "x" * 601, "<think>never ends 35", "1.5"):
        assert model.honest(bad, facts) is None


def test_calls_run_at_once_and_hanging_ones_are_given_up():
    running, most, lock = [0], [0], threading.Lock()
    release = threading.Event()

    def slow(prompt):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        if "hang" in prompt:
            release.wait(20)
        else:
            time.sleep(0.05)
        with lock:
            running[0] -= 1
        return "ok"

    start = time.time()
    got = model.ask(["a", "hang", *"bcdefgh"], slow, model.Limits(concurrency=4, attempts=2, seconds=0.6))
    release.set()
    assert time.time() - start < 5 and 2 <= most[0] <= 5
    assert got == [("ok", 1), (None, 2), *[("ok", 1)] * 7]


def test_a_second_attempt_is_told_why():
    seen = []

    def learns(prompt):
        seen.append(prompt)
        return "7校" if model.AGAIN in prompt else "9校"

    assert model.ask(["7"], learns) == [("7校", 2)] and seen == ["7", f"7\n\n{model.AGAIN}"]
    assert model.ask(["8"], learns) == [(None, 2)] and model.ask([], learns) == []


def test_sources(spark):
    rows = spark.createDataFrame([(1, "1", True), (2, "2", False), (3, "3", None), (4, None, True)], "k int, p string, may boolean")
    got = {r.k: (r.reply, r.source, r.attempts) for r in model.answers(rows, "k", "p", lambda p: f"{p}!" if p else "", allowed="may").collect()}
    assert got == {1: ("1!", "llm", 1), 2: (None, "budget_exhausted", 0), 3: (None, "budget_exhausted", 0), 4: (None, "llm_failed", 2)}
    got = {r.k: r.source for r in model.answers(rows, "k", "p", None, allowed="may").collect()}
    assert got == {1: "ai_unavailable", 2: "budget_exhausted", 3: "budget_exhausted", 4: "ai_unavailable"}


def _raises(prompt):
    raise RuntimeError("down")


@pytest.mark.parametrize(("stub", "source"), [(None, "ai_unavailable"), (_raises, "llm_failed"), (lambda p: "合格率は98765％です", "llm_failed"), (lambda p: "よ" * 700, "llm_failed"), (lambda p: 5, "llm_failed")])
def test_failing_and_lying_models_give_the_template(spark, stub, source):
    from larkspan.operators import explain

    asked = search_queries.requests(spark, SF).where("req_id < 12")
    shown = search_queries._run(spark, SF, asked)
    told = {r.req_id: (r.text, r.source) for r in model.explained(asked, shown, stub).collect()}
    plain = {r.req_id: r.text for r in explain.summaries(asked, shown).collect()}
    assert told == {k: (v, f"template({source})") for k, v in plain.items()} and len(told) > 3


def test_facts_hold_what_may_be_said(spark):
    asked = search_queries.requests(spark, SF).where("req_id < 40")
    shown = search_queries._run(spark, SF, asked)
    keys = F.json_object_keys("prompt")
    rows = model.facts(asked, shown).select("req_id", keys.alias("keys"), F.get_json_object("prompt", "$.件数").cast("int").alias("n"), F.get_json_object("prompt", "$.学校[0].名前").alias("first")).collect()
    counts = {r.req_id: r["count"] for r in shown.groupBy("req_id").count().collect()}
    assert all(r.n == counts.get(r.req_id, 0) and (r.first is not None) == (r.n > 0) and "match_score" not in r["keys"] for r in rows) and len(rows) == asked.count()
