from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import chat, queries
from tests import oracle

TEXTS = st.text(alphabet="\\#</turn>: \nnA.é", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(TEXTS, st.sampled_from(["user", "assistant", "User", "a_1"])), st.one_of(TEXTS, st.just(queries._CONTROLS))), max_size=6))
def test_turns_are_read_back(turns):
    formatted = [chat.turn(role, value) for role, value in turns]
    assert list(chat.parse("".join(x for x, _, _ in formatted))) == turns
    for (block, start, end), (_, value) in zip(formatted, turns, strict=True):
        assert chat.unescape(block[start:end]) == value


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_no_control_string_stays_in_an_escaped_text(value):
    escaped = chat.escape(value)
    assert "</turn>" not in escaped and "###" not in escaped and chat.unescape(escaped) == value


def folded(events):
    """One conversation after the other, event by event, by a list of live messages."""
    order = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}
    live = {}
    first = lambda x: (x is not None, x if x is not None else 0)
    for conv, seq, message, kind, role, text in sorted((e for e in events if (e[3] or "message") in order), key=lambda e: (first(e[0]), first(e[1]), order[e[3] or "message"], str(e[4]), str(e[5]))):
        kind = kind or "message"
        own = live.setdefault(conv, [])
        at = max((i for i, m in enumerate(own) if m[0] == message), default=None)
        if kind == "message" or at is None:
            own.append([message, seq, role or "", text or ""])
        elif kind == "delta":
            own[at][3] += text or ""
        else:
            own[at][3] = text or ""
            own[:] = [m for i, m in enumerate(own) if i <= at or m[1] <= own[at][1] or m[1] >= seq]
    return {conv: [(m[2], m[3]) for m in own] for conv, own in live.items() if own}


def digests(conversations):
    out = {}
    for conv, turns in conversations.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(chat.turn(r, t)[0]) for r, t in turns),
        )
    return out


LOG = "conv_id long, seq long, message long, kind string, role string, text string, low string, `range` int"


def logged(seed, n_conv, n_events):
    """Messages that are streamed, edited and generated anew. A message that an edit ended is not named again."""
    rng = random.Random(seed)
    out = []
    for conv in range(n_conv):
        live, seq, new = [], 0, 0
        for _ in range(rng.randrange(n_events)):
            seq += rng.randint(1, 3)
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate"]) if live else "message"
            if kind == "message":
                live.append(new)
                out.append((conv, seq, new, rng.choice(["message", None]), rng.choice(["user", "assistant"]), rng.choice(["", None, "hello", queries._CONTROLS])))
                new += 1
                continue
            target = rng.choice(live[-3:])
            out.append((conv, seq, target, kind, None, rng.choice([None, f" piece {seq}"])))
            if kind != "delta":
                live = live[: live.index(target) + 1]
    return out


def read(spark, events, parts=3, **options):
    log = spark.createDataFrame([(*e, "x", 1) for e in events], LOG).repartition(parts)
    return {r.conv: tuple(r)[1:] for r in chat.read_back(chat.render(chat.fold(log), **options)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_logs_against_a_list_of_live_messages(spark, seed):
    events = logged(seed, 60, 40)
    random.Random(seed).shuffle(events)
    expected = digests(folded(events))
    assert read(spark, events) == expected
    assert read(spark, events, block=30) == expected


def test_a_conversation_of_most_events_is_dealt_out(spark):
    """With many ranges the cuts of a conversation lie in other ranges than the messages that they end."""
    events = logged(7, 3, 30)
    seq = 0
    for i in range(3000):
        seq += 2
        events.append((99, seq, i, "message", "user" if i % 2 else "assistant", f"text {i}"))
    events.append((99, seq + 1, 1000, "edit", None, "back to here"))
    events.append((99, seq + 3, 5000, "message", "assistant", "on from there"))
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        log = spark.createDataFrame([(*e, "x", 1) for e in events], LOG)
        messages = chat.fold(log)
        assert messages.where("conv = 99").count() == 1002
        blocks = chat.render(messages, block=500).cache()
        assert blocks.where("conv = 99").selectExpr("count(DISTINCT part >> 32) AS n").first().n > 3
        assert {r.conv: tuple(r)[1:] for r in chat.read_back(blocks).collect()} == digests(folded(events))
        blocks.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_spans_of_blocks_are_the_texts_to_learn_from(spark):
    rows = spark.createDataFrame([(1, 0, "user", "ask ## this"), (1, 1, "assistant", "told\\ </turn>"), (1, 2, "tool", "x"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    (block,) = chat.render(chat.fold(chat.as_log(rows))).collect()
    assert block.formatted == "### User: ask #\\# this</turn>\n### Assistant: told\\\\ <\\/turn></turn>\n### Tool: x</turn>\n### Assistant: </turn>\n"
    assert [chat.unescape(block.formatted[s.start : s.end]) for s in block.loss] == ["told\\ </turn>", ""]
    assert block.n_turns == 4


def test_nulls_ties_repeats_unknown_kinds_strays_long_texts_and_none(spark):
    long = "line ## \n" * 200_000
    events = [
        (None, None, None, None, None, None),
        (None, 1, 1, "message", "Odd: role\n", "t"),
        (1, 5, 1, "message", "user", "twice"),
        (1, 5, 1, "message", "user", "twice"),
        (1, 5, 2, "like", "user", "not read"),
        (1, 6, 3, "delta", "assistant", "stray piece"),
        (1, 7, 4, "edit", "user", "stray edit"),
        (2, 1, 1, "message", "assistant", long),
        (2, 2, 1, "delta", None, "end"),
    ]
    got = read(spark, events)
    assert got == digests(folded(events))
    assert got[1][0] == 4 and got[None][0] == 2 and got[2][2] == len(long) + 3
    assert read(spark, [e for e in events if e[0] == 5]) == {}


@pytest.mark.parametrize("query", [queries.op13_chat, queries.chat_log])
def test_registered_queries_are_the_sql(spark, query):
    oracle.same(spark, oracle.connect(), query, queries.OP13_SQL)


def test_the_conversation_of_control_strings(spark):
    rows = {r.conv_id: r for r in queries.op13_chat(spark, oracle.SF).where("conv_id = -7").collect()}
    said = queries._CONTROLS
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(said)
    assert rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
