"""Dialogue turns on streams: slots, offers and the budget of model calls of each session, in state that ends after a day.

A turn is something said or a search's answer with offers (none: the search found something). ``read_turns`` reads what is said with column
expressions; the stateful operator only folds what was read. Its variables live apart: the slots and the open offer, which end ``TTL_MS`` after the last turn
that was kept, and the calls and the number of sessions, which stay. A timer clears a session that has ended; a turn that comes first finds that the gap is too long and
clears it itself, inside a micro-batch as well, so that every split of the turns into micro-batches gives the same rows.

Turns of a session are folded in the order of their time within a micro-batch, and in the order of arrival between micro-batches, as a server would.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspan.functions import text
from larkspan.operators import dialogue

#: Milliseconds after which a session without a kept turn ends; model calls that one session may make; texts that are kept.
TTL_MS, MOST_CALLS, KEPT_TEXTS = 24 * 3600 * 1000, 30, 10

_SCALARS = {"station": "string", **dict.fromkeys(dialogue.NUMERIC, "int"), "priority": "string", "dept": "string"}
_LISTS = ("course_types", "clubs")
_SLOTS = ", ".join([*(f"{k} {t}" for k, t in _SCALARS.items()), "academic boolean", *(f"{k} array<string>" for k in _LISTS), "relaxations array<string>", "texts array<string>"])
_NAMES = [x.split()[0] for x in _SLOTS.split(", ")]
_NONE = {k: None for k in _SCALARS} | {"academic": False} | {k: [] for k in (*_LISTS, "relaxations", "texts")}

_RESULT = f"session_no int, turn long, done string, {_SLOTS}, offered array<string>, calls int, allowed boolean"


def signs(raw: Column) -> Column:
    """What a reply to offers has, whichever are open: no, yes, unclear words, a number, options that it names."""
    x = F.trim(F.coalesce(raw, F.lit("")))
    named = F.array_compact(F.array(*(F.when(x.rlike(p), k) for k, p in dialogue.HINTS.items())))
    digit = F.coalesce(F.nullif(F.regexp_extract(x, r"^([1-9１-９])\s*[。.]?$", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"([1-9１-９])\s*(?:番|つ目|つめ)", 1), F.lit("")))
    yes, no = x.rlike(dialogue.YES), x.rlike(dialogue.NO)
    unclear = x.rlike(dialogue.UNCLEAR) & ~yes & ~x.rlike("[1-9１-９]") & (F.size(named) == 0)
    return F.struct((x == "").alias("blank"), no.alias("no"), yes.alias("yes"), unclear.alias("unclear"), text.fold_digits(digit).cast("int").alias("number"), named.alias("named"))


def read_turns(turns: DataFrame, *, session: str = "session", at: str = "at", turn: str = "turn", said: str = "text", offers: str = "offers", asked: str | None = None) -> DataFrame:
    """Turns with their slots and signs. A turn with an array of offers is a search's answer; else something was said."""
    slots = dialogue.extract(F.col(said))
    asked_slot = F.lit(None).cast("string") if asked is None else F.col(asked)
    read = turns.select(F.col(session).alias("session"), F.col(at).alias("at"), F.col(turn).cast("long").alias("turn"), F.col(said).alias("text"), F.col(offers).alias("offers"), slots.alias("slots"), asked_slot.alias("asked"))
    return read.select("*", signs(F.col("text")).alias("signs"), dialogue.needs_model(F.col("asked"), F.col("slots")).alias("wants_model")).drop("asked")


def reply(said: Any, offered: list[str]) -> tuple[str | None, str]:
    """The option that a reply takes, and what the reply is: accepted, declined, unclear, or no reply to the offers.

    No comes before unclear words, these before numbers, numbers before words of one option, these before yes.
    """
    if not offered or said["blank"]:
        return None, "none"
    if said["no"]:
        return None, "declined"
    if said["unclear"]:
        return None, "unclear"
    if said["number"] is not None and 1 <= said["number"] <= len(offered):
        return offered[said["number"] - 1], "accepted"
    named = [k for k in offered if k in said["named"]]
    if len(named) == 1:
        return named[0], "accepted"
    if named or said["yes"]:
        return (offered[0], "accepted") if not named and len(offered) == 1 else (None, "unclear")
    return None, "none"


class Session:
    """The variables of one session key, and what a turn does to them."""

    def __init__(self, slots: dict[str, Any] | None = None, offered: list[str] | None = None, last_at: int | None = None, calls: int = 0, number: int = 0) -> None:
        self.slots, self.offered, self.last_at, self.calls, self.number = slots or dict(_NONE), offered or [], last_at, calls, number

    def clear(self) -> None:
        """The session ends; calls and the number of sessions stay."""
        self.slots, self.offered, self.last_at = dict(_NONE), [], None

    def keep(self, at: int) -> None:
        self.last_at = at if self.last_at is None else max(self.last_at, at)

    def add(self, turn: Any, at: int, most: int) -> tuple:
        """Fold a turn; the row that it gives."""
        if self.last_at is not None and at > self.last_at + TTL_MS:
            self.clear()
        if self.last_at is None:
            self.number += 1
            self.last_at = at  # opened by a turn of any kind
        allowed = self.calls < most
        if turn["offers"] is not None:
            self.offered, done = list(turn["offers"]), "offer"
        else:
            key, done = reply(turn["signs"], self.offered)
            if done == "unclear":
                return self.row(turn["turn"], done, allowed)  # nothing is kept, and the session isn't prolonged
            if done == "none":
                self.merge(turn["slots"])
                self.calls += bool(turn["wants_model"] and allowed)
                done = "slots"
            elif key:
                self.slots = self.slots | {"relaxations": _united(self.slots["relaxations"], [key])}
            if done != "declined":
                self.slots = self.slots | {"texts": [*self.slots["texts"], turn["text"] or ""][-KEPT_TEXTS:]}
            self.offered = []
        self.keep(at)
        return self.row(turn["turn"], done, allowed)

    def merge(self, found: Any) -> None:
        """Values that were said replace older ones, lists are united, flags stay."""
        new = {k: found[k] for k in _SCALARS if found[k] is not None}
        lists = {k: _united(self.slots[k], found[k] or []) for k in _LISTS}
        self.slots = self.slots | new | lists | {"academic": bool(self.slots["academic"] or found["academic"])}

    def row(self, turn: int | None, done: str, allowed: bool | None) -> tuple:
        return (self.number, turn, done, *(self.slots[k] for k in _NAMES), list(self.offered), self.calls, allowed)


def _united(a: list[str], b: list[str]) -> list[str]:
    return list(dict.fromkeys([*a, *b]))


class _Processor(StatefulProcessor):
    """Keyed state of several variables with an event-time timer."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", _SLOTS)
        self.offer = handle.getValueState("offer", "offered array<string>, last_at long")
        self.budget = handle.getValueState("budget", "calls int, sessions int")

    def _load(self) -> Session:
        slots = dict(zip(_NAMES, self.slots.get(), strict=True)) if self.slots.exists() else None
        if slots:
            slots = {k: list(v) if isinstance(_NONE[k], list) else v for k, v in slots.items()}
        offered, last_at = self.offer.get() if self.offer.exists() else ([], None)
        calls, number = self.budget.get() if self.budget.exists() else (0, 0)
        return Session(slots, list(offered), last_at, calls, number)

    def _store(self, now: Session, before: int | None) -> None:
        self.slots.update(tuple(now.slots[k] for k in _NAMES))
        self.offer.update((now.offered, now.last_at))
        self.budget.update((now.calls, now.number))
        if now.last_at != before:
            if before is not None:
                self.handle.deleteTimer(before + TTL_MS + 1)
            self.handle.registerTimer(now.last_at + TTL_MS + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = self._load()
        before = now.last_at
        for row in sorted(rows, key=lambda r: (r["at"], r["turn"])):
            yield Row(session=key[0], **dict(zip(_OUT, now.add(row, row["ms"], self.most), strict=True)))
        self._store(now, before)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = self._load()
        yield Row(session=key[0], **dict(zip(_OUT, now.row(None, "expired", None), strict=True)))
        self.slots.clear()
        self.offer.clear()

    def close(self) -> None:
        pass


_OUT = [x.split()[0] for x in _RESULT.split(", ")]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that several variables need, for queries that are started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def fold_turns(read: DataFrame, *, late: str = "1 hour", most: int = MOST_CALLS) -> DataFrame:
    """A row for each turn of ``read_turns``' result, with the session as it is after it, and one (without turn) for each session that expired.

    The stream must be started inside ``state_store``.
    """
    kind = read.schema["session"].dataType.simpleString()
    timed = read.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return timed.groupBy("session").transformWithState(_Processor(most), f"session {kind}, {_RESULT}", "Append", "EventTime")
