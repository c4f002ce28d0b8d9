"""Dialogue state on streams: sessions with a sliding time to live, counters, hourly limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspan.sources.snapshots import Folded, Store

#: Milliseconds after which a session without an event ends.
TTL_MS = 24 * 3600 * 1000

OUTPUT = "user_id long, started timestamp, ended timestamp, events long, total double, last_type string, expired boolean"
STATE = "started long, ended long, events long, total double, last_type string"


def _row(key: tuple, state: tuple, expired: bool) -> dict[str, object]:
    started, ended, events, total, last_type = state
    return {"user_id": key[0], "started": pd.Timestamp(started, unit="us"), "ended": pd.Timestamp(ended, unit="us"), "events": events, "total": total, "last_type": last_type, "expired": expired}


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events in the order of their time; one that comes more than the time to live after the last begins another session."""
    if state.hasTimedOut:
        yield pd.DataFrame([_row(key, state.get, True)])
        state.remove()
        return
    now = state.get if state.exists else None
    rows = []
    events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for ts, value, kind in zip(events["ts"], events["value"], events["event_type"], strict=True):
        at, worth = ts.value // 1000, 0.0 if pd.isna(value) else float(value)
        if now and at > now[1] + TTL_MS * 1000:
            rows.append(_row(key, now, True))
            now = None
        started, ended, n, total, last_type = now or (at, at, 0, 0.0, None)
        now = (min(started, at), max(ended, at), n + 1, total + worth, kind if at >= ended else last_type)
    state.update(now)
    state.setTimeoutTimestamp(now[1] // 1000 + TTL_MS + 1)
    yield pd.DataFrame([*rows, _row(key, now, False)])


def session_state(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running state of each user's session, in update mode; a session that ends, by a gap or on time, is reported once more.

    events: event_id, ts, user_id, event_type, value.
    """
    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(events: DataFrame, who: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Events of each hour and who, final once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), who).agg(F.count("*").alias("n")).select(who, F.col("window.start").alias("hour"), "n")


def counters(store: Store) -> Folded:
    """A table of counters by user that micro-batches add to, exact when one is run again; ``add`` is for ``foreachBatch``."""

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("at").alias("at"))

    return Folded(store, "counters", fold)


def counted(events: DataFrame) -> DataFrame:
    """Events as rows of the table of counters."""
    return events.select("user_id", F.lit(1).cast("long").alias("n"), F.col("ts").alias("at"))


def values(store: Store) -> Folded:
    """A table of key, value and expiry that micro-batches put values to: of each key the one put last, ``at`` and then by value."""

    def fold(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("at", "value", "expires_at")).alias("v")
        return rows.groupBy("key").agg(last).select("key", "v.at", "v.value", "v.expires_at")

    return Folded(store, "values", fold)
