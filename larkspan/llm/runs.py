"""Periodic runs of words.

A run is a maximal stretch of words with smallest period q (words q apart are equal) that has at least
``least`` words and ``times`` periods. Each text's suffix automaton gives the ordered set of end positions of
every state, merged from the smaller to the larger along the suffix links. Two neighbours of such a set that were not neighbours
further down have the state's length as their longest common suffix; where that is at least ``times - 1`` times their distance,
the distance is the smallest period of a repetition there. What can be extended to the left or right is seen at a
longer state or at later positions, so each run is seeded once and ends where its neighbouring words differ.

Only stretches that can hold runs enter an automaton: in a run every word is covered by windows of ``_window`` words that occur again one
period away, and one period is no more than the covered stretch divided by ``times``. Everything outside is in no run; this prunes
nothing that counts.

Defined results: null and empty texts have no words and no runs; words are compared exactly; one task holds one text at a time, and
an automaton takes memory in proportion to its stretch; repeated rows are answered each; an empty table gives an empty result; ids
are of any type, null included; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: Words and periods of the shortest runs.
LEAST, TIMES = 24, 3

#: Start, length and period.
Run = tuple[int, int, int]


def _window(least: int, times: int) -> int:
    """Words that every run has twice, one period apart."""
    q = least // times
    return max(1, min(least - q, (times - 1) * (q + 1)))


def _stretches(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words outside of which there is no run."""
    size = _window(least, times)
    n = len(hashes)
    if n < max(least, size + 1):
        return []
    grams = text.combine(hashes.view(np.uint64), size)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    gaps = np.where(same, np.diff(order), n)
    near = np.full(len(grams), n)
    near[order[1:]] = gaps
    near[order[:-1]] = np.minimum(near[order[:-1]], gaps)
    at = np.flatnonzero(near < n)
    while len(at):
        ends = np.flatnonzero(np.diff(at) > size)
        start, end = at[np.concatenate([[0], ends + 1])], at[np.concatenate([ends, [len(at) - 1]])] + size
        owner = np.searchsorted(start, at, "right") - 1
        width = end - start
        stay = (near[at] * times <= width[owner]) & (width[owner] >= least)
        if stay.all():
            return list(zip(start.tolist(), end.tolist(), strict=True))
        at = at[stay]
    return []


class _Automaton:
    """Suffix automaton of a sequence of numbers.

    Most states have one way on, which is kept in arrays; further ways are in ``more``.
    """

    def __init__(self, items: Sequence[int]) -> None:
        self.length, self.link, self.own = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.item, self.goto = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for position, item in enumerate(items):
            last = self._extended(last, position, item)

    def _state(self, length: int, own: int) -> int:
        for column, value in ((self.length, length), (self.link, 0), (self.own, own), (self.item, -1), (self.goto, -1)):
            column.append(value)
        return len(self.length) - 1

    def _extended(self, state: int, position: int, item: int) -> int:
        length, link, items, goto, more = self.length, self.link, self.item, self.goto, self.more
        new, found = self._state(position + 1, position), -1
        while state >= 0:
            if items[state] == item:
                found = goto[state]
                break
            if items[state] < 0:
                items[state], goto[state] = item, new
            else:
                others = more.setdefault(state, {})
                found = others.get(item, -1)
                if found >= 0:
                    break
                others[item] = new
            state = link[state]
        if found < 0:
            return new
        if length[state] + 1 == length[found]:
            link[new] = found
            return new
        shorter = self._state(length[state] + 1, -1)
        items[shorter], goto[shorter], link[shorter] = items[found], goto[found], link[found]
        if found in more:
            more[shorter] = dict(more[found])
        link[found] = link[new] = shorter
        while state >= 0:
            if items[state] == item:
                if goto[state] != found:
                    break
                goto[state] = shorter
            elif more.get(state, {}).get(item, -1) == found:
                more[state][item] = shorter
            else:
                break
            state = link[state]
        return new


def _united(a: list[int], b: list[int]) -> list[int]:
    """``a`` with the elements of the shorter ``b``."""
    if 8 * len(b) > len(a):
        return sorted(a + b)
    for x in b:
        insort(a, x)
    return a


def _seeds(items: Sequence[int], least: int, times: int) -> set[Run]:
    """The runs of a sequence, from the end positions of its automaton's states."""
    auto = _Automaton(items)
    n, length, link, own = len(items), auto.length, auto.link, auto.own
    auto.more.clear()
    # positions are negated, so that a state's own one, which is the least, comes last
    ends: dict[int, list[int]] = {}
    fresh: dict[int, list[int]] = {}
    found: set[Run] = set()
    for state in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        if not state:
            break
        here, new, size = ends.pop(state, None), fresh.pop(state, []), length[state]
        if own[state] >= 0:
            if here is None:
                here = [-own[state]]
            else:
                here.append(-own[state])
                new.append(-own[state])
        for x in new:
            k = bisect_left(here, x)
            for later, earlier in ((k - 1, k), (k, k + 1)):
                if later < 0 or earlier >= len(here):
                    continue
                end, q = -here[later], here[earlier] - here[later]
                if (times - 1) * q > size or size + q < least:
                    continue
                start = end - q - size + 1
                if (start == 0 or items[start - 1] != items[start - 1 + q]) and (end + 1 == n or items[end + 1] != items[end + 1 - q]):
                    found.add((start, size + q, q))
        above = link[state]
        if not above:
            continue
        there = ends.get(above)
        if there is None:
            ends[above], fresh[above] = here, []
        elif len(here) > len(there):
            fresh[above] = list(there)
            ends[above] = _united(here, there)
        else:
            fresh[above] += here
            ends[above] = _united(there, here)
    return found


def find(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a text's words by start, then period."""
    if len(words) < least:
        return []
    found: set[Run] = set()
    for start, end in _stretches(np.fromiter(map(hash, words), np.int64, len(words)), least, times):
        numbers: dict[bytes, int] = {}
        inner = _seeds([numbers.setdefault(w, len(numbers)) for w in words[start:end]], least, times)
        found |= {(start + s, size, q) for s, size, q in inner}
    return sorted(found, key=lambda r: (r[0], r[2], r[1]))


def collapsed(words: Sequence[bytes], runs: list[Run]) -> Sequence[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, size, q in runs:
        gone[start + q : start + size] = True
    return [words[i] for i in np.flatnonzero(~gone)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: id, its runs by start and period, and the text without repetitions, words joined by one space."""
    if times < 2 or least < times:
        raise ValueError("a run has two periods at least, of a word at least")
    store.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            split = [(x or "").encode().split() for x in part.column(1).to_pylist()]  # of bytes: at ASCII white space
            runs = [find(words, least, times) for words in split]
            kept = text.strings([b" ".join(collapsed(w, r)) for w, r in zip(split, runs, strict=True)])
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], _RUNS)
            yield pa.RecordBatch.from_arrays([part.column(0), listed, kept], [field.name, "runs", "collapsed"])

    return source.mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def greatest(runs: Column) -> Column:
    """The run with the greatest length by period, compared exactly; of equals the first, then the shorter period."""

    def above(a: Column, b: Column) -> Column:
        return F.when(a.length * b.period != b.length * a.period, F.when(a.length * b.period > b.length * a.period, -1).otherwise(1)).when(
            a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)
        ).otherwise(F.when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0))

    return F.get(F.array_sort(runs, above), F.lit(0))
