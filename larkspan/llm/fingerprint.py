"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for two primes, the prefix sums of ``code * base**position``. The hash of any span
is a difference of two sums, brought to position 0 by an inverse power; equal spans have equal
hashes, and the longest common extension of two positions is found by binary search over lengths.

A fingerprint is the text's length, its whole-text hash, and a sketch: every span of ``SPAN`` code
points (a shorter text is one span) goes by its hash to one of ``BINS`` bins, which keep the least
value. The share j of bins that agree, of those that either text fills, estimates the Jaccard
similarity of the spans; likeness is 2j / (1 + j), the share of a text that is common to both. Equal texts
have equal fingerprints.

``neighbours`` needs each row's successor by descending id. One range shuffle brings rows in order;
each task sees successors inside its range, and the first and last row of every task meet in a join
of as many rows as there are tasks.

Defined results: a null text counts as empty; the fingerprint of an empty text is like that of another
empty text only; rows of one id follow each other by a hash of the text, then the text; null ids come
last; a single row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: The two largest primes below 2**31 that serve as moduli, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
#: Code points of a span, and bins of a sketch.
SPAN, BINS = 16, 64
_EMPTY = 0xFFFF


class _Powers:
    def __init__(self, prime: int, base: int) -> None:
        self.prime, self.steps = prime, (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            size = len(self.tables[0])
            for k, step in enumerate(self.steps):
                more = self.tables[k] * np.uint64(pow(step, size, self.prime)) % np.uint64(self.prime)
                self.tables[k] = np.concatenate([self.tables[k], more])
        return [t[:n] for t in self.tables]


_POWERS = [_Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


def codes(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le"), np.uint32)


class Prefix:
    """Prefix sums of one or more texts one after the other."""

    def __init__(self, points: np.ndarray) -> None:
        self.size = len(points)
        self.sums, self.inverse = [], []
        for prime, powers in zip(PRIMES, _POWERS, strict=True):
            up, down = powers.get(self.size + 1)
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: self.size] % np.uint64(prime), out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(down)

    def spans(self, start: np.ndarray, end: np.ndarray, modulus: int) -> np.ndarray:
        """Hashes of many spans under one modulus."""
        prime = np.uint64(PRIMES[modulus])
        return (self.sums[modulus][end] - self.sums[modulus][start]) % prime * self.inverse[modulus][start] % prime

    def span(self, start: int, end: int) -> tuple[int, int]:
        a, b = np.array([start]), np.array([end])
        return int(self.spans(a, b, 0)[0]), int(self.spans(a, b, 1)[0])

    def extension(self, at: int, other: Prefix, there: int, limit: int | None = None) -> int:
        """Code points that agree from ``at`` on with the other text's from ``there`` on."""
        low, high = 0, min(self.size - at, other.size - there)
        high = high if limit is None else min(high, limit)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low


def _sketched(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, whole-text hashes (both moduli in one) and sketches (one row each) of many texts."""
    lengths = np.array([len(x) for x in points], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    prefix = Prefix(np.concatenate(points) if points else np.zeros(0, np.uint32))
    whole = prefix.spans(first[:-1], first[1:], 0) << np.uint64(32) | prefix.spans(first[:-1], first[1:], 1)
    sizes = np.maximum(lengths - SPAN + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(points)), sizes)
    start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
    hashes = text.mix(prefix.spans(start, start + np.minimum(lengths, SPAN)[owner], 0) + np.uint64(1))
    table = np.full(len(points) * BINS, np.iinfo(np.uint64).max, np.uint64)
    bins = (hashes >> np.uint64(58)).astype(np.int64)
    np.minimum.at(table, owner * BINS + bins, hashes & np.uint64((1 << 58) - 1))
    filled = table != np.iinfo(np.uint64).max
    values = np.where(filled, np.minimum(table & np.uint64(0xFFFF), np.uint64(_EMPTY - 1)), np.uint64(_EMPTY)).astype(np.uint16).reshape(-1, BINS)
    return lengths, whole.astype(np.int64), values


def sketches(points: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Fingerprints of many texts, and their sketches, one row each."""
    lengths, whole, values = _sketched(points)
    body = values.astype(">u2").tobytes().hex()
    width = BINS * 4
    return [f"{n:x}-{h:016x}-{body[i * width : (i + 1) * width]}" for i, (n, h) in enumerate(zip(lengths.tolist(), whole.tolist(), strict=True))], values


def _print(length: str, whole: str, body: str) -> Column:
    """The same text as ``sketches`` gives, of its parts."""
    return F.concat_ws("-", F.lower(F.hex(length)), F.lower(F.lpad(F.hex(whole), 16, "0")), F.lower(F.hex(body)))


def _alike(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    either = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != _EMPTY)).sum(axis=1)
    return np.where(same, 1.0, 2 * equal / np.maximum(either + equal, 1))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), ">u2").astype(np.uint16)[None] for f in (a, b))
    return float(_alike(x, y, np.array([False]))[0])


def edited(value: str, successor: str) -> str:
    """The last third (rounded down) replaced by the successor's first as many code points, or all."""
    k = len(value) // 3
    return value[: len(value) - k] + successor[:k]


_PARTS = "n_chars long, whole long, body binary, edited_chars long, edited_whole long, edited_body binary, edited_digest binary, near_edited double, near_next double, common_prefix long"
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]
_KINDS = [{"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]] for x in _PARTS.split(", ")]


def _measure(values: list[str]) -> list[pa.Array]:
    """Columns of all texts but the last, each with the one after it; fingerprints in parts, which are half as long."""
    own = values[:-1]
    changed = [edited(a, b) for a, b in zip(own, values[1:], strict=True)]
    points = [codes(x) for x in values]
    changed_points = [codes(x) for x in changed]
    lengths, whole, sketch = _sketched(points)
    changed_lengths, changed_whole, changed_sketch = _sketched(changed_points)

    def same(n1, h1, s1, n2, h2, s2):
        return (n1 == n2) & (h1 == h2) & (s1 == s2).all(axis=1)

    mine = lengths[:-1], whole[:-1], sketch[:-1]
    extension = [Prefix(a).extension(0, Prefix(b), 0) for a, b in zip(points, changed_points, strict=False)]
    columns = [
        lengths[:-1],
        whole[:-1],
        [x.astype(">u2").tobytes() for x in sketch[:-1]],
        changed_lengths,
        changed_whole,
        [x.astype(">u2").tobytes() for x in changed_sketch],
        [hashlib.sha256(x.encode()).digest() for x in changed],
        _alike(sketch[:-1], changed_sketch, same(*mine, changed_lengths, changed_whole, changed_sketch)),
        _alike(sketch[:-1], sketch[1:], same(*mine, lengths[1:], whole[1:], sketch[1:])),
        extension,
    ]
    return [pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)]


def _sequence(batches: Iterator[pa.RecordBatch], id_name: str) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with its successor; the task's first and last text as further rows."""
    task = TaskContext.get().partitionId()
    names = [id_name, "task", "place", "value", *_NAMES]

    def edge(key: pa.Scalar, place: str, value: str) -> pa.RecordBatch:
        columns = [pa.array([key.as_py()], key.type), pa.array([task], pa.int32()), pa.array([place]), pa.array([value])]
        columns += [pa.array([None], t) for t in _KINDS]
        return pa.RecordBatch.from_arrays(columns, names)

    last: tuple[pa.Scalar, str] | None = None
    for part in text.slices(batches):
        keys, values = part.column(0), [x or "" for x in part.column(1).to_pylist()]
        if last is None:
            yield edge(keys[0], "head", values[0])
        else:
            keys = pa.concat_arrays([pa.array([last[0].as_py()], keys.type), keys])
            values = [last[1], *values]
        n = len(values) - 1
        if n:
            yield pa.RecordBatch.from_arrays([keys.slice(0, n), pa.array([task] * n, pa.int32()), pa.array(["row"] * n), pa.array([None] * n, pa.string()), *_measure(values)], names)
        last = keys[n], values[n]
    if last is not None:
        yield edge(last[0], "tail", last[1])


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, length, digest of the edited text, both fingerprints and how like it the edited and the next text are."""
    store.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    field = source.schema[0]
    kind = f"`{field.name}` {field.dataType.simpleString()}"
    order = [F.col(field.name).desc_nulls_last(), F.xxhash64("__text"), F.col("__text")]
    ranged = source.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    found = store.written(
        ranged.mapInArrow(lambda batches: _sequence(batches, field.name), f"{kind}, task int, place string, value string, {_PARTS}"), "fingerprints"
    )
    heads = found.where("place = 'head'").select(F.col("task").alias("head_task"), F.col("value").alias("successor"))
    tails = found.where("place = 'tail'").select(field.name, "task", "value")
    # as many rows as tasks, without their texts
    tasks = found.where("place = 'head'").select("task")
    following = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("head_task"))
    edges = tails.join(following, "task").join(heads, "head_task").select(field.name, "value", "successor")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_measure(pair)], [field.name, *_NAMES])

    parts = found.where("place = 'row'").select(field.name, *_NAMES).unionByName(edges.mapInArrow(close, f"{kind}, {_PARTS}"))
    return parts.select(
        field.name,
        "n_chars",
        F.lower(F.hex("edited_digest")).alias("edited_sha256"),
        _print("n_chars", "whole", "body").alias("fingerprint"),
        _print("edited_chars", "edited_whole", "edited_body").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "common_prefix",
    )
