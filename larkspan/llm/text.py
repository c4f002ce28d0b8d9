"""Whole texts as byte arrays: words, word hashes and n-gram hashes of many rows at once (numpy)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds, unless a single text is longer.
SLICE_BYTES = 1 << 20

_ORD = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((_ORD >= 0x41) & (_ORD <= 0x5A), _ORD + 32, _ORD).astype(np.uint8)
#: After LOWER: digits, a-z and every byte of a character beyond ASCII.
WORD = ((_ORD >= 0x30) & (_ORD <= 0x39)) | ((_ORD >= 0x61) & (_ORD <= 0x7A)) | (_ORD >= 0x80)

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as was needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text begins (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of column ``text`` have ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """The words of a slice: lower-cased runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

    first: the index of each text's first word (one more than texts); start, end: byte positions;
    hashes: a 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = utf8(column)
        self.lower = LOWER[raw]
        n = len(raw)
        inside = WORD[self.lower]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _POWERS.get(len(self.lower) + 1)
        sums = np.zeros(len(self.lower) + 1, np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * up[: len(self.lower)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i to j, joined by one space."""
        return b" ".join(self.lower[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbours; empty when there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1
        out += hashes[k : k + len(out)] * np.uint64(factor)
    return mix(out + np.uint64(n))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, and where each text's begin (one more than texts).

    A text of fewer words, but not none, has one: all its words.
    """
    counts = words.counts()
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint64)
    every = combine(words.hashes, n)
    long = counts >= n
    if long.any():
        reps = sizes[long]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(at[:-1][long], reps) + inner] = every[np.repeat(words.first[:-1][long], reps) + inner]
    for d in np.flatnonzero((counts > 0) & ~long):
        out[at[d]] = combine(words.hashes[words.first[d] : words.first[d + 1]], int(counts[d]))[0]
    return out, at


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())
