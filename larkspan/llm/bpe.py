"""Byte-level BPE by monoid tree reduction.

A piece is encoded by halving it down to single bytes and joining neighbours up the tree. A join
re-encodes a window of tokens around the boundary and widens it until the tokens outside provably
stay: a token sequence is the encoding of its bytes exactly if every two neighbours are the encoding
of theirs, so a window is wide enough once its first and last new token form such pairs with the
tokens beside it. Encodings form a monoid under this join; decoding concatenates up a tree, too.

A text is split into matches of the public pre-tokenisation pattern, each encoded on its own, without
special tokens. The pieces of a slice of texts are dictionary-encoded, each distinct piece goes through
the tree once, and the ids of all texts are gathered by index. Encodings are kept within a task, in a
bounded store; pieces that fall out are encoded again. Decoding looks the bytes of each run of ids up and
concatenates the runs up a tree.

Defined results: a null or empty text has no tokens; strings of special tokens are ordinary text;
repeated rows are each encoded; ranks are unique, so there are no ties, and of equal pairs the leftmost
is merged first; a very long text or piece is encoded whole, in a slice of its own; ids are of any type,
null as well; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: Pieces of one generation kept by a worker, the longest that is kept, and the halves, windows and pairs kept.
KEPT, KEPT_BYTES, STORED = 120_000, 48, 40_000
#: Bytes of the texts whose pieces are gathered together, unless a single text is longer.
SLICE = 1 << 21
#: Bytes of a leaf of the tree, token ids of a leaf of decoding, and how many parts meet in a node of it.
LEAF, RUN, FAN = 4, 1024, 64

#: The pattern that ``_Runs`` splits by whole arrays; other patterns are split match by match.
RUNS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Runs:
    """Where the matches of ``RUNS_PATTERN`` begin, from runs of character classes."""

    SPACE, LETTER, NUMBER, OTHER = range(4)
    ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self) -> None:
        every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
        self.kind = np.full(0x110000, self.OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", self.LETTER), (r"\p{N}", self.NUMBER), (r"\s", self.SPACE)):
            self.kind[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions of the code points at which a match begins; ``first``: where each text begins, and the end."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[points]
        fresh = np.zeros(n + 1, bool)
        fresh[1:n] = kind[1:] != kind[:-1]
        border = np.zeros(n + 1, bool)
        border[first] = True
        fresh |= border
        fresh[0] = True
        space = kind == self.SPACE
        # the last blank before other characters goes with them; any other white space there stands alone
        last = np.flatnonzero(space & fresh[1:] & ~border[1:])
        begins = fresh[:n].copy()
        begins[last] = True
        begins[last[points[last] == 0x20] + 1] = False
        # an apostrophe that no blank is joined to, and an ending after it
        at = np.flatnonzero(points == 0x27)
        at = at[begins[at]]
        room = first[np.searchsorted(first, at, "right")] - at
        cut = np.zeros(len(at), np.int64)
        for ending in self.ENDINGS:
            there = (cut == 0) & (room > len(ending))
            for k, letter in enumerate(ending, 1):
                there &= points[np.minimum(at + k, n - 1)] == ord(letter)
            cut[there] = len(ending)
        found = cut > 0
        begins[at[found] + 1] = False
        after = at[found] + 1 + cut[found]
        begins[after[after < n]] = True
        return np.flatnonzero(begins)


@functools.cache
def _runs() -> _Runs:
    return _Runs()


class Encoding:
    """Ranks and the pre-tokenisation pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        size = max(self.tokens, default=-1) + 1
        self.raw = pa.array([self.tokens.get(i, b"") for i in range(size)], pa.binary())
        self.packed = {k: v.to_bytes(4, "little") for k, v in ranks.items()}
        self.decimal = pa.array([b"%d " % i for i in range(size)], pa.binary())
        self.fits = functools.lru_cache(STORED)(self._fits)
        self.window = functools.lru_cache(STORED)(self._window)
        self.half = functools.lru_cache(STORED)(self._tree)
        self.parts = functools.lru_cache(None)(self._parts)

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoding:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)

    def _window(self, raw: bytes) -> tuple[bytes, ...]:
        """The encoding of a few bytes: merge the pair of lowest rank, leftmost first, while any has a rank."""
        if raw in self.ranks or not raw:
            return (raw,) if raw else ()
        return tuple(self._merged(raw))

    def _merged(self, raw: bytes, limit: float = math.inf) -> list[bytes]:
        """The tokens of the bytes after all merges of a rank below the limit."""
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], math.inf) for i in range(len(raw) - 1)]
        while pairs and (best := min(pairs)) < limit:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], math.inf)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], math.inf)
        return parts

    def _parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes the token; None for one that no merge makes."""
        parts = self._merged(token, self.ranks[token])
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens are the encoding of their bytes.

        The merges that make them are undone, the last one first. Whatever stands on both sides of the border at
        that time must not have been merged before: by a lower rank or, as the leftmost goes first, by the same
        rank as the one undone on the right.
        """
        rank, parts = self.ranks, self.parts
        below = math.inf
        while True:
            across = rank.get(left + right)
            if across is not None and across < below:
                return False
            a, b = parts(left), parts(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and rank[left] > rank[right]:
                below, left = rank[left], a[1]
            else:
                below, right = rank[right] + 1, b[0]

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of the bytes of two encodings one after the other."""
        fits = self.fits
        if not left or not right or fits(left[-1], right[0]):
            return left + right
        cut, until = len(left) - 1, 1
        middle = self.window(left[-1] + right[0])
        while True:
            fits_left = not cut or fits(left[cut - 1], middle[0])
            fits_right = until == len(right) or fits(middle[-1], right[until])
            if fits_left and fits_right:
                return left[:cut] + middle + right[until:]
            # widened as far again
            if not fits_left:
                cut = max(0, 2 * cut - len(left))
            if not fits_right:
                until = min(len(right), 2 * until)
            middle = self.window(b"".join(left[cut:] + right[:until]))

    def _tree(self, raw: bytes) -> tuple[bytes, ...]:
        """Halves are encoded, then joined; short halves are kept.

        The left half is a power of two long, so that runs of one character meet in aligned tokens.
        """
        n = len(raw)
        if n <= LEAF or raw in self.ranks:
            return self.window(raw)
        middle = 1 << (n - 1).bit_length() - 1
        encode = self.half if n <= KEPT_BYTES else self._tree
        left = self.window(raw[:middle]) if middle <= LEAF else encode(raw[:middle])
        right = self.window(raw[middle:]) if n - middle <= LEAF else encode(raw[middle:])
        return left + right if self.fits(left[-1], right[0]) else self.join(left, right)

    def forget(self) -> None:
        """Drop what is kept; a task ends so, as its worker lives on."""
        self.young, self.old = {}, {}
        for kept in (self.fits, self.window, self.half):
            kept.cache_clear()
        text.give_back()

    def encode_bytes(self, raw: bytes) -> list[bytes]:
        """The tokens of one piece."""
        return list(self._tree(raw))

    def ids(self, raw: bytes) -> bytes:
        """The ids of one piece, four bytes each."""
        got = self.old.get(raw)
        if got is None:
            got = b"".join(map(self.packed.__getitem__, self._tree(raw)))
        if len(raw) <= KEPT_BYTES:
            if len(self.young) >= KEPT:
                self.young, self.old = {}, self.young
            self.young[raw] = got
        return got

    def split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, one after the other, and the number of the first of each text (and the end)."""
        raw, offsets = text.utf8(column)
        if self.pattern.pattern != RUNS_PATTERN:
            found = [self.pattern.findall(x or "") for x in column.to_pylist()]
            flat = [x.encode() for x in itertools.chain.from_iterable(found)]
            return pa.array(flat, pa.large_binary()), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        # a code point begins at every byte that does not continue one
        begin = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        at = begin[_runs().starts(points, np.searchsorted(begin, offsets))]
        ends = np.append(at, len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        return pieces, np.searchsorted(at, offsets)

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the end)."""
        pieces, first = self.split(column)
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        coded = pieces.dictionary_encode()
        kept, own = self.young.get, self.ids
        distinct = [kept(x) or own(x) for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        known = np.frombuffer(b"".join(distinct), "<i4")
        index = coded.indices.to_numpy().astype(np.int64)
        sizes = size[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # the k-th id of a piece is the k-th of its entry
        return known[np.repeat((np.cumsum(size) - size)[index] - ends[:-1], sizes) + np.arange(ends[-1])], ends[first]

    def encode(self, value: str) -> list[int]:
        return self.encode_all(pa.array([value], pa.string()))[0].tolist()

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        """The bytes of the tokens: runs of ids are looked up at once and concatenated up the tree."""
        ids = np.asarray(ids, np.int64)
        level = [_joined(self.raw, ids[i : i + RUN]) for i in range(0, len(ids), RUN)]
        while len(level) > 1:
            level = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return bytes(level[0]) if level else b""


def _joined(values: pa.Array, index: np.ndarray) -> memoryview:
    """The values at the index, one after the other."""
    taken = values.take(pa.array(index))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2])[ends[0] : ends[-1]]


_LOADED: dict[tuple[str, str], Encoding] = {}


def encoding(path: str, pattern: str) -> Encoding:
    """The encoding, loaded once per worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoding.load(path, pattern)
    return _LOADED[path, pattern]


SCHEMA = "n_tokens long, ids array<int>"


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the number of tokens and the token ids of its whole text."""
    store.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col))
    field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for part in text.slices(batches, limit=SLICE):
            ids, first = own.encode_all(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), _lists(ids, first)], [field.name, "n_tokens", "ids"])
        own.forget()

    return source.mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, {SCHEMA}")


def decode(tokens: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and the bytes that its token ids decode to (null ids: no bytes)."""
    source = tokens.select(F.col(id_col), F.col(ids_col))
    field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            raw = [own.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [field.name, "decoded"])

    return source.mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, decoded binary")


ROUND_TRIP = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: its id, the number of tokens, and digests of the ids and of the bytes decoded from them.

    The same as ``encode`` followed by ``decode``, digested where they are made; ``with_ids`` adds the ids.
    """
    store.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col))
    field = source.schema[0]
    names = [field.name, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for part in text.slices(batches, limit=SLICE):
            ids, first = own.encode_all(part.column(1))
            decimals, decoded = [], []
            for low, high in itertools.pairwise(first.tolist()):
                decimals.append(hashlib.sha256(_joined(own.decimal, ids[low:high])[:-1]).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids[low:high])).hexdigest())
            columns = [part.column(0), pa.array(np.diff(first)), pa.array(decimals, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(_lists(ids, first))
            yield pa.RecordBatch.from_arrays(columns, names)
        own.forget()

    return source.mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, {ROUND_TRIP}" + ", ids array<int>" * with_ids)
