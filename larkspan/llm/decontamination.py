"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over whole texts.

Each benchmark item is cut into windows of ``n`` normalised words; an item of fewer words, but not
none, is one window of all of them. The window hashes are a broadcast set of at most ``BLOCK``
windows; a larger benchmark goes in blocks of that size, each a scan of its own, whose hits are
joined per document. A hash hit counts only after its words were compared.

Defined results: a null or empty text, and a text without words, has 0 words and no hit; a null or
wordless item has no windows; an item without an id hits, but is not listed; items with the same id count as one;
repeated document rows are each reported; every window counts, so that there are no ties; very long texts are scanned
whole, each in a slice of its own; documents and items of empty tables give an empty result or no hits. Columns
besides the id and text, whatever their names, are kept by ``remove`` and ignored by ``scan``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: Words of a window.
N = 10
#: Windows that one broadcast set holds, in expectation; 32 bytes of words count as a window as well. A set takes 30 bytes a window and its words.
BLOCK, WORD_BYTES = 500_000, 32

_SPANS = "array<struct<start:int,end:int>>"
SCHEMA = f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans {_SPANS}"


class _Length:
    """Windows of one length: their hashes in order, where their words are in a buffer, and the items of each."""

    def __init__(self, hashes: list[np.ndarray], starts: list[np.ndarray], ends: list[np.ndarray], owners: list[np.ndarray], words: np.ndarray) -> None:
        every, start, end, owner = (np.concatenate(x) for x in (hashes, starts, ends, owners))
        order = np.argsort(every, kind="stable")
        every, start, end, owner = every[order], start[order], end[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.hashes, self.first = every[first], np.concatenate([first, [len(every)]])
        self.start, self.end, self.owner, self.words = start, end, owner, words
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.hashes >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hashes are known, and the numbers of these."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(42)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[at]
        return at[same], place[same]

    def items(self, number: int, said: bytes) -> set[int]:
        """The items that have these words in a window of a known hash."""
        own = slice(self.first[number], self.first[number + 1])
        groups = zip(self.start[own].tolist(), self.end[own].tolist(), self.owner[own].tolist(), strict=True)
        return {o for s, e, o in groups if self.words[s:e].tobytes() == said}


class Windows:
    """Windows of benchmark items by length, of rows of item id and its words, joined by one space."""

    def __init__(self, rows: list[tuple[str | None, str]], n: int) -> None:
        self.ids = list(dict.fromkeys(item for item, _ in rows))
        number = {x: i for i, x in enumerate(self.ids)}
        parts = text.Words(pa.array([words for _, words in rows], pa.string()))
        by_length: dict[int, list[list[np.ndarray]]] = {}
        for (item, _), first, last in zip(rows, parts.first[:-1].tolist(), parts.first[1:].tolist(), strict=True):
            if not (length := min(n, last - first)):
                continue
            hashes = text.combine(parts.hashes[first:last], length)
            made = hashes, parts.start[first : last - length + 1], parts.end[first + length - 1 : last], np.full(len(hashes), number[item], np.int32)
            for column, x in zip(by_length.setdefault(length, [[], [], [], []]), made, strict=True):
                column.append(x)
        self.by_length = {m: _Length(*columns, parts.lower) for m, columns in by_length.items()}

    def hits(self, words: text.Words) -> Iterator[tuple[int, int, set[str | None]]]:
        """First word, length and items of each verified occurrence."""
        for m, known in self.by_length.items():
            at, numbers = known.find(text.combine(words.hashes, m))
            inside = np.searchsorted(words.first, at, "right") == np.searchsorted(words.first, at + m - 1, "right")
            for i, number in zip(at[inside].tolist(), numbers[inside].tolist(), strict=True):
                if found := known.items(number, words.bytes_of(i, i + m)):
                    yield i, m, {self.ids[x] for x in found}


class _Block:
    """Items of one broadcast set; the windows are built once in each worker."""

    def __init__(self, rows: list[tuple[str | None, str]], n: int) -> None:
        self.rows, self.n = rows, n

    def __reduce__(self):
        return _Block, (self.rows, self.n)

    @functools.cached_property
    def windows(self) -> Windows:
        return Windows(self.rows, self.n)


def _runs(covered: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _report(words: text.Words, windows: Windows) -> tuple[np.ndarray, list[list[str]], list[list[dict[str, int]]]]:
    """Hit words, items and hit spans (in words) of each text."""
    counts = words.counts()
    mark = np.zeros(len(words.start) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for i, m, found in windows.hits(words):
        mark[i] += 1
        mark[i + m] -= 1
        items.setdefault(int(np.searchsorted(words.first, i, "right")) - 1, set()).update(found)
    covered = np.cumsum(mark[:-1]) > 0
    n_hit = np.zeros(len(counts), np.int64)
    spans: list[list[dict[str, int]]] = [[] for _ in counts]
    for d in items:
        own = covered[words.first[d] : words.first[d + 1]]
        n_hit[d] = own.sum()
        spans[d] = _runs(own)
    return n_hit, [sorted(x for x in items.get(d, ()) if x is not None) for d in range(len(counts))], spans


def _columns(n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]], spans: list) -> list[pa.Array]:
    none = digest([])
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([digest(x) if x else none for x in items]),
        pa.array(n_hit > 0),
        pa.array(items, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, n: int, block: int) -> DataFrame:
    """item, words (normalised, joined by one space) and weight of each piece of at most ``block`` windows."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("words")).where("words is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            words = text.Words(part.column(1))
            rows = []
            for item, first, last in zip(part.column(0).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                for start in range(first, max(last - n + 1, first + min(1, last - first)), block):
                    piece = words.bytes_of(start, min(last, start + block + n - 1))
                    rows.append((item, piece.decode("utf-8"), min(block, max(last - start - n + 1, 1)) + len(piece) // WORD_BYTES))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["item", "words", "weight"])

    return items.mapInArrow(run, "item string, words string, weight long")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block: int) -> tuple[DataFrame, int]:
    """The pieces with the number of their block, and how many blocks there are."""
    pieces = store.written(_pieces(benchmark, item_col, text_col, n, block), "benchmark")
    count = -(-(pieces.agg(F.sum("weight")).first()[0] or 0) // block) or 1
    return pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count))), count


def _block(pieces: DataFrame, number: int) -> list[tuple[str | None, str]]:
    return [(r.item, r.words) for r in pieces.where(F.col("block") == number).select("item", "words").collect()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = N,
    block: int = BLOCK,
) -> DataFrame:
    """Per document: its id, words, hit words, items found (ids and digest), and the hit spans in words."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    pieces, count = _blocks(benchmark, item_col, item_text_col, n, block)
    source = docs.select(F.col(id_col), F.col(text_col))
    id_field = source.schema[0]
    if count == 1:
        scanner = _scanner(_broadcast(spark, _block(pieces, 0), n), id_field.name)
        return source.mapInArrow(scanner, f"`{id_field.name}` {id_field.dataType.simpleString()}, {SCHEMA}")
    (row,) = store.fresh(source, "row")
    numbered = store.written(source.select(F.monotonically_increasing_id().alias(row), "*"), "scan-documents")
    merged = _merged(numbered, text_col, row, pieces, count, n)
    return numbered.select(row, id_field.name).join(merged, row).drop(row)


def _merged(numbered: DataFrame, text_col: str, row: str, pieces: DataFrame, count: int, n: int) -> DataFrame:
    """row and the columns of ``scan`` of all blocks together, on texts as they are; one block is broadcast at a time."""
    spark = numbered.sparkSession
    source = numbered.select(row, F.col(text_col))
    parts = []
    for number in range(count):
        shared = _broadcast(spark, _block(pieces, number), n)
        parts.append(store.written(source.mapInArrow(_scanner(shared, row), f"{row} long, {SCHEMA}"), "scan-block"))
        shared.destroy()
    found = functools.reduce(DataFrame.unionByName, parts)
    merged = found.groupBy(row).agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("parts"),
    )
    spans = F.aggregate(
        "parts",
        F.expr(f"cast(array() as {_SPANS})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return merged.select(row, "n_words", "items", spans.alias("spans")).select(
        row,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "spans",
    )


def _broadcast(spark: SparkSession, rows: list[tuple[str | None, str]], n: int) -> Broadcast:
    return spark.sparkContext.broadcast(_Block(rows, n))


def _scanner(shared: Broadcast, key: str):
    """key, text -> key and what the scan of one block finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value.windows
        for part in text.slices(batches):
            words = text.Words(part.column(1))
            n_hit, items, spans = _report(words, windows)
            yield pa.RecordBatch.from_arrays([part.column(0), *_columns(words.counts(), n_hit, items, spans)], [key, *_NAMES])

    return run


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = N,
    what: str = "document",
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with contaminated documents removed, or (``what="span"``) their hit words cut out.

    A cut runs from the first byte of a span's first word to the last byte of its last word.
    """
    if what not in ("document", "span"):
        raise ValueError(f"what is document or span, not {what}")
    spark = docs.sparkSession
    store.bounded_batches(spark)
    at = docs.columns.index(text_col)
    pieces, count = _blocks(benchmark, item_col, item_text_col, n, block)
    if count == 1:
        return docs.mapInArrow(_remover(_broadcast(spark, _block(pieces, 0), n), at, what), docs.schema)
    row, found = store.fresh(docs, "row", "found")
    numbered = store.written(docs.select(F.monotonically_increasing_id().alias(row), "*"), "remove-documents")
    hits = _merged(numbered, text_col, row, pieces, count, n).where("contaminated").select(row, F.col("spans").alias(found))
    if what == "document":
        return numbered.join(hits, row, "left_anti").select(*docs.columns)
    return numbered.join(hits, row, "left").select(*docs.columns, found).mapInArrow(_cutter(at), docs.schema)


def _cut(part: pa.RecordBatch, at: int, words: text.Words, spans: list[list[dict[str, int]] | None]) -> pa.Array:
    """Texts without the bytes of their spans."""
    values = part.column(at).to_pylist()
    _, offsets = text.utf8(part.column(at))
    for d, own in enumerate(spans):
        if not own:
            continue
        raw, kept, last = values[d].encode(), [], 0
        for span in own:
            kept.append(raw[last : words.start[words.first[d] + span["start"]] - offsets[d]])
            last = words.end[words.first[d] + span["end"] - 1] - offsets[d]
        values[d] = b"".join([*kept, raw[last:]]).decode()
    return pa.array(values, part.schema.field(at).type)


def _cutter(at: int):
    """Rows with their spans as a last column -> rows without these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, at):
            columns = list(part.columns[:-1])
            columns[at] = _cut(part, at, text.Words(part.column(at)), part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    return run


def _remover(shared: Broadcast, at: int, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value.windows
        for part in text.slices(batches, at):
            words = text.Words(part.column(at))
            n_hit, _, spans = _report(words, windows)
            if what == "document":
                yield part.filter(pa.array(n_hit == 0))
                continue
            columns = list(part.columns)
            columns[at] = _cut(part, at, words, spans)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return run
