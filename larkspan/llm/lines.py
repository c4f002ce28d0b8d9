"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines (trimmed) are a window, known by a 128-bit hash. The first occurrence of a
window is the one of least (id, text hash, position); every later occurrence, in whichever document,
covers its three lines, and covered positions are merged and removed. Windows of blank lines only are
not counted. The first occurrences are found by a pre-aggregated group-by and joined back, so that a
window shared by a third of all rows is neither gathered nor paired.

Defined results: null texts stay null, and with empty texts and those of fewer than three lines have
nothing removed; null ids order last, ids that are not integers by their text; rows equal in id and text are one
occurrence (both keep it), and so there are no ties; very long texts are cut whole, each in a slice of its own;
an empty table gives an empty result; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from larkspan.llm import store, text

#: Lines of a window.
WINDOW = 3

_ID, _HASH, _POS = "__id", "__hash", "__pos"


def _key(kind: DataType, id_col: str, text_col: str) -> list[Column]:
    """The order of documents: the id (null last; ids that are not integers by their text), then a hash of the text."""
    own = F.col(id_col)
    whole = isinstance(kind, IntegralType)
    order = F.coalesce(own.cast("long"), F.lit((1 << 63) - 1)) if whole else F.coalesce(F.concat(F.lit("0"), own.cast("string")), F.lit("1"))
    return [order.alias(_ID), F.xxhash64(F.col(text_col)).alias(_HASH)]


def windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per window: its hash (two longs), document and position of its first line."""
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(x))
    # one struct of two hashes a line; a blank line's is null
    hashed = F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(window), x).alias("b"))))
    starts = F.sequence(F.lit(0), F.size("__lines") - window)

    def part(i: Column, side: str) -> Column:
        return F.xxhash64(F.lit(side), *(F.coalesce(F.get("__lines", i + k)[side], F.lit(k)) for k in range(window)))

    made = F.transform(
        starts,
        lambda i: F.when(
            F.coalesce(*(F.get("__lines", i + k)["a"] for k in range(window))).isNotNull(),
            F.struct(i.alias(_POS), part(i, "a").alias("a"), part(i, "b").alias("b")),
        ),
    )
    each = docs.select(*_key(docs.schema[id_col].dataType, id_col, text_col), hashed.alias("__lines")).where(F.size("__lines") >= window)
    return each.select(_ID, _HASH, F.explode(made).alias("w")).where("w is not null").select(_ID, _HASH, "w.*")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document with any: the positions of windows that occurred before."""
    every = windows(docs, id_col=id_col, text_col=text_col, window=window)
    here = F.struct(_ID, _HASH, _POS)
    first = every.groupBy("a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = every.join(first, ["a", "b"]).where(here > F.col("first"))
    return later.groupBy(_ID, _HASH).agg(F.collect_set(_POS).alias("__later"))


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    found = repeated(docs, id_col=id_col, text_col=text_col, window=window)
    names = store.fresh(docs, "id", "hash", "later")
    keys = [key.alias(name) for key, name in zip(_key(docs.schema[id_col].dataType, id_col, text_col), names, strict=False)]
    found = found.withColumnsRenamed(dict(zip((_ID, _HASH, "__later"), names, strict=True)))
    return docs.select("*", *keys).join(found, names[:2], "left").select(*docs.columns, names[2])


def _covered(later: list[int] | None, n: int, window: int) -> np.ndarray:
    mark = np.zeros(n, bool)
    for k in range(window):
        mark[np.asarray(later or [], np.int64) + k] = True
    return mark


def _cut(value: str | None, later: list[int] | None, window: int) -> tuple[str | None, int, int]:
    """The text without covered lines, its lines and how many went."""
    if value is None:
        return None, 0, 0
    lines = value.split("\n")
    if not later:
        return value, len(lines), 0
    mark = _covered(later, len(lines), window)
    return "\n".join(x for x, gone in zip(lines, mark, strict=True) if not gone), len(lines), int(mark.sum())


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with covered lines removed; a document that loses all its lines goes.

    Columns as in ``docs``. What a removed document held stands in an earlier one.
    """
    store.bounded_batches(docs.sparkSession)
    marked = _marked(docs, id_col, text_col, window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, at):
            cut = [_cut(v, p, window) for v, p in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
            columns = list(part.columns[:-1])
            columns[at] = pa.array([c[0] for c in cut], part.schema.field(at).type)
            out = pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])
            yield out.filter(pa.array([not n or gone < n for _, n, gone in cut]))

    return marked.mapInArrow(run, docs.schema)


SCHEMA = "n_lines long, n_removed long, kept string"


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, lines, lines removed, and the text that stays (null: null)."""
    store.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col))
    field = source.schema[0]
    marked = _marked(source, source.columns[0], source.columns[1], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            cut = [_cut(v, p, window) for v, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            kept, lines, gone = zip(*cut, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [field.name, "n_lines", "n_removed", "kept"])

    return marked.mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, {SCHEMA}")
