"""Names inside texts: one pass over each text by an Aho-Corasick automaton of all names.

The automaton is built once in each Python worker from a broadcast list of names. Names of more than ``SHARD`` characters together are dealt by hash to
lists of about that size, each a pass of its own over the texts, one after the other, so that driver and workers hold one at a time. The output grows with what is found, the work with
the length of the texts: no text is cut into parts and none meets every name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.session import shared_folder

#: Characters of names in one list (an automaton takes about a hundred bytes for each).
SHARD = 1_000_000
#: Lines whose words are looked up at once.
ROWS = 256


class _Names:
    """A list of names, and its automaton in each worker."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def __reduce__(self):
        return _Names, (self.names,)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.names:
            return None
        out = ahocorasick.Automaton()
        for name in self.names:
            out.add_word(name, name)
        out.make_automaton()
        return out

    @cached_property
    def values(self) -> pa.Array:
        return pa.array(self.names, pa.string())


def _found(text: str | None, names: _Names, marks: dict[str, re.Pattern]) -> list[dict[str, object]]:
    """Each name that a text has, in the order of first occurrences: how often, where first, and of each mark whether any, and whether every occurrence has it behind."""
    if not text or names.automaton is None:
        return []
    out: dict[str, dict[str, object]] = {}
    for last, name in names.automaton.iter(text):
        here = {m: p.match(text, last + 1) is not None for m, p in marks.items()}
        known = out.get(name)
        if known is None:
            out[name] = {"name": name, "n": 1, "first": last + 1 - len(name)} | {f"{m}_any": x for m, x in here.items()} | {f"{m}_all": x for m, x in here.items()}
            continue
        known["n"] += 1
        for m, x in here.items():
            known[f"{m}_any"] |= x
            known[f"{m}_all"] &= x
    return sorted(out.values(), key=lambda f: (f["first"], f["name"]))


def _lists(names: DataFrame, shard: int) -> tuple[DataFrame, int]:
    distinct = names.select(F.col("name")).where("name <> ''").distinct()
    total = distinct.agg(F.sum(F.length("name"))).first()[0] or 0
    return distinct, -(-total // shard) or 1


def _shared(names: DataFrame, number: int, count: int) -> Broadcast:
    """The names of one list, broadcast."""
    own = names if count == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(count)) == number)
    return names.sparkSession.sparkContext.broadcast(_Names(sorted(r.name for r in own.collect())))


def inside(texts: DataFrame, names: DataFrame, text: str, *, marks: dict[str, str] | None = None, shard: int = SHARD) -> DataFrame:
    """``texts`` and ``found``: for each name that a text has, struct(name, n, first, <mark>_any, <mark>_all) by first occurrence.

    marks: patterns that are tried right behind each occurrence. Null and empty texts have no names; occurrences may overlap; a name is found within words.
    """
    patterns = {m: re.compile(p) for m, p in (marks or {}).items()}
    fields = "".join(f", {m}_any: boolean, {m}_all: boolean" for m in patterns)
    kind = f"array<struct<name: string, n: int, first: int{fields}>>"
    arrow = pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32()), ("first", pa.int32()), *((f"{m}_{x}", pa.bool_()) for m in patterns for x in ("any", "all"))]))
    own, count = _lists(names, shard)

    def scanner(shared: Broadcast, at: int, keep: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_found(x, shared.value, patterns) for x in batch.column(at).to_pylist()]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow)], [*keep, "found"])

        return run

    if count == 1:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
        return texts.mapInArrow(scanner(_shared(own, 0, 1), texts.columns.index(text), texts.columns), f"{schema}, found {kind}")
    spark, base = texts.sparkSession, shared_folder(texts.sparkSession, "gazetteer")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    numbered = written(texts.withColumn("__row", F.monotonically_increasing_id()), "texts")
    parts = []
    for number in range(count):
        shared = _shared(own, number, count)
        slim = numbered.select("__row", F.col(text)).mapInArrow(scanner(shared, 1, ["__row"]), f"__row long, found {kind}")
        parts.append(written(slim.where(F.size("found") > 0), f"found-{number}"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(F.flatten(F.collect_list("found")).alias("found"))
    order = F.array_sort("found", lambda a, b: F.when((a["first"] < b["first"]) | ((a["first"] == b["first"]) & (a["name"] < b["name"])), -1).otherwise(1))
    return numbered.join(every.select("__row", order.alias("found")), "__row", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {kind})"))).drop("__row")


# What stands behind a name that is a station; behind one that is a destination or a line, not a place to board.
STATION = r"[」』]?\s*駅"
NOT_BOARDED = r"[」』]?\s*駅?(?=\s{0,2}[行線]|\s?(?:方面|ゆき|経由))"


def boarding(found: Column) -> Column:
    """The name at which a line boards: one that is somewhere no destination or line; those called a station (of two characters) first, then any of three; the longest, then the first by name.

    found: of ``inside`` with the marks ``called`` (``STATION``) and ``refused`` (``NOT_BOARDED``).
    """
    able = F.filter(found, lambda f: ~f["refused_all"] & ((f["called_any"] & (F.length(f["name"]) >= 2)) | (F.length(f["name"]) >= 3)))
    order = F.transform(able, lambda f: F.struct((~f["called_any"]).alias("x"), (-F.length(f["name"])).alias("y"), f["name"].alias("name")))
    return F.array_min(order)["name"]


def boarded(lines: DataFrame, names: DataFrame, keys: list[str], line: str, *, shard: int = SHARD) -> DataFrame:
    """keys and the name of the place at which each line boards, for lines that have one."""
    rows = inside(lines.select(*keys, F.col(line).alias("__line")), names, "__line", marks={"called": STATION, "refused": NOT_BOARDED}, shard=shard)
    return rows.select(*keys, boarding(F.col("found")).alias("name")).where("name is not null")


def words(lines: DataFrame, names: DataFrame, *, suffix: str, rejected: tuple[str, ...], least: tuple[int, int] = (2, 3), shard: int = SHARD) -> DataFrame:
    """The name found in each line of words: first names followed by the suffix, then bare ones; the longest, then the first.

    lines: line_id and words, an array of struct(word, next). Words are looked up within their arrays, in Arrow's hash sets; only words that are names leave them. A name
    before a rejected word doesn't count.
    """
    own, count = _lists(names, shard)
    kind = lines.schema["line_id"].dataType.simpleString()
    names_of = ["line_id", "pos", "word", "next"]

    def scanner(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(first, ROWS)
                    listed = batch.column(1)
                    flat, offsets = listed.flatten(), listed.offsets.to_numpy()
                    hit = pc.is_in(flat.field(0), value_set=shared.value.values)
                    chosen = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
                    rows = np.searchsorted(offsets - offsets[0], chosen, side="right") - 1
                    at = chosen - (offsets[rows] - offsets[0])
                    of = pa.array(chosen)
                    columns = [batch.column(0).take(pa.array(rows)), pa.array(at, pa.int32()), flat.field(0).take(of), flat.field(1).take(of)]
                    yield pa.RecordBatch.from_arrays(columns, names_of)

        return run

    view = lines.select("line_id", "words")
    parts = [view.mapInArrow(scanner(_shared(own, number, count)), f"line_id {kind}, pos int, word string, next string") for number in range(count)]
    hits = reduce(DataFrame.unionByName, parts).where(~F.coalesce(F.col("next").isin(*rejected), F.lit(False)))
    suffixed = F.coalesce(F.col("next") == suffix, F.lit(False))
    able = hits.where(F.when(suffixed, F.length("word") >= least[0]).otherwise(F.length("word") >= least[1]))
    best = F.min(F.struct((~suffixed).alias("bare"), (-F.length("word")).alias("length"), "pos", "word"))
    return able.groupBy("line_id").agg(best.alias("b")).select("line_id", F.col("b.word").alias("name"), (~F.col("b.bare")).alias("suffixed"))
