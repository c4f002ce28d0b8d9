"""Operators over ordered rows: carrying forward, joining broken lines, neighbours, segments."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to each row of its group."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def unwrap(lines: DataFrame, group: str, order: str, line: str, *, long: int = 30, ends: str = r"[。．.!！?？」）)]$") -> DataFrame:
    """Lines joined to the one before if that is long and doesn't end a sentence."""
    before = F.lag(line).over(Window.partitionBy(group).orderBy(order))
    starts = F.when(before.isNull() | (F.length(before) < long) | before.rlike(ends), 1).otherwise(0)
    numbered = lines.withColumn("__starts", starts).withColumn("paragraph", F.sum("__starts").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"])
    return numbered.groupBy(group, "paragraph").agg(F.array_join(parts, "").alias("text"), F.count("*").alias("lines"))


def neighbours(rows: DataFrame, group: list[str], order: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with its successor in the group; the last row of a group has none."""
    along = Window.partitionBy(*group).orderBy(order)
    out = rows
    for c in columns:
        out = out.withColumn(prefix + c, F.lead(c).over(along))
    return out.where(F.col(prefix + columns[0]).isNotNull())


def pairs_within(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Ordered pairs of distinct members of a group (groups are small by nature: lines at one station)."""
    left = rows.select(group, F.col(member).alias("a")).distinct()
    return left.join(left.withColumnRenamed("a", "b"), group).where("a <> b")


def segments(text: Column, marker: str) -> Column:
    """The parts of a text between markers, each with the marker before it (the first has none)."""
    marks = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"({marker})"), 1))
    return F.zip_with(marks, F.split(text, marker, -1), lambda m, s: F.struct(m.alias("marker"), s.alias("body")))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)``, for which x is evaluated once, however often it occurs there; an expression that repeats a column repeats all that it is made of."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


#: Texts that a pass in Python takes apart before what it found goes into Arrow arrays.
STEP = 256


def _arrays(texts: pa.Array, scan: Callable[[str], list[tuple]], kind: pa.ListType) -> pa.Array:
    def part(some: list[str | None]) -> pa.Array:
        rows, offsets, n = [None if x is None else scan(x) for x in some], [], 0
        for r in rows:
            offsets.append(None if r is None else n)
            n += len(r or ())
        fields = list(kind.value_type)
        columns = list(zip(*(m for r in rows if r for m in r), strict=True)) or [()] * len(fields)
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
        return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), values).cast(kind)

    return pa.concat_arrays([part(texts.slice(at, STEP).to_pylist()) for at in range(0, len(texts), STEP)] or [pa.array([], kind)])


def _scanned(text: Column, scan: Callable[[str], list[tuple]], **fields: pa.DataType) -> Column:
    """What ``scan`` finds in each text, as an array of structs; no more than ``STEP`` texts are held as Python's objects."""
    kind = pa.list_(pa.struct(list(fields.items())))
    names = {pa.int32(): "int", pa.string(): "string"}

    @F.arrow_udf(f"array<struct<{', '.join(f'{k}: {names[t]}' for k, t in fields.items())}>>")
    def found(texts: pa.Array) -> pa.Array:
        return _arrays(texts, scan, kind)

    return found(text)


def finditer(text: Column, pattern: str) -> Column:
    """All matches of a pattern from left to right, as ``matches`` gives them, of texts of any length: one pass in Python's regular expressions."""
    wanted = re.compile(pattern)
    return _scanned(text, lambda x: [(*m.span(), m.group()) for m in wanted.finditer(x)], start=pa.int32(), end=pa.int32(), match=pa.string())


def lookbacks(text: Column, anchor: str, pattern: str, size: int = 300) -> Column:
    """For every anchor of a text the last match of a pattern in the ``size`` characters before it (null: none): array of struct(at, match)."""
    here, wanted = re.compile(anchor), re.compile(pattern)

    def last(text: str, at: int) -> str | None:
        found = None
        for m in wanted.finditer(text[max(0, at - size) : at]):
            found = m.group()
        return found

    return _scanned(text, lambda x: [(m.start(), last(x, m.start())) for m in here.finditer(x)], at=pa.int32(), match=pa.string())


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern from left to right: array of struct(start, end, match), by characters from 0."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("all"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("all"))
    return F.aggregate(F.zip_with(between, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), none, step, lambda acc: acc["all"])


def layered(text: Column, patterns: list[str], *, lead: str = "", first: int = 0) -> Column:
    """Matches of patterns, layer by layer, without those that overlap a match of a layer before; in the order of the text.

    array of struct(start, end, layer, match). Every layer reads the text as it is. What a match begins with and ``lead`` covers takes no room:
    it may be shared. Layers are numbered from ``first``. One pass for each layer in Python's regular expressions, with the classes of ASCII.
    """
    layers, before = [re.compile(p, re.ASCII) for p in patterns], re.compile(lead, re.ASCII)

    def scan(x: str) -> list[tuple]:
        found: list[tuple] = []
        # room that is taken, in order; no two overlap
        taken: list[tuple[int, int]] = []
        for layer, wanted in enumerate(layers, first):
            new = []
            for m in wanted.finditer(x):
                start, end = m.span()
                room = start + len(before.match(m.group()).group()) if lead else start
                i = bisect_left(taken, (end,))
                if i and taken[i - 1][1] > room:
                    continue
                found.append((start, end, layer, m.group()))
                new.append((room, end))
            for one in new:
                insort(taken, one)
        return sorted(found)

    return _scanned(text, scan, start=pa.int32(), end=pa.int32(), layer=pa.int32(), match=pa.string())


def positional(rows: DataFrame, keys: list[str], values: str, names: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Arrays by position, as rows of keys, the name at that position (from 0) and the value."""
    each = rows.select(*keys, F.posexplode(values).alias(pos, "value"))
    return each.join(names.select(pos, name), pos).select(*keys, name, "value")
