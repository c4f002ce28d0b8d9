"""Filter interaction audit: what each filter removes in every order of application.

Each document gets a mask, one bit for each filter that it fails. Exact duplicates are found by an RDD that is
routed by the xxhash of the text: a chain for each hash holds full texts, each with its least id, so that equal
hashes of other texts cause no error. A document that meets a smaller id of the same text is settled
at once, as failing, and goes on without its text. The chains are run on the map side first, in bounded pieces, so that
a text that fills a third of all rows arrives once for each piece; after one shuffle, sorted by hash, only the
texts of one hash are in memory. Masks are counted in vectors (documents, good ones, toxic ones), merged by ``combineByKey``
for each part, and every order of the filters is read off a part's vector of 32 masks.

Defined results: null texts are empty, null parts the empty string; a document without an id is no duplicate and makes none;
rows equal in id and text are each other's equals, so that neither fails by the other; several labels of one id count as
good (toxic) if any is; documents without a label are neither; very long texts are whole in one task; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

#: Bytes of text that the chains of the map side hold before they are sent on.
HELD = 16 << 20

#: Rows to one routed partition, and most partitions: of more rows each sorts more, on disk where they don't fit in memory.
ROUTED, MOST = 10_000, 50_000

#: Fewest words; distinct words in percent of words; capitals in percent of code points.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
_CAPITALS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

#: The filters in the order of their bits.
FILTERS = "ABCDE"
_DUPLICATE = 1 << FILTERS.index("E")
_ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]

#: Columns of a mask count vector.
_COUNTS = 3

Hash = Callable[[bytes], int]


def mask_of(raw: bytes, n_points: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # of bytes: at ASCII white space
    n = len(words)
    failed = n < LEAST_WORDS
    failed |= (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
    failed |= (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITAL_PERCENT * n_points) << 2
    return failed | (len(raw) != len(raw.translate(None, _SIGNS))) << 3


#: What travels: id, mask and rows by part. With a text it may still be a duplicate of a smaller id's.
_Settled = tuple[object, int, dict[str, int]]


class _Chains:
    """Texts by hash, each with its least id so far."""

    def __init__(self) -> None:
        self.by_hash: dict[int, dict[bytes, list]] = {}
        self.held = 0

    def add(self, key: int, raw: bytes, one: _Settled) -> Iterator[_Settled]:
        """Take a text in; what is now known to be a duplicate comes out."""
        own, mask, parts = one
        chain = self.by_hash.setdefault(key, {})
        known = chain.get(raw)
        if known is None:
            chain[raw] = [own, mask, parts]
            self.held += len(raw) + 100
        elif own == known[0]:
            for part, n in parts.items():
                known[2][part] = known[2].get(part, 0) + n
        elif own < known[0]:
            yield known[0], mask | _DUPLICATE, known[2]
            known[0], known[2] = own, parts
        else:
            yield own, mask | _DUPLICATE, parts

    def drain(self) -> Iterator[tuple[int, bytes, _Settled]]:
        for key, chain in self.by_hash.items():
            for raw, (own, mask, parts) in chain.items():
                yield key, raw, (own, mask, parts)
        self.by_hash, self.held = {}, 0


def _own_chains(rows: Iterator[tuple], hashed: Hash, held: int) -> Iterator[tuple[int, tuple[bytes | None, _Settled]]]:
    """Keyed rows of one task: settled ones without text, spread by their id, and one row for each text and piece."""
    chains = _Chains()

    def settled(one: _Settled) -> tuple[int, tuple[bytes | None, _Settled]]:
        return xxhash.xxh64_intdigest(repr(one[0]).encode()), (None, one)

    for own, part, text in rows:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        one = own, mask_of(raw, len(text)), {part or "": 1}
        if own is None:
            yield settled(one)
            continue
        for lost in chains.add(hashed(raw), raw, one):
            yield settled(lost)
        if chains.held > held:
            yield from ((key, (raw, one)) for key, raw, one in chains.drain())
    yield from ((key, (raw, one)) for key, raw, one in chains.drain())


def _met_chains(rows: Iterator[tuple[int, tuple[bytes | None, _Settled]]]) -> Iterator[_Settled]:
    """Rows sorted by hash: the duplicates, then the least id of each text."""
    for key, group in itertools.groupby(rows, key=lambda kv: kv[0]):
        chains = _Chains()
        for _, (raw, one) in group:
            if raw is None:
                yield one
            else:
                yield from chains.add(key, raw, one)
        yield from (one for _, _, one in chains.drain())


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hashed: Hash = xxhash.xxh64_intdigest, held: int = HELD) -> DataFrame:
    """id, part, mask and the number of such rows; every document is in one of them."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col), F.col(part_col).cast("string"), F.col(text_col))
    kind = source.schema[0].dataType
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(source.count() // ROUTED, MOST))
    routed = source.rdd.mapPartitions(lambda x: _own_chains(x, hashed, held)).repartitionAndSortWithinPartitions(count, lambda key: key % count)
    found = routed.mapPartitions(_met_chains).flatMap(lambda one: [(one[0], part, one[1], n) for part, n in one[2].items()])
    return _frame(docs, found, [("id", kind), ("part", StringType()), ("mask", IntegerType()), ("n", LongType())])


def _frame(docs: DataFrame, rows: RDD, columns: list[tuple[str, DataType]]) -> DataFrame:
    return docs.sparkSession.createDataFrame(rows, StructType([StructField(*c) for c in columns]), verifySchema=False)


def _zero() -> list[int]:
    return [0] * (_COUNTS * (1 << len(FILTERS)))


def _count(vector: list[int], value: tuple[int, int, bool, bool]) -> list[int]:
    mask, n, good, toxic = value
    at = _COUNTS * mask
    vector[at] += n
    vector[at + 1] += n * good
    vector[at + 2] += n * toxic
    return vector


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def vectors(found: DataFrame, labels: DataFrame) -> RDD:
    """Per part: the mask count vector of its documents."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    counted = found.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "id", "left")
    rows = counted.select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd
    return rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda v: _count(_zero(), v), _count, _merge)


def orders(vector: list[int]) -> Iterator[tuple]:
    """Rows of one part: filter order, step and counts, for all orders and steps."""
    counts = [vector[k : k + _COUNTS] for k in range(0, len(vector), _COUNTS)]
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    alone = {f: counts[bit][0] for f, bit in bits.items()}
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in _ORDERS:
        before = 0
        for step, f in enumerate(order, 1):
            bit = bits[f]
            here = [sum(c[j] for m, c in enumerate(counts) if m & bit and not m & before) for j in range(_COUNTS)]
            redundant = sum(c[0] for m, c in enumerate(counts) if m & bit and m & before)
            before |= bit
            kept = sum(c[0] for m, c in enumerate(counts) if not m & before)
            shapley[f] += here[0]
            rows.append((f, order, step, kept, here[0], redundant, alone[f], here[1], here[2]))
    for f, *row in rows:
        yield (*row, shapley[f])


def report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, filter order and step: what that step removes and what stays."""
    found = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    rows = vectors(found, labels).flatMap(lambda kv: [(kv[0], *row) for row in orders(kv[1])])
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return _frame(docs, rows, [("part", StringType()), ("filter_order", StringType()), ("step", IntegerType()), *((c, LongType()) for c in counts)])
