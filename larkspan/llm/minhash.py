"""Near-duplicate documents: DartMinHash signatures, banded joins, exact verification.

A document is the weighted set of its shingles of five normalised words. Darts are thrown into the plane of
each shingle: their number in a region of dyadic width (weight) and height (rank) is Poisson distributed, and
number, place and coordinate of every dart follow from hashes of the shingle and region alone. A dart hits if
it lies below the shingle's weight; each of the ``BANDS * ROWS`` coordinates of the signature keeps the hit of
least rank. Ranks are searched up to a height at which a set gets some k ln k + 2k darts; a set that leaves a
coordinate empty is searched twice as high. Two signatures agree in a coordinate with probability of the weighted
Jaccard similarity of their sets.

Rows with the same word sequence collapse to one node. Nodes that share a band are linked to the least
node of the band; the components of these links are clusters of candidates. Within a cluster all pairs are
compared exactly, in blocks of at most ``BLOCK`` nodes a side, each of which returns a spanning forest of the pairs
whose Jaccard similarity is ``SIMILARITY`` or more. Components of these forests are the classes: no link is lost
within a cluster, and a pair of similarity 0.8 shares no band with a probability of 8e-5.

Weights are 1 unless ``weights="count"`` makes them the shingles' multiplicity; similarity is Jaccard's,
weighted likewise.

Defined results: null, empty and wordless texts are classes of their own; a text of fewer than five words has one
shingle, all its words; the class id is the least id of the class (null only if all are null); of equal ids the row
read first stays; repeated rows are in one class, of which one row stays; very long texts are taken whole, each in a
slice of its own; ids are of any type; other columns, whatever their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import components, store, text

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 7
#: Nodes of one side of a block that is compared in one task.
BLOCK = 512
#: Rows of small columns up to which a table is broadcast (under 50 bytes each).
BROADCAST = 400_000

#: Height of the lowest region of ranks; each further one is as high as all below it.
_FLOOR = 0.5


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson variable, up to where it is 1 in double precision."""
    size = int(mean + 12 * math.sqrt(mean) + 30)
    logs = np.arange(size) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(size)])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


_TABLES: dict[float, np.ndarray] = {}


def _throw(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, reach: np.ndarray, k: int, out: np.ndarray) -> None:
    """Keep in ``out`` (sets times k) the darts of least rank, up to the rank ``reach`` of each set.

    A dart is packed as its rank (a positive float32, ordered like its bits) and 32 bits of its hash.
    """
    top = float(reach[owner].max())
    low, layer = 0.0, 0
    while low < top:
        high = _FLOOR * 2.0**layer
        near = reach[owner] > low
        left, width_layer = 0.0, 0
        heaviest = float(weights[near].max())
        while left < heaviest:
            right = 2.0**width_layer
            use = near & (weights > left)
            mean = (high - low) * (right - left)
            table = _TABLES.setdefault(mean, _poisson(mean))
            base = text.mix(elements[use] + np.uint64((layer * 64 + width_layer + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            number = np.searchsorted(table, _unit(base))
            dart = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            own, heavy = np.repeat(owner[use], number), np.repeat(weights[use], number)
            first = text.mix(np.repeat(base, number) + (dart.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            second = text.mix(first ^ np.uint64(0x5851F42D4C957F2D))
            rank = low + (high - low) * _unit(first)
            hit = rank < reach[own]
            if len(heavy) and float(heavy.min()) < right:
                hit &= left + (right - left) * _unit(text.mix(second)) < heavy
            own, rank, second = own[hit], rank[hit], second[hit]
            packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | second >> np.uint64(32)
            np.minimum.at(out, own * k + (second % np.uint64(k)).astype(np.int64), packed)
            left, width_layer = right, width_layer + 1
        low, layer = high, layer + 1


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n rows of k) of n non-empty weighted sets, given as (set, element, weight > 0)."""
    none = np.iinfo(np.uint64).max
    out = np.full(n * k, none, np.uint64)
    darts = k * math.log(k) + 2 * k
    reach = darts / np.bincount(owner, weights, n)
    todo = np.arange(n)
    while len(todo):
        chosen = np.isin(owner, todo) if len(todo) < n else slice(None)
        at = np.full(n, -1)
        at[todo] = np.arange(len(todo))
        part = np.full(len(todo) * k, none, np.uint64)
        _throw(at[owner[chosen]], elements[chosen], weights[chosen], reach[todo], k, part)
        out.reshape(n, k)[todo] = part.reshape(-1, k)
        todo = todo[(part.reshape(-1, k) == none).any(axis=1)]
        reach[todo] *= 2
    return out.reshape(n, k)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` coordinates; equal only within the same band."""
    parts = signature.reshape(len(signature), -1, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        out = text.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return text.mix(out + np.arange(parts.shape[1], dtype=np.uint64))


def shingle_sets(words: text.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and multiplicity of the distinct shingles of each text, in order of both."""
    grams, at = text.ngrams(words, n)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    return owner[starts], grams[starts], np.diff(np.append(starts, len(grams)))


def _digest(words: text.Words, d: int) -> tuple[int, int]:
    raw = hashlib.blake2b(words.hashes[words.first[d] : words.first[d + 1]].tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _digests(words: text.Words) -> list[pa.Array]:
    """Two halves of a digest of each text's words; null without words."""
    both = [_digest(words, d) if n else (None, None) for d, n in enumerate(words.counts().tolist())]
    return [pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)]


def _sketch(docs: DataFrame, shingle: int, weights: str, n_bands: int, rows: int) -> DataFrame:
    """id, digest and band hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            words = text.Words(part.column(1))
            owner, grams, times = shingle_sets(words, shingle)
            held = np.unique(owner)
            found: list = [None] * part.num_rows
            if len(held):
                weight = times.astype(np.float64) if weights == "count" else np.ones(len(grams))
                hashed = bands(signatures(np.searchsorted(held, owner), grams, weight, len(held), n_bands * rows), rows).view(np.int64)
                for i, d in enumerate(held.tolist()):
                    found[d] = hashed[i]
            yield pa.RecordBatch.from_arrays([part.column(0), *_digests(words), pa.array(found, pa.list_(pa.int64()))], ["id", "da", "db", "bands"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, da long, db long, bands array<long>")


def _similar(a: list[np.ndarray], b: list[np.ndarray], wa: list[np.ndarray], wb: list[np.ndarray], wanted: float, exact_sets: bool) -> np.ndarray:
    """Which pairs of two lists of sets (sorted elements, weights) have at least the wanted similarity."""
    sizes = [np.array([w.sum() for w in x], np.float64) for x in (wa, wb)]
    common = np.zeros((len(a), len(b)))
    flat = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(flat[0], flat[1])
    if len(shared):
        heavy = [np.concatenate(x) for x in (wa, wb)]
        row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
        place = [np.minimum(np.searchsorted(shared, f), len(shared) - 1) for f in flat]
        here = [shared[p] == f for p, f in zip(place, flat, strict=True)]
        step = max(1, (1 << 22) // max(len(a), len(b)))
        if exact_sets:
            for start in range(0, len(shared), step):
                m = []
                for s in (0, 1):
                    use = here[s] & (place[s] >= start) & (place[s] < start + step)
                    x = np.zeros((len((a, b)[s]), min(step, len(shared) - start)), np.float32)
                    x[row[s][use], place[s][use] - start] = 1
                    m.append(x)
                common += m[0] @ m[1].T
        else:
            for i in range(len(a)):
                own = np.zeros(len(shared))
                use = here[0] & (row[0] == i)
                own[place[0][use]] = heavy[0][use]
                common[i] = np.bincount(row[1][here[1]], np.minimum(own[place[1][here[1]]], heavy[1][here[1]]), len(b))
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common >= wanted * union - 1e-9


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite relation: pairs (row, column)."""
    out = []
    free_rows, free_columns = near.any(axis=1), near.any(axis=0)
    while free_rows.any():
        queue = [int(np.flatnonzero(free_rows)[0])]
        free_rows[queue[0]] = False
        while queue:
            i = queue.pop()
            columns = np.flatnonzero(near[i] & free_columns)
            free_columns[columns] = False
            for j in columns.tolist():
                out.append((i, j))
                rows = np.flatnonzero(near[:, j] & free_rows)
                free_rows[rows] = False
                out += [(r, j) for r in rows.tolist()]
                queue += rows.tolist()
    return out


def _compare(batches: Iterator[pa.RecordBatch], wanted: float, exact_sets: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; each group is one block of a cluster, or two."""

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        left = [g for g in group if g[1] == g[0][1]]
        right = left if group[0][0][1] == group[0][0][2] else [g for g in group if g[1] == g[0][2]]
        if not left or not right:
            return []
        near = _similar([g[3] for g in left], [g[3] for g in right], [g[4] for g in left], [g[4] for g in right], wanted, exact_sets)
        pairs = {tuple(sorted((left[i][2], right[j][2]))) for i, j in _forest(near)}
        return [p for p in pairs if p[0] != p[1]]

    group: list[tuple] = []
    found: list[tuple[int, int]] = []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        weights = batch.column(6).to_pylist()
        for i in range(batch.num_rows):
            key = (cols[0][i], cols[1][i], cols[2][i])
            if group and group[0][0] != key:
                found += links(group)
                group = []
            group.append((key, cols[3][i], cols[4][i], np.frombuffer(cols[5][i], np.uint64), np.frombuffer(weights[i], np.uint32)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])
            found = []
    if group and (found := links(group)):
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int, weights: str, broadcast: int) -> DataFrame:
    """cluster, size, node and shingle set of every node in a cluster; the text is found by id and digest."""
    small = nodes.count() <= broadcast
    joined = docs.join(F.broadcast(nodes) if small else nodes, F.col("id").eqNullSafe(F.col("first_id"))).select("node", "text", "da", "db", "cluster", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            words = text.Words(part.column(1))
            mine = [a == b for a, b in zip(zip(*(x.to_pylist() for x in _digests(words)), strict=True), zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True), strict=True)]
            owner, grams, times = shingle_sets(words, shingle)
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            times = times if weights == "count" else np.ones(len(times), np.uint32)
            sets = [grams[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            heavy = [times[a:b].astype(np.uint32).tobytes() for a, b in zip(at, at[1:], strict=False)]
            out = pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(5), pa.array(sets, pa.binary()), pa.array(heavy, pa.binary())], ["node", "cluster", "blocks", "grams", "times"])
            yield out.filter(pa.array(mine))

    return joined.mapInArrow(run, "node long, cluster long, blocks int, grams binary, times binary").dropDuplicates(["node"])


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    weights: str = "one",
    n_bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    broadcast: int = BROADCAST,
) -> DataFrame:
    """Per row: id, digest (da, db), class_id, and whether the row is the one of its class that stays."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = store.written(_sketch(source, shingle, weights, n_bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # one node for each word sequence: the least row that has it
    groups = store.written(sketched.where("da is not null").groupBy("da", "db").agg(F.min("row").alias("node"), F.min("id").alias("first_id")), "nodes")
    buckets = sketched.select("row", "bands").join(groups.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    pivots = buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").drop("last")
    linked = buckets.join(pivots, "band").where("node <> pivot").select("node", "pivot").distinct()
    clusters = store.written(components.components(linked, "node", "pivot"), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    nodes = store.written(groups.join(clusters, "node").join(sizes, "component").select("node", "first_id", "da", "db", F.col("component").alias("cluster"), "blocks"), "candidates")
    sets = _sets(source, nodes, shingle, weights, broadcast)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "grams", "times")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    edges = dealt.mapInArrow(lambda b: _compare(b, similarity, weights != "count"), "a long, b long")
    joined = components.components(edges, "a", "b")
    of_class = groups.join(joined, "node", "left").select("da", "db", "first_id", "node", F.coalesce("component", "node").alias("component"))
    # the row that stays: the least id of the class (null last), of its rows the least
    least = store.written(of_class, "classes")
    heads = least.groupBy("component").agg(F.min("first_id").alias("class_id"))
    small = sketched.select("row", "id", "da", "db")
    known = small.join(least.select("da", "db", "component"), ["da", "db"], "left").select("row", "id", "da", "db", F.coalesce("component", "row").alias("component"))
    stays = known.join(heads.select("component", F.col("class_id").alias("head")), "component", "left")
    chosen = stays.where(F.col("id").eqNullSafe(F.coalesce("head", "id"))).groupBy("component").agg(F.min("row").alias("chosen"))
    return stays.join(chosen, "component", "left").select("id", "da", "db", F.coalesce("head", "id").alias("class_id"), (F.col("row") == F.col("chosen")).alias("stays"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST, **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    keys = store.fresh(docs, "kid", "ka", "kb")
    found = store.written(classes(docs, id_col=id_col, text_col=text_col, broadcast=broadcast, **options), "stays").where("da is not null")
    rows = found.select(*(F.col(c).alias(k) for c, k in zip(("id", "da", "db"), keys, strict=True)), "stays")
    stay, gone = rows.where("stays").select(*keys), rows.where("not stays").select(*keys)
    # a row that goes has another id or other words than the one that stays, unless a row is repeated
    dropped, repeated = store.written(gone.subtract(stay), "dropped"), store.written(gone.intersect(stay), "repeated")
    at = docs.columns.index(text_col)
    da, db = store.fresh(docs, "da", "db")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, *_digests(text.Words(part.column(at)))], [*part.schema.names, da, db])

    marked = docs.mapInArrow(mark, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{da} long", f"{db} long"]))

    def same(side: DataFrame):
        return marked[id_col].eqNullSafe(side[keys[0]]) & (marked[da] == side[keys[1]]) & (marked[db] == side[keys[2]])

    small = dropped.count() <= broadcast
    out = marked.join(F.broadcast(dropped) if small else dropped, same(dropped), "left_anti")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    once = out.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, da, db])
    return out.join(repeated, same(repeated), "left_anti").unionByName(once).select(*docs.columns)
