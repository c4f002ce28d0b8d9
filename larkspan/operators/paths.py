"""Shortest paths by delta stepping over partitioned edges, with predecessors, and their routes.

Distances of all origins are one table. Its rows fall into buckets of ``delta`` minutes, which are settled in order: edges of up to ``delta`` minutes are relaxed
from what a round has improved within the bucket until nothing falls into it any more, then longer ones once. Each round is one join of that frontier with the edges and one
with what is known; the driver sees counts only. A bucket has at most delta / (shortest edge) + 1 rounds, so that rounds are bounded by the cap and not by the size of the graph.

``shortest_routes`` first looks for the parts of the graph that hang together: each task joins what hangs together among its own edges, and only one row for each of its nodes goes on. Parts of a
bounded number of edges are searched each by the tasks that its origins are dealt to, so that what is relaxed never leaves a task; what hangs together in more edges is settled bucket by bucket.
Edges are written once and shuffled once, to the task that searches them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.session import shared_folder

#: Edges of a part that one task may hold (under 200 bytes each), and rounds in which parts are looked for.
PART, ROUNDS = 2_000_000, 20
#: Pairs that a task gathers before it joins them, sources whose parts are broadcast, and nodes of routes in one batch of results.
GATHERED, BROADCAST, BATCH = 1_000_000, 1_000_000, 500_000


class _Tables:
    """Tables that are written round by round, which cuts lineage."""

    def __init__(self, like: DataFrame, name: str) -> None:
        self.spark, self.base, self.numbers = like.sparkSession, shared_folder(like.sparkSession, name), itertools.count()

    def kept(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{next(self.numbers)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _least(rows: DataFrame) -> DataFrame:
    """The least minutes of each origin and node; of equal ones no predecessor first, then the first."""
    best = F.min(F.struct("minutes", F.col("prev").isNotNull().alias("later"), "prev")).alias("b")
    return rows.groupBy("origin", "node").agg(best).select("origin", "node", "b.minutes", "b.prev")


def _able(edges: DataFrame, cap: float) -> DataFrame:
    """src, dst and ride of edges that a way within the cap can take."""
    able = edges.where("src is not null and dst is not null and minutes >= 0").where(F.col("minutes") <= cap)
    return able.select("src", "dst", F.col("minutes").alias("ride"))


def _usable(edges: DataFrame, cap: float) -> DataFrame:
    """src, dst and ride: the least edge of each pair that a way within the cap can take."""
    return _able(edges, cap).groupBy("src", "dst").agg(F.min("ride").alias("ride"))


def delta_stepping(edges: DataFrame, starts: DataFrame, *, cap: float, delta: float) -> DataFrame:
    """origin, node, minutes and prev (the node before, null at a start) of all that is within the cap.

    edges: src, dst, minutes (not negative; others, and null ones, are no edges). starts: origin, node, minutes. Nodes are of any type that can be grouped.
    """
    if not delta > 0:
        raise ValueError("buckets have some width")
    tables = _Tables(edges, "paths")
    one = tables.kept(_usable(edges, cap))
    light, heavy = one.where(F.col("ride") <= delta), one.where(F.col("ride") > delta)
    known = tables.kept(_least(starts.where(F.col("minutes") <= cap).select("origin", "node", "minutes").withColumn("prev", F.lit(None).cast(edges.schema["src"].dataType))))
    bucket = F.floor(F.col("minutes") / delta)

    def relaxed(frontier: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What is improved by one more edge, and all that is known then."""
        step = frontier.join(ways, F.col("node") == F.col("src"))
        reached = _least(step.select("origin", F.col("dst").alias("node"), (F.col("minutes") + F.col("ride")).alias("minutes"), F.col("src").alias("prev")).where(F.col("minutes") <= cap))
        before = known.select(F.col("origin").alias("o"), F.col("node").alias("n"), F.col("minutes").alias("m"))
        joined = reached.join(before, F.col("origin").eqNullSafe(F.col("o")) & (F.col("node") == F.col("n")), "left")
        better = tables.kept(joined.where("m is null or minutes < m - 1e-9").select("origin", "node", "minutes", "prev"))
        return better, better if better.isEmpty() else tables.kept(_least(known.unionByName(better)))

    now = known.agg(F.min(bucket)).first()[0]
    while now is not None:
        frontier = known.where(bucket == now)
        while True:
            better, after = relaxed(frontier, light)
            if better.isEmpty():
                break
            known = after
            frontier = better.where(bucket == now)
            if frontier.isEmpty():
                break
        better, after = relaxed(known.where(bucket == now), heavy)
        known = known if better.isEmpty() else after
        now = known.where(bucket > now).agg(F.min(bucket)).first()[0]
    return known


def routes(known: DataFrame) -> DataFrame:
    """origin, node, minutes and route (all nodes from the start on) of each row of ``delta_stepping``.

    Routes double in length from round to round, so that a route of n nodes takes log n joins.
    """
    tables = _Tables(known, "routes")
    now = tables.kept(known.select("origin", "node", "minutes", F.array("node").alias("route"), F.col("prev").alias("up")))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("origin").alias("o"), F.col("node").alias("n"), F.col("route").alias("head"), F.col("up").alias("further"))
        joined = now.join(above, F.col("origin").eqNullSafe(F.col("o")) & (F.col("up") == F.col("n")), "left")
        head: Column = F.coalesce("head", F.slice("route", 1, 0))
        now = tables.kept(joined.select("origin", "node", "minutes", F.concat(head, "route").alias("route"), F.col("further").alias("up")))
    return now.drop("up")


def shortest_routes(edges: DataFrame, starts: DataFrame, *, cap: float, delta: float, part: int = PART, both: bool = False) -> DataFrame:
    """origin, node, minutes and route of all that is within the cap; arguments as of ``delta_stepping``, nodes are strings. With ``both``, edges lead both ways.

    A part of the graph with at most ``part`` edges is searched within tasks, what is larger by ``delta_stepping``. Edges whose rows are dealt by one of their nodes make the search for parts cheaper.
    """
    spark, tables = edges.sparkSession, _Tables(edges, "parts")
    one = tables.kept(_able(edges, cap))

    def ways(some: DataFrame) -> DataFrame:
        there = some.select("src", "dst", F.col("ride").alias("minutes"))
        return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "minutes")) if both else there

    labels = _parts(one, tables)
    if labels is None:
        return routes(delta_stepping(ways(one), starts, cap=cap, delta=delta))
    sources = tables.kept(one.groupBy(F.xxhash64("src").alias("at")).agg(F.count("*").alias("n")).join(labels, "at").select("at", "part", "n"))
    counts = tables.kept(sources.groupBy("part").agg((F.sum("n") * (2 if both else 1)).alias("n")))
    large = counts.where(F.col("n") > part).select("part")
    # one row for each node that edges come from, few beside the edges
    of = sources.select("at", "part")
    labelled = one.join(F.broadcast(of) if of.count() <= BROADCAST else of, F.xxhash64("src") == F.col("at")).select("part", "src", "dst", "ride")
    begun = starts.where("node is not null").where(F.col("minutes") <= cap).join(labels, F.xxhash64("node") == F.col("at"), "left").select("origin", "node", "minutes", F.coalesce("part", F.xxhash64("node")).alias("part"))
    # few parts are searched by several tasks each, which the origins are dealt to
    deals = max(1, -(-spark.sparkContext.defaultParallelism // max(1, counts.count())))
    kind = starts.schema["origin"].dataType
    dealt = begun.join(large, "part", "left_anti").select("part", F.pmod(F.xxhash64("origin"), F.lit(deals)).alias("deal"), F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("minutes").alias("ride"), "origin")
    held = labelled.join(F.broadcast(large), "part", "left_anti").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long")))).withColumn("origin", F.lit(None).cast(kind))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, cap, both)

    found = held.unionByName(dealt).groupBy("part", "deal").applyInArrow(search, f"origin {kind.simpleString()}, node string, minutes double, route array<string>")
    nowhere = starts.where("node is null").where(F.col("minutes") <= cap).groupBy("origin", "node").agg(F.min("minutes").alias("minutes"))
    found = found.unionByName(nowhere.select("*", F.array("node").alias("route")))
    if large.isEmpty():
        return found
    beyond = ways(labelled.join(large, "part", "left_semi"))
    return found.unionByName(routes(delta_stepping(beyond, begun.join(large, "part", "left_semi").drop("part"), cap=cap, delta=delta)))


def _parts(one: DataFrame, tables: _Tables, rounds: int = ROUNDS) -> DataFrame | None:
    """at (a node's hash) and part, the least hash of all nodes that hang together; None if that takes more rounds. Equal hashes only make parts larger."""
    pairs = one.select(F.xxhash64("src").alias("x"), F.xxhash64("dst").alias("y")).mapInArrow(_forest, "x long, y long")
    # what a node hangs together with in several tasks meets in one
    pairs = tables.kept(pairs.repartition("x").mapInArrow(_forest, "x long, y long"))
    both = tables.kept(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = tables.kept(both.groupBy(F.col("x").alias("at")).agg(F.least(F.min("y"), F.first("x")).alias("part")))
    total = labels.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
    for _ in range(rounds):
        reached = both.join(labels, F.col("x") == F.col("at")).select(F.col("y").alias("at"), "part").groupBy("at").agg(F.min("part").alias("part"))
        labels = tables.kept(reached.unionByName(labels).groupBy("at").agg(F.min("part").alias("part")))
        before, total = total, labels.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
        if before == total:
            return labels
    return None


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's pairs with the least node that it hangs together with there."""
    nodes, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return _together(*(np.concatenate([old, *(b.column(i).to_numpy() for b in waiting)]) for i, old in enumerate((nodes, roots))))

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) > max(GATHERED, len(nodes)):
            nodes, roots = joined()
            waiting.clear()
    nodes, roots = joined()
    for i in range(0, len(nodes), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65_536]), pa.array(roots[i : i + 65_536])], ["x", "y"])


def _together(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the pairs, in order, and for each the least that it hangs together with."""
    every, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, root = codes[: len(x)], codes[len(x) :], np.arange(len(every))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return every, every[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((above := root[root]) != root).any():
            root = above


def _searched(batches: Iterator[pa.RecordBatch], cap: float, both: bool) -> Iterator[pa.RecordBatch]:
    """All routes of a part, origin by origin: rounds of edges from what the round before has improved; of equally long ways the first node before.

    Rows without dst are starts. What is found leaves in batches, so that memory holds the part and not its routes.
    """
    rows = pa.Table.from_batches(batches)
    begins = pc.is_null(rows.column("dst"))
    starts, edges = rows.filter(begins), rows.filter(pc.invert(begins))
    m = edges.num_rows
    every = pa.concat_arrays([c.cast(pa.string()) for t, n in ((edges, "src"), (edges, "dst"), (starts, "src")) for c in t.column(n).chunks] or [pa.array([], pa.string())])
    nodes = every.dictionary_encode()
    # numbers in the order of the names
    order = pc.array_sort_indices(nodes.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, names = place[nodes.indices.to_numpy()], nodes.dictionary.take(pa.array(order))
    befores, afters, rides = codes[:m], codes[m : 2 * m], edges.column("ride").to_numpy()
    if both:
        befores, afters, rides = np.concatenate([befores, afters]), np.concatenate([afters, befores]), np.concatenate([rides, rides])
    by = np.argsort(befores, kind="stable")
    ends, rides = afters[by], rides[by]
    first = np.concatenate([[0], np.cumsum(np.bincount(befores, minlength=len(order)))])
    origins = starts.column("origin").combine_chunks().dictionary_encode(null_encoding="encode")
    origins = pa.concat_arrays(origins.chunks) if isinstance(origins, pa.ChunkedArray) else origins
    whose, begun, at = origins.indices.to_numpy(), starts.column("ride").to_numpy(), codes[2 * m :]
    out: list[tuple[np.ndarray, ...]] = []

    def listed() -> pa.RecordBatch:
        owner, node, value, size, way = (np.concatenate(c) for c in zip(*out, strict=True))
        out.clear()
        ways = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), names.take(pa.array(way)))
        return pa.RecordBatch.from_arrays([origins.dictionary.take(pa.array(owner)), names.take(pa.array(node)), pa.array(value, pa.float64()), ways], ["origin", "node", "minutes", "route"])

    for origin in range(len(origins.dictionary)):
        minutes, above = np.full(len(order), np.inf), np.full(len(order), -1)
        np.minimum.at(minutes, at[whose == origin], begun[whose == origin])
        frontier = np.flatnonzero(np.isfinite(minutes))
        while len(frontier):
            n = first[frontier + 1] - first[frontier]
            way = np.repeat(first[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())
            before, to = np.repeat(frontier, n), ends[way]
            sums = minutes[before] + rides[way]
            better = (sums <= cap) & (sums < minutes[to] - 1e-9)
            before, to, sums = before[better], to[better], sums[better]
            np.minimum.at(minutes, to, sums)
            least = sums == minutes[to]
            frontier = np.unique(to)
            above[frontier] = len(order)
            np.minimum.at(above, to[least], before[least])
        reached = np.flatnonzero(np.isfinite(minutes))
        steps, here = [], reached
        while (here >= 0).any():
            steps.append(here)
            here = np.where(here >= 0, above[here], -1)
        ways = np.array(steps[::-1], np.int64).reshape(len(steps), len(reached)).T
        out.append((np.full(len(reached), origin), reached, minutes[reached], (ways >= 0).sum(axis=1), ways[ways >= 0]))
        if sum(len(o[-1]) for o in out) > BATCH:
            yield listed()
    if out:
        yield listed()
