"""Travel graphs: edges, shortest paths by search or by iterated min-plus joins, matrices with access times."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import geo
from larkspan.operators import paths, sequences

# Minutes of changing lines and of boarding, and the longest journey kept.
TRANSFER, BOARDING, CAP = 5.0, 4.0, 120
#: Edges up to which a graph is broadcast (under 200 bytes each), and minutes of a bucket beyond.
SMALL, DELTA = 500_000, 10.0


def ride_edges(stops: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Edges both ways between neighbours of a line: stops are (line, pos, station, lat, lon)."""
    pairs = sequences.neighbours(stops, ["line"], "pos", ["station", "lat", "lon"])
    factor = F.lit(1.0)
    if factors is not None:
        pairs = pairs.join(factors, "line", "left")
        factor = F.coalesce("factor", F.lit(1.0))
    minutes = geo.ride_minutes(geo.haversine(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")), factor)
    out = pairs.select("line", F.col("station").alias("a"), F.col("next_station").alias("b"), minutes.alias("minutes"))
    both = out.unionByName(out.select("line", F.col("b").alias("a"), F.col("a").alias("b"), "minutes"))
    return both.select(F.struct(F.col("a").alias("station"), "line").alias("src"), F.struct(F.col("b").alias("station"), "line").alias("dst"), "minutes")


def transfer_edges(stops: DataFrame, minutes: float = TRANSFER) -> DataFrame:
    """Edges between all lines at a station."""
    pairs = sequences.pairs_within(stops, "station", "line")
    return pairs.select(F.struct("station", F.col("a").alias("line")).alias("src"), F.struct("station", F.col("b").alias("line")).alias("dst"), F.lit(minutes).alias("minutes"))


def shortest_paths(edges: DataFrame, origins: DataFrame, *, boarding: float = BOARDING, cap: float = CAP, small: int = SMALL) -> DataFrame:
    """Least minutes from each origin station to every station within the cap; origins board on every line.

    A graph of up to ``small`` edges is broadcast and searched origin by origin, in parallel; a larger one stays
    partitioned and is settled bucket by bucket (see ``paths``).
    """
    nodes = edges.select("src").distinct()
    start = origins.select(F.col("station").alias("origin")).distinct().join(nodes, F.col("src.station") == F.col("origin"))
    if edges.count() <= small:
        best = _searched(edges, start, boarding, cap)
    else:
        best = paths.delta_stepping(edges, start.select("origin", F.col("src").alias("node"), F.lit(float(boarding)).alias("minutes")), cap=cap, delta=DELTA)
    return best.groupBy("origin", F.col("node.station").alias("station")).agg(F.min("minutes").alias("minutes"))


def _searched(edges: DataFrame, start: DataFrame, boarding: float, cap: float) -> DataFrame:
    """Dijkstra's search for each origin over the broadcast edges."""
    spark = edges.sparkSession
    near: dict[tuple, list[tuple]] = {}
    for r in edges.select("src.*", F.col("dst.station").alias("to"), F.col("dst.line").alias("on"), "minutes").toLocalIterator():
        near.setdefault((r[0], r[1]), []).append(((r.to, r.on), r.minutes))
    shared = spark.sparkContext.broadcast(near)
    lines = start.groupBy("origin").agg(F.collect_set("src.line").alias("lines"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for origin, boarded in zip(pdf["origin"], pdf["lines"], strict=True):
                heap = [(boarding, (origin, line)) for line in sorted(boarded)]
                done: dict[tuple, float] = {}
                while heap:
                    minutes, node = heapq.heappop(heap)
                    if node in done:
                        continue
                    done[node] = minutes
                    for other, ride in shared.value.get(node, ()):
                        if other not in done and minutes + ride <= cap:
                            heapq.heappush(heap, (minutes + ride, other))
                yield pd.DataFrame({"origin": origin, "station": [n[0] for n in done], "line": [n[1] for n in done], "minutes": list(done.values())})

    found = lines.repartition("origin").mapInPandas(run, "origin string, station string, line string, minutes double")
    return found.select("origin", F.struct("station", "line").alias("node"), "minutes")


def matrix(times: DataFrame, access: DataFrame, *, cap: int = CAP) -> DataFrame:
    """Least door-to-door minutes per (origin, school), with the station and mode that give it."""
    joined = times.join(access, "station").select("origin", "school", (F.bround(F.col("minutes") + F.col("access"))).cast("int").alias("total"), "seq", F.col("station").alias("via"), "mode")
    best = joined.where(F.col("total") <= cap).groupBy("origin", "school").agg(F.min(F.struct("total", "seq", "via", "mode")).alias("best"))
    return best.select("origin", "school", F.col("best.total").alias("minutes"), "best.via", "best.mode")


def replace_keys(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` without the keys of ``new``, and ``new``."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resolve_nodes(stations: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """One station for each name: of the region of most priority, then of least code."""
    order = F.coalesce(*(F.when(F.col("region") == k, v) for k, v in priorities.items()), F.lit(len(priorities)))
    return stations.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(order, "code"))).where("nth = 1").drop("nth")


def segment_minutes(stops: DataFrame, wanted: DataFrame) -> DataFrame:
    """Minutes along a line between two stations: wanted is (line, a, b, published); ``minutes`` is to the next stop."""
    at = stops.select("line", "station", "pos", (F.sum("minutes").over(Window.partitionBy("line").orderBy("pos")) - F.col("minutes")).alias("upto"))
    left = at.select("line", F.col("station").alias("a"), F.col("upto").alias("from_start"))
    right = at.select("line", F.col("station").alias("b"), F.col("upto").alias("to_start"))
    joined = wanted.join(left, ["line", "a"]).join(right, ["line", "b"])
    return joined.withColumn("estimated", F.abs(F.col("to_start") - F.col("from_start"))).withColumn("ratio", F.col("published") / F.col("estimated"))
