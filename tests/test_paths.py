from __future__ import annotations

import heapq
import random

import pyarrow as pa
import pytest

from larkspan.operators import paths


def dijkstra(edges, start, cap):
    near = {}
    for a, b, m in edges:
        if a is not None and b is not None and m is not None and m >= 0:
            near.setdefault(a, []).append((b, m))
    done, heap = {}, [(0.0, start)]
    while heap:
        m, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = m
        for other, ride in near.get(node, ()):
            if other not in done and m + ride <= cap:
                heapq.heappush(heap, (m + ride, other))
    return done


def frames(spark, edges, starts):
    return spark.createDataFrame(edges, "src string, dst string, minutes double"), spark.createDataFrame([(s, s, 0.0) for s in starts], "origin string, node string, minutes double")


@pytest.mark.parametrize("delta", [0.7, 3.0, 100.0])
def test_distances_and_routes_against_a_search(spark, delta):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice([0.0, 0.5, 1.0, 2.5, 6.0, 30.0])) for _ in range(110)] + [(None, "n1", 1.0), ("n1", None, 1.0), ("n2", "n3", None), ("n0", "n5", -4.0)]
    starts = ["n0", "n7", "alone"]
    known = paths.delta_stepping(*frames(spark, edges, starts), cap=9.0, delta=delta)
    got = {}
    for r in paths.routes(known).collect():
        got[r.origin, r.node] = r.minutes
        assert r.route[0] == r.origin and r.route[-1] == r.node and len(set(r.route)) == len(r.route)
        rides = [min(m for x, y, m in edges if (x, y) == way and m is not None and m >= 0) for way in zip(r.route, r.route[1:], strict=False)]
        assert abs(sum(rides) - r.minutes) < 1e-9
    expected = {(s, n): m for s in starts for n, m in dijkstra(edges, s, 9.0).items()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_rounds_are_bounded_by_buckets(spark, monkeypatch):
    """A wide graph of few steps takes as few rounds as a narrow one."""
    rounds = []
    kept = paths._Tables.kept
    monkeypatch.setattr(paths._Tables, "kept", lambda self, df: rounds.append(1) or kept(self, df))
    for width in (5, 400):
        rounds.clear()
        edges = [("s", f"a{i}", 1.0) for i in range(width)] + [(f"a{i}", f"b{i}", 1.0) for i in range(width)]
        assert paths.delta_stepping(*frames(spark, edges, ["s"]), cap=10.0, delta=5.0).count() == 2 * width + 1
        if width == 5:
            narrow = len(rounds)
    assert len(rounds) == narrow


def test_no_edges_no_starts_and_no_width(spark):
    edges, starts = frames(spark, [("a", "b", 1.0)], ["x"])
    assert [tuple(r) for r in paths.routes(paths.delta_stepping(edges.limit(0), starts, cap=1.0, delta=1.0)).collect()] == [("x", "x", 0.0, ["x"])]
    assert paths.delta_stepping(edges, starts.limit(0), cap=1.0, delta=1.0).count() == 0
    with pytest.raises(ValueError, match="width"):
        paths.delta_stepping(edges, starts, cap=1.0, delta=0.0)


@pytest.mark.parametrize("part", [0, 30, 1000])
def test_routes_by_parts_against_a_search(spark, part):
    """Parts that tasks search, parts beyond their bound, and both give the same; a start without edges, and one of several origins."""
    rng = random.Random(5)
    edges = [(f"{g}{rng.randrange(12)}", f"{g}{rng.randrange(12)}", rng.choice([0.0, 0.5, 1.0, 2.5, 6.0, 30.0])) for g, n in (("a", 60), ("b", 20), ("c", 15)) for _ in range(n)]
    edges += [(None, "a1", 1.0), ("a1", None, 1.0), ("a2", "b3", 30.0), ("b0", "b5", -4.0)]
    starts = ["a0", "a7", "b1", "c0", "alone"]
    got = {}
    for r in paths.shortest_routes(*frames(spark, edges, starts), cap=9.0, delta=1.5, part=part).collect():
        assert (r.origin, r.node) not in got
        got[r.origin, r.node] = r.minutes
        assert r.route[0] == r.origin and r.route[-1] == r.node and len(set(r.route)) == len(r.route)
        rides = [min(m for x, y, m in edges if (x, y) == way and m is not None and m >= 0) for way in zip(r.route, r.route[1:], strict=False)]
        assert abs(sum(rides) - r.minutes) < 1e-9
    expected = {(s, n): m for s in starts for n, m in dijkstra(edges, s, 9.0).items()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_parts_are_searched_without_rounds_over_all(spark, monkeypatch):
    monkeypatch.setattr(paths, "delta_stepping", None)
    edges = [(f"{g}{i}", f"{g}{i + 1}", 1.0) for g in "xyz" for i in range(4)]
    rows = paths.shortest_routes(*frames(spark, edges, ["x0", "z2"]), cap=2.0, delta=1.0).collect()
    assert {(r.origin, r.node): r.route for r in rows if r.minutes == 2.0} == {("x0", "x2"): ["x0", "x1", "x2"], ("z2", "z4"): ["z2", "z3", "z4"]}


def test_edges_are_written_once(spark, monkeypatch):
    """What is written to find the parts of a dense graph is one row for each edge, and few for each node."""
    written = []
    kept = paths._Tables.kept

    def counted(self, df):
        out = kept(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(paths._Tables, "kept", counted)
    edges = [(f"a{i}", f"b{j}", 1.0 + (i * 7 + j) % 50 / 64) for i in range(90) for j in range(90)]
    assert paths.shortest_routes(*frames(spark, edges, ["a0"]), cap=2.0, delta=1.0).count() == 91
    assert sum(written) < 1.5 * len(edges)


def test_edges_both_ways_and_many_origins_in_batches(spark, monkeypatch):
    """Edges given once for both ways find what they find given twice; results of many origins leave a task in several batches."""
    rng = random.Random(3)
    edges = [(f"{g}{rng.randrange(15)}", f"{g}{rng.randrange(15)}", rng.choice([0.5, 1.0, 2.5, 6.0])) for g in "ab" for _ in range(30)]
    nodes = sorted({n for e in edges for n in e[:2]})
    frame, starts = frames(spark, edges, nodes)
    once = paths.shortest_routes(frame, starts, cap=7.0, delta=1.5, both=True)
    twice = paths.shortest_routes(frame.unionByName(frame.selectExpr("dst AS src", "src AS dst", "minutes")), starts, cap=7.0, delta=1.5)
    got = sorted((r.origin, r.node, r.minutes, *r.route) for r in once.collect())
    assert got == sorted((r.origin, r.node, r.minutes, *r.route) for r in twice.collect())
    both = edges + [(b, a, m) for a, b, m in edges]
    assert {r[:3] for r in got} == {(s, n, m) for s in nodes for n, m in dijkstra(both, s, 7.0).items()}
    monkeypatch.setattr(paths, "BATCH", 100)
    rows = pa.RecordBatch.from_pylist([{"src": a, "dst": b, "ride": m, "origin": None} for a, b, m in edges] + [{"src": n, "dst": None, "ride": 0.0, "origin": n} for n in nodes])
    batches = list(paths._searched(iter([rows]), 7.0, True))
    assert len(batches) > 3 and sorted((r["origin"], r["node"], r["minutes"], *r["route"]) for b in batches for r in b.to_pylist()) == got
