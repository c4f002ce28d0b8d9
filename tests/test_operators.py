"""Operators that the SQL comparison doesn't reach, and invariants of the search."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from larkspan.api import Engine
from larkspan.operators import graph, joins, quality, rollups, search
from larkspan.plans import search_queries
from larkspan.plans import standins as S
from tests.oracle import SF


@pytest.fixture(scope="module")
def shown(spark):
    return search_queries._run(spark, SF, search_queries.requests(spark, SF)).cache()


def test_commute_priority_is_in_order_of_minutes(shown):
    by = {}
    for r in shown.where("priority = 'commute'").orderBy("req_id", "rank").select("req_id", "minutes").collect():
        by.setdefault(r.req_id, []).append(r.minutes)
    assert by and all(v == sorted(v) for v in by.values())


def test_limits_hold(shown):
    assert shown.where(F.col("minutes") > F.col("commute_limit")).isEmpty()
    assert shown.where("no_admission").isEmpty()
    assert shown.groupBy("req_id").count().agg(F.max("count")).first()[0] <= 7


def test_relaxed_limit_shows_at_least_as_near(spark):
    asked = search_queries.requests(spark, SF)
    wide = asked.withColumn("relaxations", F.array(F.lit("commute_15")))
    schools, commute = S.of(spark, SF, S.SCHOOLS), S.of(spark, SF, S.COMMUTE)
    assert search.candidates(wide, schools, commute).count() >= search.candidates(asked, schools, commute).count()


def test_no_limit_sees_every_school(spark):
    asked = search_queries.requests(spark, SF).limit(2).withColumn("no_commute_limit", F.lit(True)).withColumn("station", F.lit("none")).withColumn("dept", F.lit(None).cast("string")).withColumn("course_types", F.array().cast("array<string>"))
    schools = S.of(spark, SF, S.SCHOOLS)
    rows = search.candidates(asked, schools, S.of(spark, SF, S.COMMUTE))
    assert rows.count() == 2 * schools.where("not no_admission and contains(courses, '全日制')").count()
    assert rows.where("minutes is null").count() > 0


def test_api(spark):
    engine = Engine(S.of(spark, SF, S.SCHOOLS), S.of(spark, SF, S.COMMUTE), stats=S.of(spark, SF, S.STATS))
    asked = search_queries.requests(spark, SF)
    found = engine.search(asked)
    assert "text" in found.columns
    assert engine.unknown_stations(asked.limit(1).withColumn("station", F.lit("none"))).count() == 1
    assert engine.relaxations(asked, found).count() == asked.join(found.select("req_id").distinct(), "req_id", "left_anti").count()
    years = [r.year for r in engine.detail(1).collect()]
    assert years == sorted(years, reverse=True)
    assert engine.list(limit=3).count() == 3
    states = engine.states(spark.createDataFrame([(1, 0, "渋谷駅")], "session long, turn long, text string"))
    assert states.first().station == "渋谷"
    assert not engine.health({"schools": -1}).where("name = 'schools'").first().ok


def test_strict_lookup_fails(spark):
    names = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, id long")
    with pytest.raises(Exception, match="unknown"):
        joins.strict_lookup(spark.createDataFrame([("z",)], "name string"), names, "name").collect()
    with pytest.raises(Exception, match="of several"):
        joins.strict_lookup(spark.createDataFrame([("b",)], "name string"), names, "name").collect()
    assert joins.strict_lookup(spark.createDataFrame([("a",)], "name string"), names, "name").first().id == 1


def test_both_ways_of_shortest_paths_agree(spark):
    stops = S.of(spark, SF, S.STOPS)
    edges = graph.ride_edges(stops).unionByName(graph.transfer_edges(stops))
    few = stops.where("pos < 2")

    def rows(small):
        return sorted((r.origin, r.station, round(r.minutes, 6)) for r in graph.shortest_paths(edges, few, small=small, cap=20).collect())

    assert rows(10**6) == rows(0) and rows(0)


def test_nearest_outside_the_grid(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([(7, 40.0, 3.0), (8, -41.0, 0.0)], "id long, lat double, lon double")
    assert joins.nearest(points, places).first().place == 7


def test_gates(spark):
    rows = spark.createDataFrame([(1, "山田 太郎選手"), (2, "優勝")], "id long, text string")
    assert quality.person_cells(rows, "id", ["text"]).count() == 1
    with pytest.raises(Exception, match="names a person"):
        quality.gate(rows, ["text"]).collect()
    assert quality.gate(rows.where("id = 2"), ["text"]).count() == 1
    with pytest.raises(ValueError, match="unknown or missing"):
        quality.tagged_union({"a": rows, "b": rows.drop("text")})


@pytest.mark.parametrize("column", ["選手名", "学年", "grade", "name", "student", "氏名", "名前", "School_Name", "生徒の名前"])
def test_columns_of_persons_are_refused(spark, column):
    with pytest.raises(ValueError, match=column):
        quality.check_columns(spark.createDataFrame([("x",)], f"`{column}` string"))


def test_columns_by_whole_name(spark):
    rule = quality.PERSON_RULES["athletics"]
    assert rule.forbids(["school_name", "grades", "選手"]) == [] and rule.forbids(["name", "record", "school"]) == ["name", "record"]
    quality.check_columns(spark.createDataFrame([("x",)], "school_name string"), rule)


PERSONS = [
    ("attributed", "山田太郎さん", True), ("attributed", "田中くん", True), ("attributed", "鈴木選手", True), ("attributed", "選手権大会", False), ("attributed", "選手団", False), ("attributed", "君権", False),
    ("attributed", "山田\u3000太郎 君", True), ("attributed", "優勝", False), ("attributed", None, False), ("baseball", "先発投手", True), ("baseball", "選手権", False), ("baseball", "本塁打王", True), ("drama", "作：x", True),
    ("drama", "作:x", False), ("drama", "選手", False), ("dance", "高校君", False), ("dance", "王君", True), ("dance", "作:x", True), ("art", "新宿 山吹", True), ("art", "新宿山吹", False), ("athletics", "山田太郎さん", False),
    ("unknown", "鈴木さん", True), (None, "鈴木さん", True),
]


def test_persons_by_source(spark):
    rows = spark.createDataFrame([(i, s, t, t, t) for i, (s, t, _) in enumerate(PERSONS)], "id int, source string, school string, line string, other string")
    found = {(r.id, r.column) for r in quality.person_cells_by_source(rows, "id", "source", ["school", "line", "other"]).collect()}
    looked = {"attributed": ("school", "line", "other"), "dance": ("line",), "baseball": ("school",), "drama": ("school",), "art": ("school",), "athletics": ()}
    assert found == {(i, c) for i, (s, _, bad) in enumerate(PERSONS) if bad for c in looked.get(s, looked["attributed"])}


def test_empty_rows(spark):
    empty = spark.createDataFrame([], "school long, division string, meet string, rank string, official boolean, seq long")
    assert rollups.best_achievement(empty, ["school", "division"]).count() == 0
    numbered, coded = rollups.encode(spark.createDataFrame([], "g string, w string"), "g", "w")
    assert numbered.count() == coded.count() == 0


def test_dictionary_numbers_are_dense(spark):
    words = spark.range(500).select((F.col("id") % 7).alias("g"), F.concat(F.lit("w"), F.lpad((F.col("id") % 100).cast("string"), 3, "0")).alias("w"))
    numbered, _ = rollups.encode(words, "g", "w")
    got = sorted((r.word, r.number) for r in numbered.collect())
    assert [n for _, n in got] == list(range(100))


def test_long_paths_end_without_a_bound_of_rounds(spark):
    rows = [(("s%d" % i, "L"), ("s%d" % (i + 1), "L"), 0.5) for i in range(12)]
    edges = spark.createDataFrame(rows, "src struct<station: string, line: string>, dst struct<station: string, line: string>, minutes double")
    start = spark.createDataFrame([("s0",)], "station string")
    ends = {small: {(r.station, r.minutes) for r in graph.shortest_paths(edges, start, small=small).collect()} for small in (0, 100)}
    assert ends[0] == ends[100] and ("s12", 10.0) in ends[0]


def test_answer_tells_status_and_offers(spark):
    engine = Engine(S.of(spark, SF, S.SCHOOLS), S.of(spark, SF, S.COMMUTE))
    asked = search_queries.requests(spark, SF).withColumn("station", F.when(F.col("req_id") == 1, None).when(F.col("req_id") == 2, "none").otherwise(F.col("station")))
    told, rows = engine.answer(asked)
    by = {r.req_id: r for r in told.collect()}
    assert (by[1].status, by[1].error, by[2].status) == (400, "station_required", 404)
    counts = {r.req_id: r["count"] for r in rows.groupBy("req_id").count().collect()}
    assert all(r["count"] == counts.get(r.req_id, 0) and (r.options is not None) == (r.status == 200 and r["count"] == 0) for r in by.values())
    assert rows.where("text is null or tier_reason = '' or sources.commute is null").isEmpty()


def test_structures_that_drift(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], "x <m> y"), (2, ["a"], "<m>"), (3, None, None)], "k int, cells array<string>, t string")
    expected = {"headers": {"table": (F.col("cells"), ["a", "b"])}, "markers": {"mark": (F.col("t"), "<m>")}}
    assert {tuple(r) for r in quality.drift(rows, "k", **expected).collect()} == {(2, "header of table"), (3, "header of table"), (3, "no mark")}
    with pytest.raises(ValueError, match="header of table: 2, first 2; no mark: 1, first 3"):
        quality.steady(rows, "k", **expected)
    assert quality.steady(rows.where("k = 1"), "k", **expected).count() == 1
    with pytest.raises(ValueError, match="no rows"):
        quality.steady(rows.limit(0), "k", **expected)


def test_health_tells_what_is_wrong(spark, tmp_path):
    from larkspan.sources.snapshots import Store

    engine = Engine(S.of(spark, SF, S.SCHOOLS), S.of(spark, SF, S.COMMUTE).limit(0))
    store = Store(spark, f"file://{tmp_path}")
    for _ in range(2):
        told = {r.name: r.ok for r in engine.health({"schools": 5}, store).collect()}
        assert told == {"schools": False, "commute": False, "join": False, "store": True}
    calls = spark.range(8).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"))

    def answers(probe):
        return [r.error for r in engine.health_model(calls, probe).orderBy("id").collect()]

    assert answers(lambda p: "yes") == [None] * 6 + ["rate_limited"] * 2
    assert answers(None) == ["ai_unavailable"] * 6 + ["rate_limited"] * 2
    assert answers(lambda p: 1 / 0) == ["llm_failed"] * 6 + ["rate_limited"] * 2


def test_containment_finds_hits_once_for_all_groups(spark):
    """Against all pairs of a group; nulls and empty strings among them. No plan joins texts and members on their group before what holds what is known."""
    rng = random.Random(3)
    word = lambda: rng.choice([None, "", *("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(6))])
    rows = [(i, rng.choice([None, 1, 2, 3]), word()) for i in range(150)]
    members = [(rng.choice([None, 1, 2]), word()) for _ in range(40)]
    made = spark.createDataFrame(rows, "id int, g int, t string"), spark.createDataFrame(members, "g int, n string")
    for shortest in (0, 3):
        got = {r.id: r.n for r in joins.contained(*made, "g", "t", "n", shortest).collect()}
        assert got == {
            i: max((n for h, n in members if g is not None and h == g and t is not None and n is not None and (n in t or (len(t) >= shortest and t in n))), key=lambda n: (len(n), n), default="")
            for i, g, t in rows
        }
    wide = [(g, f"{c}{i}") for g in range(30) for c in "xyz" for i in range(40)]
    asked = [(g * 100 + i, g, f"q{i}") for g in range(30) for i in range(40)] + [(9999, 0, "x7y")]
    out = joins.contained(spark.createDataFrame(asked, "id int, g int, t string"), spark.createDataFrame(wide, "g int, n string"), "g", "t", "n")
    assert [r.n for r in out.where("n <> ''").collect()] == ["x7"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan


def test_nearest_among_crowds_meets_few(spark, monkeypatch):
    """A crowd in one first cell, copies at one spot and a point far away: the same as all pairs, from cells that hold few."""
    rng = random.Random(4)
    spots = [(i, 35 + rng.random() * 0.2, 139 + rng.random() * 0.2) for i in range(600)] + [(600 + i, 35.1, 139.1) for i in range(50)] + [(900, -20.0, 10.0), (901, None, 1.0)]
    used = []
    chosen = joins._uncrowded
    monkeypatch.setattr(joins, "_uncrowded", lambda there, cell: used.append((chosen(there, cell), there.count())) or used[-1][0])
    places = spark.createDataFrame(spots, "id int, lat double, lon double")
    got = {r.id: r.place for r in joins.nearest(places.where("id % 10 = 0 or id = 901"), places, cell=0.25, others=True).collect()}

    def km(a, b):
        return math.hypot((b[1] - a[1]) * 111, (b[2] - a[2]) * 111 * math.cos(math.radians((a[1] + b[1]) / 2)))

    known = spots[:-1]
    assert got == {901: None} | {a[0]: min(((km(a, b), b[0]) for b in known if b[0] != a[0]))[1] for a in known if a[0] % 10 == 0}
    assert used[0][0] < 0.25 and used[0][1] == 603
    cells = collections.Counter((x // used[0][0], y // used[0][0]) for _, x, y in {(0, *s[1:]) for s in known})
    assert max(cells.values()) <= joins.CROWD


def test_only_shown_rows_carry_names_of_clubs(spark):
    """Windows over all candidates see numbers of clubs; names are as candidates have them."""
    asked = search_queries.requests(spark, SF, clubs=True, relaxations=("club_similar",))
    schools, commute, clubs = (S.of(spark, SF, q) for q in (S.SCHOOLS, S.COMMUTE, S.CLUBS))
    rows, sets = search._admissible(asked, schools, commute, clubs, search_queries.CATEGORIES)
    assert "matched" not in rows.columns and {"n_matched", "n_exact"} <= set(rows.columns)
    every = {(r.req_id, r.school): r for r in search._named(rows.withColumn("n", F.col("n_matched")).withColumn("x", F.col("n_exact")), sets).collect()}
    assert any(r.n for r in every.values())
    for r in every.values():
        assert r.n == len(r.matched) and r.x == sum(any(w in c for w in r.clubs) for c in r.matched) and r.matched == sorted(r.matched)


def test_candidates_are_shuffled_as_plain_columns(spark, monkeypatch):
    """Rows of requests and schools carry no arrays and no structs where they are shuffled, and meet schools and numbers of clubs without a shuffle; by shuffle, the rows are the same."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    def run():
        out = search_queries.search_club_similar(spark, SF)
        dealt = [p for p in nodes(out._jdf.queryExecution().executedPlan()) if p.nodeName() == "Exchange" and "req_id" in list(p.schema().fieldNames())]
        return [p.outputPartitioning().toString() for p in dealt], [p.schema().catalogString() for p in dealt], sorted(map(str, out.collect()))

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        keys, carried, rows = run()
        monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
        shuffled_keys, shuffled_carried, shuffled_rows = run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows and rows == shuffled_rows
    assert not any("array<" in c or "struct<" in c.removeprefix("struct<") for c in carried + shuffled_carried)
    assert sum("(school" in k for k in keys) == 1 < sum("(school" in k for k in shuffled_keys)
