from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from larkspan.sources.snapshots import Store
from larkspan.streaming import sessions, turns
from tests.oracle import SF


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, folder, df, make, out):
    schema = df.schema
    stream = spark.readStream.schema(schema).parquet(str(folder))
    job = make(stream).writeStream.outputMode("update" if out == "state" else "append").format("memory").queryName(out).start()
    job.processAllAvailable()
    job.stop()
    return spark.table(out)


def test_session_state_folds_batches(spark, tmp_path):
    df = _events(spark, [(1, "2024-01-01 00:00:00", 1, "a", 1.0), (2, "2024-01-01 01:00:00", 1, "b", 2.0), (3, "2024-01-01 00:30:00", 2, "a", 5.0)])
    df.write.parquet(str(tmp_path / "in"))
    got = _run(spark, tmp_path / "in", df, sessions.session_state, "state")
    last = {r.user_id: (r.events, r.total, r.last_type) for r in got.orderBy("events").collect()}
    assert last == {1: (2, 3.0, "b"), 2: (1, 5.0, "a")}


def test_upsert_is_exact_when_a_batch_runs_again(spark, tmp_path):
    table = sessions.counters(Store(spark, f"file://{tmp_path}"))
    batch = sessions.counted(spark.read.parquet(f"{SF}/events.parquet"))
    for part, number in ((batch, 0), (batch, 0), (batch.limit(0), 1), (batch, 2)):
        table.add(part, number)
    assert table.read().agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_the_value_put_last_counts(spark, tmp_path):
    table = sessions.values(Store(spark, f"file://{tmp_path}"))
    rows = lambda *r: spark.createDataFrame(r, "key string, at int, value string, expires_at int")
    table.add(rows(("a", 2, "x", 9), ("b", 1, "y", 9)), 0)
    table.add(rows(("a", 1, "late", 9), ("b", 3, "z", 10)), 1)
    assert {tuple(r) for r in table.read().collect()} == {("a", 2, "x", 9), ("b", 3, "z", 10)}


def test_a_gap_of_more_than_a_day_begins_another_session(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "a", 1.0), (2, "2024-01-05 00:00:00", 1, "b", 2.0), (3, "2024-01-06 00:00:00", 1, "c", 4.0), (4, "2024-01-07 00:00:01", 1, "d", None)]
    expected = {("2024-01-01 00:00:00", 1, 1.0, "a"), ("2024-01-05 00:00:00", 2, 6.0, "c"), ("2024-01-07 00:00:01", 1, 0.0, "d")}
    for name, parts in (("one", [rows]), ("each", [[r] for r in rows]), ("two", [rows[:1], rows[1:]])):
        got = _in_batches(spark, tmp_path / name, [_events(spark, p) for p in parts], lambda s: sessions.session_state(s), "update")
        last = got.groupBy("started").agg(F.max(F.struct("events", "total", "last_type")).alias("s")).collect()
        assert {(str(r.started), *r.s) for r in last} == expected, name


def _in_batches(spark, folder, parts, make, mode):
    """What the stream gives for one file of each part, a micro-batch for each file in this order."""
    (folder / "in").mkdir(parents=True)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / f"part{i}"))
        (made,) = (folder / f"part{i}").glob("part-*.parquet")
        made.rename(folder / "in" / f"{i:03}.parquet")
        os.utime(folder / "in" / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    with turns.state_store(spark):
        job = make(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        job.option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / "out"))


HOUR = 3600
SAID = [
    (0, 0, "渋谷駅から30分以内", None), (1, 1, None, ["commute_15", "club_similar"]), (2, 2, "大丈夫です", None), (3, 3, "2番", None),
    (4, 4, "当日は300点くらい", None), (30, 5, "工業系がいい", None), (31, 6, None, ["commute_15"]), (32, 7, "いいえ", None), (50, 8, "はい", None), (100, 9, "サッカー部", None),
    (101, 10, None, ["commute_15"]), (120, 11, "大丈夫です", None), (126, 12, "はい", None),
]


def _turns(spark, rows):
    frame = spark.createDataFrame([(1, 1_704_067_200 + h * HOUR, turn, text, offers) for h, turn, text, offers in rows], "session long, at long, turn long, text string, offers array<string>")
    return frame.withColumn("at", F.timestamp_seconds("at"))


def _plain_fold(spark, rows, most):
    """The same turns one after the other, without a stream."""
    now, out = turns.Session(), []
    for r in sorted(turns.read_turns(_turns(spark, rows)).withColumn("ms", F.unix_millis("at")).collect(), key=lambda r: r.at):
        out.append(now.add(r, r.ms, most))
    return out


@pytest.mark.parametrize("cuts", [[], [5], [2, 6, 8], list(range(1, len(SAID)))])
def test_turns_give_the_same_rows_for_every_split(spark, tmp_path, cuts):
    parts = [SAID[a:b] for a, b in zip([0, *cuts], [*cuts, len(SAID)], strict=True)]
    got = _in_batches(spark, tmp_path, [_turns(spark, p) for p in parts], lambda s: turns.fold_turns(turns.read_turns(s), most=3), "append")
    rows = sorted((tuple(r)[1:-1] for r in got.where("turn is not null").collect()), key=lambda r: r[1])
    assert rows == _plain_fold(spark, SAID, 3)
    expired = [r.session_no for r in got.where("done = 'expired'").collect()]
    assert set(expired) <= {1, 2, 3, 4} and len(expired) == len(set(expired))


def test_the_state_after_each_turn(spark):
    rows = {r[1]: dict(zip(turns._OUT, r, strict=True)) for r in _plain_fold(spark, SAID, 3)}
    assert [rows[i]["done"] for i in range(13)] == ["slots", "offer", "unclear", "accepted", "slots", "slots", "offer", "declined", "slots", "slots", "offer", "unclear", "slots"]
    assert rows[2]["offered"] == ["commute_15", "club_similar"] and rows[3]["offered"] == [] and rows[3]["relaxations"] == ["club_similar"]
    assert (rows[4]["station"], rows[4]["commute_limit"], rows[4]["toujitsu"]) == ("渋谷", 30, 300)
    # 26 hours after the last turn that was kept the slots are gone, the calls stay
    assert (rows[5]["session_no"], rows[5]["station"], rows[5]["dept"], rows[5]["calls"]) == (2, None, "工", 3)
    assert rows[8]["session_no"] == 2 and rows[9]["session_no"] == 3 and rows[9]["allowed"] is False
    # an unclear reply doesn't prolong the session: 25 hours after the offer another one begins
    assert rows[12]["session_no"] == 4 and rows[12]["offered"] == []


def test_the_state_store_is_set_back(spark):
    before = spark.conf.get(turns._PROVIDER)
    with turns.state_store(spark):
        assert spark.conf.get(turns._PROVIDER) != before
    assert spark.conf.get(turns._PROVIDER) == before
