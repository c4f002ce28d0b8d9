"""Slots, sessions, limits and streams over the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import dialogue
from larkspan.plans import standins as S
from larkspan.session import shared_folder
from larkspan.sources.snapshots import Folded, Store
from larkspan.streaming import sessions, turns

QUERIES, ORACLES, query = S.registry()

_NEAR = "CAST(nullif(regexp_extract(text, '{0}[^0-9]{{0,{1}}}([0-9]{{1,3}})', 1), '') AS INT)"
_N = {k: _NEAR.format(p, reach) for k, (p, reach) in dialogue.NUMBERS.items()}
_ARRAY = "CASE WHEN regexp_matches(text, '{0}') THEN '{1}' END"
_CLUB_WORDS = list(dict.fromkeys(w for m in dialogue.CLUB_CATEGORIES.values() for w in m))
_CLUBS = "list_distinct(list_concat({}))"


def _club_sql() -> str:
    said = [f"CASE WHEN contains(text, '{w}') THEN [regexp_extract(text, '{w}(?:部|同好会|クラブ)?')] ELSE CAST([] AS VARCHAR[]) END" for w in _CLUB_WORDS]
    said += [f"CASE WHEN contains(text, '{w}') THEN [{', '.join(repr(x) for x in real)}] ELSE CAST([] AS VARCHAR[]) END" for w, real in dialogue.ALIASES.items()]
    return f"flatten([{', '.join(said)}])"


_PRIORITY = "CASE " + " ".join(f"WHEN {'emphasis AND ' if e else ''}regexp_matches(text, '{p}') THEN '{k}'" for k, p, e in dialogue.PRIORITY) + " WHEN academic THEN 'academic' END"
_DEPT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in dialogue.DEPARTMENTS) + " END"
#: In order of first appearance, as lists of DuckDB don't keep it when made distinct.
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_SLOTS = f"""{S.ctes(u0=S.UTTERANCES)},
x1 AS (SELECT session, turn, text, regexp_matches(text, '{dialogue.ACADEMIC}') AS academic, regexp_matches(text, '{dialogue.EMPHASIS}') AS emphasis,
  coalesce({', '.join(f"nullif(regexp_extract(text, '{p.replace(chr(92) + 'w', 'A-Za-z0-9_')}', 1), '')" for p in dialogue.STATION)}) AS station,
  coalesce(nullif(regexp_extract(text, '{dialogue.MINUTES_LIMIT}', 1), ''), CASE WHEN regexp_matches(text, '{dialogue.TRAVEL}') THEN nullif(regexp_extract(text, '{dialogue.MINUTES_ANY}', 1), '') END) AS lim,
  {_N['naishin5']} AS naishin5, {_N['jitsugi']} AS jitsugi, {_N['nine']} AS nine, {_N['report']} AS report, {_N['naishin']} AS naishin, {_N['toujitsu']} AS toujitsu,
  {_DEPT} AS dept, list_filter([{', '.join(_ARRAY.format(p, c) for c, p in dialogue.COURSES)}], lambda c: c IS NOT NULL) AS course_types, {_club_sql()} AS said, regexp_matches(text, '{dialogue.DECLINE}') AS declines FROM u0),
slots AS (SELECT session, turn, text, station, CASE WHEN CAST(lim AS INT) BETWEEN 1 AND 180 THEN CAST(lim AS INT) END AS commute_limit, naishin5, jitsugi,
  coalesce(nine, CASE WHEN naishin5 IS NULL AND jitsugi IS NULL AND NOT contains(text, '換算') THEN report END) AS sonai, naishin, toujitsu, academic, {_PRIORITY} AS priority, dept, course_types, {_UNIQUE.format('said')} AS clubs, declines FROM x1)"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of(spark, sf_dir, S.UTTERANCES).withColumn("slots", dialogue.extract(F.col("text")))


@query("slot_extract", _SLOTS + " SELECT session, turn, station, commute_limit, naishin5, jitsugi, sonai, naishin, toujitsu, academic, priority, dept, array_to_string(course_types, ',') AS course_types, array_to_string(clubs, ',') AS clubs, declines FROM slots")
def slot_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _extracted(spark, sf_dir).select("session", "turn", "slots.*")
    return found.withColumns({k: F.array_join(k, ",") for k in ("course_types", "clubs")} | {"academic": F.coalesce("academic", F.lit(False))})


_LAST = ", ".join(f"arg_max({k}, turn) FILTER ({k} IS NOT NULL) AS {k}" for k in ("station", *dialogue.NUMERIC, "priority", "dept"))
_STATE = f"""{_SLOTS}, w AS (SELECT session, flatten(list(course_types ORDER BY turn)) AS c, flatten(list(clubs ORDER BY turn)) AS k, {_LAST}, bool_or(academic) AS academic, count(*) AS turns FROM slots GROUP BY session),
state AS (SELECT * EXCLUDE (c, k), {_UNIQUE.format('c')} AS course_types, {_UNIQUE.format('k')} AS clubs FROM w)"""


@query("slot_merge", _STATE + " SELECT * REPLACE (array_to_string(course_types, ',') AS course_types, array_to_string(clubs, ',') AS clubs) FROM state")
def slot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = dialogue.merge_turns(_extracted(spark, sf_dir), "session", "turn")
    return state.withColumns({k: F.array_join(k, ",") for k in ("course_types", "clubs")})


@query(
    "slot_status",
    _STATE
    + """, s AS (SELECT *, session % 4 = 0 AS no_exam, list_filter([CASE WHEN station IS NOT NULL THEN 'station' END, CASE WHEN commute_limit IS NOT NULL THEN 'commute_limit' END,
  CASE WHEN coalesce(naishin, naishin5 + jitsugi, sonai) IS NOT NULL THEN 'naishin' END, CASE WHEN toujitsu IS NOT NULL THEN 'toujitsu' END,
  CASE WHEN academic OR dept IS NOT NULL OR len(clubs) > 0 OR priority IS NOT NULL THEN 'wants' END], lambda x: x IS NOT NULL) AS filled FROM state),
m AS (SELECT *, list_filter(['station', 'commute_limit', 'naishin', 'toujitsu', 'wants'], lambda x: NOT list_contains(filled, x) AND NOT (no_exam AND x = 'toujitsu')) AS missing,
  CASE WHEN naishin5 IS NOT NULL AND jitsugi IS NULL THEN 'jitsugi' WHEN jitsugi IS NOT NULL AND naishin5 IS NULL THEN 'naishin5' END AS part FROM s)
SELECT session, array_to_string(filled, ',') AS filled, array_to_string(missing, ',') AS missing, missing[1] AS next, coalesce('part:' || part, 'slot:' || missing[1], 'search') AS question FROM m""",
)
def slot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = dialogue.merge_turns(_extracted(spark, sf_dir), "session", "turn")
    state = state.withColumn("declined", F.when(F.col("session") % 4 == 0, F.array(F.lit("toujitsu"))).otherwise(F.array().cast("array<string>")))
    out = dialogue.slot_status(state)
    return out.select("session", F.array_join("filled", ",").alias("filled"), F.array_join("missing", ",").alias("missing"), "next", "question")


_ANSWERS = "SELECT conv_id AS session, turn, CASE turn % 5 WHEN 0 THEN concat('石神井', CAST(conv_id % 9 AS STRING), 'です。') WHEN 1 THEN concat(CAST(conv_id % 200 AS STRING), '分') WHEN 2 THEN CAST(conv_id % 30 AS STRING) WHEN 3 THEN concat(CAST(conv_id % 600 AS STRING), '点。') ELSE '４５' END AS text, CASE turn % 5 WHEN 0 THEN 'station' WHEN 1 THEN 'commute_limit' WHEN 2 THEN 'naishin' WHEN 3 THEN 'toujitsu' ELSE 'naishin' END AS asked, CASE WHEN turn % 5 = 4 THEN CAST(20 AS INT) END AS had_five FROM {conversations}"


@query(
    "bare_answers",
    f"""{S.ctes(a0=_ANSWERS)} SELECT session, turn, CASE WHEN asked = 'station' THEN concat('石神井', session % 9) END AS station, CASE WHEN asked = 'commute_limit' THEN CAST(session % 200 AS INT) END AS commute_limit,
  CASE WHEN asked = 'naishin' AND had_five IS NULL THEN CAST(session % 30 AS INT) END AS naishin5, CASE WHEN asked = 'naishin' AND had_five IS NOT NULL THEN 45 END AS jitsugi, CASE WHEN asked = 'toujitsu' AND session % 600 <= 500 THEN CAST(session % 600 AS INT) END AS toujitsu FROM a0""",
)
def bare_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.of(spark, sf_dir, _ANSWERS).withColumn("slots", dialogue.extract(F.col("text")))
    read = rows.withColumn("slots", dialogue.bare_answer(F.col("text"), F.col("asked"), F.col("slots"), F.col("had_five")))
    return read.select("session", "turn", "slots.station", "slots.commute_limit", "slots.naishin5", "slots.jitsugi", "slots.toujitsu")


_REPLIES = "SELECT conv_id AS session, turn, CASE (conv_id + turn) % 11 WHEN 0 THEN 'はい' WHEN 1 THEN 'いいえ、このままで' WHEN 2 THEN '2番でお願いします' WHEN 3 THEN '大丈夫です' WHEN 4 THEN '１' WHEN 5 THEN '部活を似た種目まで' WHEN 6 THEN '通学と成績を' WHEN 7 THEN '15分広げて' WHEN 8 THEN '' WHEN 9 THEN 'それでいいです' ELSE '3' END AS text, conv_id % 4 AS k FROM {conversations}"
_OFFERED = {0: (), 1: ("commute_15",), 2: ("commute_15", "club_similar"), 3: ("commute_15", "club_similar", "score_range")}


@query(
    "relax_reply",
    f"""{S.ctes(r0=_REPLIES)}, o AS (SELECT *, list_filter(['commute_15', 'club_similar', 'score_range'], lambda x, i: i <= k) AS offered FROM r0),
h AS (SELECT *, list_filter(offered, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN regexp_matches(text, '{p}')" for k, p in dialogue.HINTS.items())} END) AS hits,
  regexp_matches(text, '{dialogue.YES}') AS yes, regexp_matches(text, '{dialogue.NO}') AS no, regexp_matches(text, '{dialogue.UNCLEAR}') AS vague,
  CAST(translate(nullif(coalesce(nullif(regexp_extract(text, '^([1-9１-９])\\s*[。.]?$', 1), ''), regexp_extract(text, '([1-9１-９])\\s*(?:番|つ目|つめ)', 1)), ''), '１２３', '123') AS INT) AS n FROM o),
u AS (SELECT *, vague AND NOT yes AND NOT regexp_matches(text, '[1-9１-９]') AND NOT ({' OR '.join(f"regexp_matches(text, '{p}')" for p in dialogue.HINTS.values())}) AS unclear, text = '' OR k = 0 AS nothing FROM h),
a AS (SELECT *, CASE WHEN n <= k THEN offered[n] END AS numbered, NOT nothing AND NOT no AND NOT unclear AS opened FROM u),
w AS (SELECT *, CASE WHEN opened THEN coalesce(numbered, CASE WHEN len(hits) = 1 THEN hits[1] END, CASE WHEN len(hits) = 0 AND yes AND k = 1 THEN offered[1] END) END AS key,
  opened AND numbered IS NULL AND (len(hits) > 1 OR (len(hits) = 0 AND yes AND k > 1)) AS which FROM a)
SELECT session, turn, key, NOT nothing AND no AS declined, NOT nothing AND NOT no AND (unclear OR which) AS ambiguous, CASE WHEN NOT nothing AND NOT no AND (unclear OR which) THEN CASE WHEN unclear THEN 'yesno' ELSE 'which' END END AS kind,
  concat_ws(',', 'club_similar', CASE WHEN key <> 'club_similar' THEN key END) AS relaxations FROM w""",
)
def relax_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = F.coalesce(*(F.when(F.col("k") == n, F.array(*map(F.lit, names)).cast("array<string>")) for n, names in _OFFERED.items()))
    rows = S.of(spark, sf_dir, _REPLIES).withColumn("offered", offered).withColumn("reply", dialogue.relax_reply(F.col("text"), F.col("offered")))
    done = dialogue.apply_relaxation(rows.withColumn("relaxations", F.array(F.lit("club_similar"))))
    return done.select("session", "turn", "reply.*", F.array_join("relaxations", ",").alias("relaxations"))


@query("llm_budget", "WITH c AS (SELECT conv_id AS session, turn, CAST(length(text) % 3 AS INT) AS calls FROM conversations), u AS (SELECT *, coalesce(sum(calls) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c) SELECT session, turn, CAST(used AS BIGINT) AS used, used < 4 AS allowed, CAST(greatest(0, 4 - used - calls) AS BIGINT) AS remaining FROM u")
def llm_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", (F.length("text") % 3).alias("calls"))
    return dialogue.budget(turns, "session", "turn", F.col("calls"), 4).select("session", "turn", "used", "allowed", F.col("remaining").cast("long").alias("remaining"))


@query("model_gate", _SLOTS + """, g AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'station' WHEN 1 THEN 'naishin' WHEN 2 THEN 'wants' END AS asked FROM slots)
SELECT session, turn, asked IS NULL OR asked = 'wants' OR NOT (CASE asked WHEN 'naishin' THEN naishin5 IS NOT NULL OR jitsugi IS NOT NULL OR sonai IS NOT NULL WHEN 'station' THEN station IS NOT NULL END OR declines) AS use_model FROM g""")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("turn") % 4 == 0, "station").when(F.col("turn") % 4 == 1, "naishin").when(F.col("turn") % 4 == 2, "wants")
    return _extracted(spark, sf_dir).select("session", "turn", dialogue.needs_model(asked, F.col("slots")).alias("use_model"))


@query("model_sanitise", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'S1' END AS station, CASE c_custkey % 4 WHEN 1 THEN 45 WHEN 2 THEN 60 END AS commute_limit, CAST(NULL AS INT) AS toujitsu, TRUE AS academic, '工' AS dept, '定時制' AS course_types, 'a' AS clubs FROM customer")
def model_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    station = F.when(key % 3 == 0, " ").otherwise("S1")
    limit = F.when(key % 4 == 0, '""').when(key % 4 == 1, "45").when(key % 4 == 2, '"60"').otherwise("500")
    rest = ', "toujitsu": null, "wants": {"academic": true, "dept": "工業", "course_types": ["夜", "定時制"], "clubs": [" a ", ""]}, "other": 1}``` ok'
    reply = F.concat(F.lit('<think>{x}</think>```json {"station": "'), station, F.lit('", "commute_limit": '), limit, F.lit(rest))
    slots = dialogue.sanitised(reply)
    found = S.table(spark, sf_dir, "customer").select(key.alias("id"), slots.alias("s"))
    return found.select("id", "s.station", "s.commute_limit", "s.toujitsu", "s.academic", "s.dept", F.array_join("s.course_types", ",").alias("course_types"), F.array_join("s.clubs", ",").alias("clubs"))


@query("rules_over_model", _SLOTS + " SELECT session, turn, coalesce(station, 'M') AS station, coalesce(commute_limit, 33) AS commute_limit, coalesce(dept, '他') AS dept, CASE WHEN len(clubs) > 0 THEN array_to_string(clubs, ',') ELSE 'm' END AS clubs FROM slots")
def rules_over_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {k: F.lit(None).cast("int") for k in dialogue.NUMERIC}
    model = F.struct(
        F.lit("M").alias("station"), *(v.alias(k) for k, v in (none | {"commute_limit": F.lit(33)}).items()), F.lit(None).cast("boolean").alias("academic"), F.lit(None).cast("string").alias("priority"), F.lit("他").alias("dept"),
        F.array().cast("array<string>").alias("course_types"), F.array(F.lit("m")).alias("clubs"),
    )
    merged = _extracted(spark, sf_dir).select("session", "turn", dialogue.over_model(F.col("slots"), model).alias("s"))
    return merged.select("session", "turn", "s.station", "s.commute_limit", "s.dept", F.array_join("s.clubs", ",").alias("clubs"))


@query(
    "resolve_station",
    """WITH q AS (SELECT c_custkey AS req_id, CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'N_1' || (c_nationkey % 10) WHEN 2 THEN '_2' ELSE 'zzz' END AS clean FROM customer), s AS (SELECT n_name AS station FROM nation),
c AS (SELECT clean, list(station ORDER BY station)[1:5] AS candidates FROM (SELECT DISTINCT clean FROM q) JOIN s ON contains(station, clean) GROUP BY clean)
SELECT req_id, CASE WHEN clean IN (SELECT station FROM s) THEN clean WHEN len(candidates) = 1 THEN candidates[1] END AS station, CASE WHEN clean IN (SELECT station FROM s) THEN '' ELSE coalesce(array_to_string(candidates, ','), '') END AS candidates FROM q LEFT JOIN c USING (clean)""",
)
def resolve_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("NATION_"), n.cast("string"), F.lit("駅"))).when(k % 4 == 1, F.concat(F.lit("N_1"), (n % 10).cast("string"))).when(k % 4 == 2, "_2").otherwise("zzz")
    asked = S.table(spark, sf_dir, "customer").select(k.alias("req_id"), said.alias("said"))
    found = dialogue.resolve_station(asked, S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("station")))
    return found.select("req_id", "station", F.array_join("candidates", ",").alias("candidates"))


@query("running_slots", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def running_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events")
    return dialogue.running_state(events, "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "last_purchase")


@query("hourly_rate_limit", "SELECT event_id, n AS nth, n <= 6 AS ok FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS INT) AS n FROM events)")
def hourly_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.rate_limit(S.table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id").select("event_id", "nth", "ok")


@query("session_ttl", "WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL")
def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue.sessions(S.table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("free_text_kept", "SELECT conv_id, array_to_string(list(turn ORDER BY turn)[-3:], ',') AS turns FROM conversations GROUP BY conv_id")
def free_text_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("l"))
    kept = F.when(F.size("l") > 3, F.slice("l", -3, 3)).otherwise(F.col("l"))
    return listed.select("conv_id", F.array_join(kept, ",").alias("turns"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = S.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(source).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _through_stream(updates: DataFrame, out: str, mode: str) -> DataFrame:
    """What a stream gave, once all that is there has gone through it."""
    write = updates.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/result/batch={n}"))
    write.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return updates.sparkSession.read.parquet(f"{out}/result")


_GAPS = """g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(
    "streaming_session_state",
    f"""WITH {_GAPS}, l AS (SELECT user_id, max(session) AS session FROM s GROUP BY user_id)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events, round(sum(value), 2) AS total, arg_max(event_type, (ts, event_id)) AS last_type FROM s JOIN l USING (user_id, session) GROUP BY user_id""",
)
def streaming_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last session of each user, after the events went through the stream once."""
    updates = sessions.session_state(_streamed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    state = _through_stream(updates, shared_folder(spark, "stream"), "update").where("not expired")
    last = state.groupBy("user_id").agg(F.max_by(F.struct("started", "ended", "events", "total", "last_type"), F.struct("ended", "events")).alias("s"))
    return last.select("user_id", "s.started", "s.ended", "s.events", F.round("s.total", 2).alias("total"), "s.last_type")


#: Conversations as turns of a dialogue, hours apart: utterances, answers of searches with offers, and what is said to these.
_TURNS = f"""
SELECT u.session, u.turn, CAST(u.turn * 3 + 26 * floor((u.turn + u.session % 3) / 3) AS BIGINT) AS hour,
  CASE (u.session + u.turn) % 4 WHEN 1 THEN NULL WHEN 2 THEN r.text ELSE u.text END AS text,
  CASE WHEN (u.session + u.turn) % 4 = 1 THEN u.session % 4 END AS k, CASE u.turn % 3 WHEN 0 THEN 'station' WHEN 1 THEN 'wants' END AS asked
FROM ({S.UTTERANCES}) u JOIN ({_REPLIES}) r ON u.session = r.session AND u.turn = r.turn"""
_STATES = [*(f"{k}" for k in ("station", *dialogue.NUMERIC, "priority", "dept"))]
_OPTIONS = "['commute_15', 'club_similar', 'score_range']"
_JOINED = ("course_types", "clubs", "relaxations", "offered")


def _fold_sql() -> str:
    """A step of the recursion for each turn: the session before it, what the turn is, and the session after it."""
    hints = ", ".join(f"CASE WHEN regexp_matches(v.text, '{p}') THEN '{k}' END" for k, p in dialogue.HINTS.items())
    keep = lambda a: f"CASE WHEN fresh THEN NULL ELSE {a} END"
    lists = ("course_types", "clubs")
    before = ", ".join([*(f"{keep(f'r_{k}')} AS b_{k}" for k in _STATES), "CASE WHEN fresh THEN false ELSE r_academic END AS b_academic", *(f"CASE WHEN fresh THEN CAST([] AS VARCHAR[]) ELSE r_{k} END AS b_{k}" for k in (*lists, "relaxations", "offered"))])
    both = lambda k: f"list_concat(b_{k}, e_{k})"
    merged = ", ".join(
        [
            *(f"CASE WHEN done = 'slots' THEN coalesce(e_{k}, b_{k}) ELSE b_{k} END" for k in _STATES),
            "CASE WHEN done = 'slots' THEN b_academic OR coalesce(e_academic, false) ELSE b_academic END",
            *(f"CASE WHEN done = 'slots' THEN {_UNIQUE.format(both(k))} ELSE b_{k} END" for k in lists),
            "CASE WHEN done = 'accepted' AND NOT list_contains(b_relaxations, key) THEN list_append(b_relaxations, key) ELSE b_relaxations END",
            "CASE done WHEN 'offer' THEN offers WHEN 'unclear' THEN b_offered ELSE CAST([] AS VARCHAR[]) END",
        ]
    )
    columns = [*_STATES, "academic", *lists, "relaxations", "offered"]
    none = ", ".join([*("CAST(NULL AS VARCHAR)" if k in ("station", "priority", "dept") else "CAST(NULL AS INTEGER)" for k in _STATES), "false", *["CAST([] AS VARCHAR[])"] * 4])
    return rf"""{_SLOTS.replace(S.ctes(u0=S.UTTERANCES), S.ctes(u0=_TURNS))},
v AS (SELECT *, list_filter([{hints}], lambda x: x IS NOT NULL) AS named, CASE WHEN k IS NOT NULL THEN {_OPTIONS}[1:k] END AS offers,
  regexp_matches(text, '{dialogue.YES}') AS yes, regexp_matches(text, '{dialogue.NO}') AS no, regexp_matches(text, '{dialogue.UNCLEAR}') AS vague, regexp_matches(text, '[1-9１-９]') AS digits,
  CAST(translate(nullif(coalesce(nullif(regexp_extract(text, '^([1-9１-９])\s*[。.]?$', 1), ''), regexp_extract(text, '([1-9１-９])\s*(?:番|つ目|つめ)', 1)), ''), '１２３４５６７８９', '123456789') AS INT) AS number FROM u0 v),
e AS (SELECT v.*, {", ".join(f"s.{k} AS e_{k}" for k in columns[:-2])}, row_number() OVER (PARTITION BY v.session ORDER BY v.turn) AS rn,
  CASE WHEN asked = 'station' THEN s.station IS NULL AND NOT s.declines ELSE true END AS wants FROM v JOIN slots s ON s.session = v.session AND s.turn = v.turn),
r(session, rn, turn, hour, number, done, calls, allowed, {", ".join(f"r_{k}" for k in columns)}) AS (
  SELECT session, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(NULL AS VARCHAR), 0, CAST(NULL AS BOOLEAN), {none} FROM (SELECT DISTINCT session FROM e)
  UNION ALL
  SELECT session, rn, turn, CASE WHEN done = 'unclear' AND last IS NOT NULL AND NOT fresh THEN last ELSE hour END, sessions + CAST(fresh AS INTEGER), done,
    used + CAST(done = 'slots' AND wants AND used < 3 AS INTEGER), used < 3, {merged}
  FROM (
    SELECT *, CASE WHEN offers IS NOT NULL THEN 'offer' WHEN len(b_offered) = 0 OR text = '' THEN 'slots' WHEN no THEN 'declined' WHEN vague AND NOT yes AND NOT digits AND len(named) = 0 THEN 'unclear'
        WHEN number <= len(b_offered) THEN 'accepted' WHEN len(hits) = 1 THEN 'accepted' WHEN len(hits) > 1 THEN 'unclear' WHEN yes AND len(b_offered) = 1 THEN 'accepted' WHEN yes THEN 'unclear' ELSE 'slots' END AS done,
      CASE WHEN number <= len(b_offered) THEN b_offered[number] WHEN len(hits) = 1 THEN hits[1] ELSE b_offered[1] END AS key
    FROM (
      SELECT *, list_filter(b_offered, lambda x: list_contains(named, x)) AS hits
      FROM (SELECT *, {before} FROM (SELECT e.*, r.hour AS last, r.number AS sessions, r.calls AS used, {", ".join(f"r.r_{k}" for k in columns)}, r.hour IS NULL OR e.hour > r.hour + 24 AS fresh FROM r JOIN e ON e.session = r.session AND e.rn = r.rn + 1)))))
SELECT session, turn, number AS session_no, done, {", ".join(f"r_{k} AS {k}" for k in _STATES)}, r_academic AS academic, {", ".join(f"array_to_string(r_{k}, ',') AS {k}" for k in _JOINED)}, calls, allowed FROM r WHERE rn > 0"""


@query("streaming_dialogue", _fold_sql())
def streaming_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each session after each turn: slots, the open offer and the calls made, folded on a stream."""
    source = S.table(spark, sf_dir, "conversations").schema
    spoken = spark.readStream.schema(source).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    said = spark.sql(_TURNS, conversations=spoken.select("conv_id", "turn"))
    options = F.array(*(F.lit(x) for x in _OFFERED[3]))
    said = said.select("session", "turn", F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600).alias("at"), "text", "asked", F.when(F.col("k").isNotNull(), F.slice(options, 1, F.coalesce("k", F.lit(0)).cast("int"))).alias("offers"))
    with turns.state_store(spark):
        rows = _through_stream(turns.fold_turns(turns.read_turns(said, asked="asked"), most=3), shared_folder(spark, "stream"), "append")
    return rows.where("turn is not null").select("session", "turn", "session_no", "done", *_STATES, "academic", *(F.array_join(k, ",").alias(k) for k in _JOINED), "calls", "allowed")


@query("streaming_upsert", "SELECT user_id, count(*) AS n, max(ts) AS at FROM events GROUP BY user_id")
def streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "stream")
    table = sessions.counters(Store(spark, f"{out}/store"))
    _added(sessions.counted(_streamed(spark, sf_dir)), table, out)
    return table.read()


@query(
    "streaming_key_values",
    """WITH l AS (SELECT user_id, max(ts) AS at FROM events GROUP BY user_id), v AS (SELECT CAST(user_id AS VARCHAR) AS key, l.at AS put, max(event_type || ':' || event_id) AS value FROM events JOIN l USING (user_id) WHERE ts = l.at GROUP BY ALL)
SELECT key, value, put AS at FROM v WHERE put + INTERVAL 24 HOUR > (SELECT max(ts) - INTERVAL 48 HOUR FROM events)""",
)
def streaming_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value put of each key, of those that hadn't expired two days before the last event."""
    out = shared_folder(spark, "stream")
    table = sessions.values(Store(spark, f"{out}/store"))
    put = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    _added(_streamed(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), put.alias("value"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at")), table, out)
    now = S.table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 48 HOURS")).alias("now"))
    return table.read().join(F.broadcast(now), F.col("expires_at") > F.col("now")).select("key", "value", "at")


def _added(stream: DataFrame, table: Folded, out: str) -> None:
    stream.writeStream.foreachBatch(table.add).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
