"""The registered queries of this subpackage, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import audit, bpe, chat, decontamination, fingerprint, language, license, lines, minhash, passages, quality, runs, store, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(_table(spark, sf_dir, "pages"), store.scratch(spark, "warc"))
    return found.select(warc.page_id(F.col("record_id")).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", warc.page_id(F.col("refers_to_record")).alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (d)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS r(i)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM d, ms, unnest(range(1, len(w) - m + 2)) AS r(i)),
h AS (SELECT dw.doc_id, dw.m, dw.i, bw.item FROM dw JOIN bw USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "stays")


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(language.evidence(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, which have an address and markup."""
    return language.identify(language.page_evidence(_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passages(_table(spark, sf_dir, "documents"))
    names = {"id": "doc_id", "start": "start_word", "end": "end_word", "first_id": "first_doc_id", "first_start": "first_start_word"}
    return passages.members(found).withColumnsRenamed(names)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(license.page_files(_table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "path", "license", "cosine", "known", "directory")


def _op6_sql() -> str:
    vectors = license.Vectors()
    notices = ", ".join(f"({i}, '{name}', '{t}', CAST({x!r} AS DOUBLE))" for i, (name, v) in enumerate(vectors.notices) for t, x in v.items())
    idf = ", ".join(f"('{t}', CAST({x!r} AS DOUBLE))" for t, x in sorted(vectors.idf.items()))
    none = ", ".join(f"'{x}'" for x in license.FUNCTION_WORDS)
    names = ", ".join(f"'{x}'" for x in license.LICENSE_FILES)
    index = ", ".join(f"'{x}'" for x in license.INDEX_FILES if x)
    deciding = ", ".join(f"'{x}'" for x in license.DECIDING)

    def has(words: tuple[str, ...]) -> str:
        return "list_has_any(m, [" + ", ".join(f"'{x}'" for x in words) + "])" if words else "false"

    fits = " ".join(f"WHEN '{name}' THEN {' AND '.join([*map(has, r.needs), f'NOT {has(r.bars)}', f'({has(r.versions)} OR NOT {has(r.others)})'])}" for name, r in license.RULES.items())
    return rf"""
WITH RECURSIVE v(notice, name, t, x) AS (VALUES {notices}), idf(t, w) AS (VALUES {idf}),
f AS (
  SELECT page_id AS id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '') AS path,
    lower(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(10), 'g'),
      '(?i)</?(p|div|h[1-6]|li|ul|ol|br|article|nav|footer|header|title|td|tr|table|section|body|head|html)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>|&[#A-Za-z0-9]+;', ' ', 'g')) AS low
  FROM pages),
units AS (
  SELECT id, unit, list_filter(regexp_extract_all(unit, '{license._TERM}'), lambda x: x NOT IN ({none})) AS terms
  FROM (SELECT DISTINCT id, unnest(list_concat(string_split(low, chr(10)), regexp_split_to_array(low, '{license.PARAGRAPH}'), [low])) AS unit FROM f)),
tf AS (SELECT id, unit, t, count(*) AS n FROM (SELECT id, unit, unnest(terms) AS t FROM units) GROUP BY ALL),
w AS (SELECT id, unit, t, n * coalesce(idf.w, CAST({vectors.unseen!r} AS DOUBLE)) AS w FROM tf LEFT JOIN idf USING (t)),
len AS (SELECT id, unit, sqrt(sum(w * w)) AS length FROM w GROUP BY ALL),
dot AS (SELECT id, unit, notice, name, sum(w * x) AS d FROM w JOIN v USING (t) GROUP BY ALL),
marks AS (SELECT id, unit, list(t) AS m FROM tf WHERE t IN ({deciding}) GROUP BY ALL),
fit AS (SELECT dot.*, coalesce(m, CAST([] AS VARCHAR[])) AS m FROM dot LEFT JOIN marks USING (id, unit)),
c AS (SELECT id, name, round(max(d / length), 9) AS cosine FROM fit JOIN len USING (id, unit) WHERE CASE name {fits} ELSE true END GROUP BY ALL),
best AS (SELECT id, name, cosine FROM c WHERE cosine >= {license.COSINE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, name) = 1),
own AS (SELECT f.id, path, name AS license, round(cosine, 6) AS cosine FROM f LEFT JOIN best USING (id)),
named AS (
  SELECT path, license, regexp_replace(path, '/+$', '') AS bare, regexp_replace(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$'), '\.[a-z0-9]+$', '') AS name,
    path LIKE '%/' OR regexp_replace(path, '/+$', '') NOT LIKE '%/%' AS top FROM own WHERE license IS NOT NULL AND path IS NOT NULL),
kinds AS (
  SELECT path, license, CASE WHEN top THEN bare ELSE regexp_replace(bare, '/[^/]*$', '') END AS directory,
    CASE WHEN name IN ({names}) THEN 0 WHEN top OR name IN ({index}) THEN 1 END AS kind FROM named),
dirs AS (SELECT directory, license FROM kinds WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY directory ORDER BY kind, path, license) = 1),
parts AS (SELECT DISTINCT path, string_split(regexp_replace(path, '/+$', ''), '/') AS p FROM own WHERE license IS NULL AND path IS NOT NULL),
above AS (SELECT path, depth, array_to_string(p[1 : depth], '/') AS directory FROM parts, unnest(range(1, greatest(len(p) - 1, 1) + 1)) AS r(depth)),
near AS (SELECT path, directory, license AS near FROM above JOIN dirs USING (directory) QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC) = 1)
SELECT id AS page_id, own.path, coalesce(license, near) AS license, cosine,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS known,
  CASE WHEN license IS NULL THEN directory END AS directory
FROM own LEFT JOIN near ON own.path = near.path
"""


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(_table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
w AS (
  SELECT doc_id, i, trim(line, ' ') AS x, lead(trim(line, ' ')) OVER o AS y, lead(trim(line, ' '), 2) OVER o AS z
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS nth
  FROM w WHERE z IS NOT NULL AND NOT (x = '' AND y = '' AND z = '')),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM n WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id
"""


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS later
  FROM documents),
m AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'), later] AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
k(i) AS (VALUES (1), (2), (3), (4), (5)),
p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p
  FROM k a JOIN k b ON b.i <> a.i JOIN k c ON c.i NOT IN (a.i, b.i) JOIN k d ON d.i NOT IN (a.i, b.i, c.i) JOIN k e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT p, step, p[step] AS f, p[1 : step - 1] AS before FROM p, unnest(range(1, 6)) AS r(step)),
j AS (
  SELECT part, p, step, f, n, good, toxic, fails[f] AS failed, len(list_filter(before, lambda x: fails[x])) = 0 AS alive,
    len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM m, s),
g AS (
  SELECT part, p, step, f, sum(CASE WHEN alive AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN alive AND failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND NOT alive THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN alive AND failed THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN alive AND failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, array_to_string(list_transform(p, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g
"""


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of all documents, chosen by id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    start = split.select("doc_id", "text", "w", "g", F.when(n > 0, F.col("g") % n).alias("a"))
    placed = start.select("doc_id", "text", "w", "a", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.scan(_with_periods(_table(spark, sf_dir, "documents")))
    best = runs.greatest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CONTROLS = r"\### Assistant: </turn> ok"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings."""
    own = spark.createDataFrame([(-7, 0, "user", _CONTROLS), (-7, 1, "assistant", _CONTROLS)], "conv_id long, turn long, role string, text string")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)


def _formatted(log: DataFrame) -> DataFrame:
    return chat.read_back(chat.render(chat.fold(log))).withColumnRenamed("conv", "conv_id")


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(chat.as_log(_conversations(spark, sf_dir)))


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on the events of the same conversations: streamed lines, edits and regenerations."""
    return _formatted(chat.events_of(_conversations(spark, sf_dir)))


OP13_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROLS}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROLS}'),
f AS (
  SELECT *, CASE WHEN regexp_matches(role, '^[a-z][a-z0-9_]*$') THEN length(role) ELSE 1 + length(replace(replace(replace(role, '\', '\\'), ':', '\.'), chr(10), '\n')) END AS head,
    replace(replace(replace(t, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS escaped
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + length(escaped) + {len(chat.HEAD + chat.MIDDLE + chat.END)}) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "page_language": page_language,
    "op4_passages": op4_passages,
    "op5_quality": op5_quality,
    "op6_license": op6_license,
    "op7_fingerprint": op7_fingerprint,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_lines": op10_lines,
    "op11_audit": op11_audit,
    "op12_runs": op12_runs,
    "op13_chat": op13_chat,
    "chat_log": chat_log,
}

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op6_license": _op6_sql(),
    "op10_lines": OP10_SQL,
    "op11_audit": OP11_SQL,
    "op13_chat": OP13_SQL,
    "chat_log": OP13_SQL,
}
