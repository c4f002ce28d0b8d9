"""Aggregations: best results, first-wins deduplication, fallback averages, histograms, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import ranks, text
from larkspan.session import shared_folder


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    ranked = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__nth = 1").drop("__nth")


def furthest_stage(games: DataFrame, keys: list[str]) -> DataFrame:
    """The furthest stage of each key (a win beats a loss of the same stage) and what it means."""
    best = games.groupBy(*keys).agg(F.max(F.struct("stage", "won")).alias("best"))
    return best.select(*keys, "best.stage", "best.won", ranks.stage_label(F.col("best.stage"), F.col("best.won")).alias("label"))


def strongest(results: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """The strongest result of each key; of equal ones the greatest rank text."""
    best = results.groupBy(*keys).agg(F.max(F.struct(ranks.strength(F.col(rank)).alias("strength"), F.col(rank).alias("rank"))).alias("best"))
    return best.select(*keys, "best.rank", "best.strength")


def best_achievement(results: DataFrame, keys: list[str]) -> DataFrame:
    """The best result of each key: official ones first, then by level of the meet, points of the rank, order."""
    scored = results.withColumn("level", ranks.meet_level(F.col("meet"))).withColumn("points", ranks.rank_score(F.col("rank")))
    order = Window.partitionBy(*keys).orderBy(F.col("official").desc(), F.col("level").desc(), F.col("points").desc(), "seq")
    return scored.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").withColumn("shown", ranks.shown_rank(F.col("rank"), F.col("level")))


def fuzzy_dedupe(items: DataFrame, group: list[str], name: str, category: str, order: str) -> DataFrame:
    """One spelling for names of the same characters: one with an organisation suffix first, then the earliest.

    The first category that any spelling has is kept.
    """
    keyed = items.withColumn("key", text.sorted_key(F.regexp_replace(F.col(name), "(" + "|".join(text.SUFFIXES) + ")$", "")))
    plain = text.organisation(F.col(name)) == ""
    return keyed.groupBy(*group, "key").agg(
        F.min(F.struct(plain.alias("plain"), F.col(order).alias("seq"), F.col(name).alias("name"))).getField("name").alias(name),
        F.min(F.when(F.col(category).isNotNull(), F.struct(F.col(order).alias("seq"), F.col(category).alias("category")))).getField("category").alias(category),
        F.count("*").alias("spellings"),
    )


def rollup_courses(rows: DataFrame, key: str) -> DataFrame:
    """Per key: departments in order of appearance, students in total, and flags of the courses it has."""
    students = F.sum(F.replace("students", F.lit(","), F.lit("")).try_cast("long"))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "department"))), lambda x: x["department"]))
    return rows.groupBy(key).agg(
        F.array_join(listed, text.DOT).alias("departments"), students.alias("students"), F.bool_or(F.col("course") == "全日制").alias("full_time"), F.bool_or(F.col("course") == "定時制").alias("evening")
    )


def ratio_average(rows: DataFrame, preferred: Column) -> DataFrame:
    """Mean yearly ratio of each school: its preferred row of the year (the last), else the year's first row."""
    marked = rows.withColumn("preferred", preferred)
    order = Window.partitionBy("school", "year").orderBy(F.col("preferred").desc(), F.when(F.col("preferred"), -F.col("seq")).otherwise(F.col("seq")))
    yearly = marked.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return yearly.groupBy("school").agg(F.round(F.avg("ratio"), 2).alias("ratio_avg"), F.count("*").alias("years"), F.max_by("ratio", "year").alias("ratio_last"))


def calibration(rows: DataFrame, line: str, ratio: str, evidence: str) -> DataFrame:
    """The factor of each line: half of least and mean ratio, at most 1, with its evidence."""
    return rows.groupBy(line).agg(
        F.round(F.least(F.lit(1.0), (F.min(ratio) + F.avg(ratio)) / 2), 2).alias("factor"), F.array_join(F.array_sort(F.collect_list(evidence)), " / ").alias("evidence")
    )


def histogram(rows: DataFrame, value: Column, top: int | None = None) -> DataFrame:
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(top) if top else counts


def bucket_histogram(rows: DataFrame, value: Column, bounds: list[int]) -> DataFrame:
    """Counts up to each bound, and above the last."""
    label = F.lit(f">{bounds[-1]}")
    for b in reversed(bounds):
        label = F.when(value <= b, f"<={b}").otherwise(label)
    return rows.where(value.isNotNull()).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def latest_groups(rows: DataFrame, group: str, n: int, within: list[str] | None = None) -> DataFrame:
    """Rows of the latest n distinct groups; the groups are found apart from the rows."""
    groups = rows.select(*(within or []), group).distinct()
    if within:
        kept = groups.withColumn("nth", F.row_number().over(Window.partitionBy(*within).orderBy(F.col(group).desc()))).where(F.col("nth") <= n).drop("nth")
    else:
        kept = groups.orderBy(F.col(group).desc()).limit(n)
    return rows.join(kept, [*(within or []), group], "left_semi")


def upsert_counter(stored: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Counters with additions: sums of n, the latest time and what came with it."""
    every = stored.unionByName(added)
    return every.groupBy(key).agg(F.sum("n").alias("n"), F.max("at").alias("at"), F.max_by("last", F.struct("at", "last")).alias("last"))


def encode(rows: DataFrame, group: str, word: str) -> tuple[DataFrame, DataFrame]:
    """The sorted distinct words with their numbers, and each group's sorted numbers.

    Words are ranked within ranges of a sort and the ranges' counts added up, so that no task sees them all.
    """
    words = rows.select(F.col(word).alias("word")).where("word is not null").distinct()
    ranged = words.repartitionByRange("word").sortWithinPartitions("word").select("word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid"))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    # one row per task
    before = parts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = ranged.join(F.broadcast(before), "part").select("word", (F.col("before") + F.col("mid") - F.col("first")).alias("number"))
    coded = rows.select(group, F.col(word).alias("word")).distinct().join(numbered, "word").groupBy(group).agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    return numbered, coded


def spelling_counts(rows: DataFrame, spelling: str, holder: str, kind: str) -> DataFrame:
    """Per spelling: how many distinct holders have it, and of how many kinds they are."""
    return rows.groupBy(spelling).agg(F.count_distinct(holder).alias("holders"), F.count_distinct(kind).alias("kinds"))


def expected_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Row counts against what they should be, one row per table."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(expected.get(name)).cast("long").alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))


def top_elements(values: Column, n: int) -> Column:
    """The n longest elements of an array, in their order."""
    numbered = F.transform(values, lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.transform(F.slice(F.array_sort(numbered), 1, n), lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


def within_budget(values: Column, budget: int, least: int, between: str = "") -> Column:
    """Distinct elements in order while they fit the budget of characters, joined; null if fewer than ``least``."""
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["full"] & (acc["used"] + F.length(x) <= budget)
        return F.struct(
            F.when(fits, acc["used"] + F.length(x)).otherwise(acc["used"]).alias("used"), (acc["full"] | ~fits).alias("full"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept")
        )

    kept = F.aggregate(F.array_distinct(values), start, step, lambda acc: acc["kept"])
    return F.when(F.size(kept) >= least, F.array_join(kept, between))


def best_links(links: DataFrame, page: str = "page_id") -> DataFrame:
    """The best and the second link of each page: by score, then shorter address, then address."""
    once = links.groupBy(page, "url").agg(F.max("score").alias("score")).where("score > 0")
    order = Window.partitionBy(page).orderBy(F.col("score").desc(), F.length("url"), "url")
    ranked = once.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    return ranked.groupBy(page).agg(F.max(F.when(F.col("nth") == 1, F.col("url"))).alias("url"), F.max(F.when(F.col("nth") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("nth") == 2, F.col("url"))).alias("url_alt"))


def positions(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their place (``pos``, from 1) in the order: a range sort, and the rows before each part of it."""
    spark = rows.sparkSession
    path = shared_folder(spark, "sorted")
    rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    # a part's number is in the upper bits
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    numbered = kept.withColumn("__part", part).join(F.broadcast(before), "__part")
    return numbered.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("pos"))
