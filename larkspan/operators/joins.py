"""Entity joins: exact with checks, by prefix, by containment, by nearness, by priority.

Joins without an equality are given one: texts meet names that they begin with in a common order, spellings meet on deletions of one
character, places are gridded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import geo
from larkspan.operators import gazetteer
from larkspan.session import shared_folder

#: Places that a cell of the first grid may hold, and how often its size is halved at most.
CROWD, HALVINGS = 32, 16


def strict_lookup(rows: DataFrame, names: DataFrame, key: str, what: str = "name") -> DataFrame:
    """Rows joined to their entity; a row without one, or a key of two entities, ends the job."""
    once = names.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in names.columns if c != key))
    joined = rows.join(once, key, "left")
    checked = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).when(
        F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{what} of several: "), F.col(key).cast("string")))
    )
    return joined.where(F.coalesce(checked.cast("string"), F.lit("")) == "").drop("__n")


def unmatched(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Distinct keys without an entity."""
    return rows.select(key).distinct().join(names, key, "left_anti")


def normalise(rows: DataFrame, dictionary: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """``value`` of the dictionary for each key, else the default (the key itself)."""
    fallback = F.col(key) if default is None else default
    return rows.join(dictionary, key, "left").withColumn(value, F.coalesce(value, fallback))


def nearest(points: DataFrame, places: DataFrame, cell: float = 1.0, rings: int = 2, others: bool = False) -> DataFrame:
    """The nearest place of each point by equirectangular distance; of equal ones that of least id.

    Places within ``rings`` cells are found by an equality join on the grid; points that have none that is provably
    nearest are looked for again with cells of twice the size, until one cell holds every place. The first cells have the size ``cell``,
    halved until none holds more than ``CROWD`` places, so that what a point meets doesn't grow with the places. Of places at one spot the two of least id count. A point without
    coordinates has no place. With ``others``, a place of the point's own id doesn't count.
    """
    spark = points.sparkSession
    there = places.select(F.col("id").alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon")).where("plat is not null and plon is not null")
    there = there.withColumn("__nth", F.row_number().over(Window.partitionBy("plat", "plon").orderBy("place"))).where(F.col("__nth") <= 2).drop("__nth")
    spots = shared_folder(spark, "places")
    there.write.parquet(spots)
    there = spark.read.schema(there.schema).parquet(spots)
    cell = _uncrowded(there, cell)
    km = geo.flat(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    blank = points.where("lat is null or lon is null").select("id", F.lit(None).cast(there.schema["place"].dataType).alias("place"), F.lit(None).cast("double").alias("km"))
    rest, found = points.where("lat is not null and lon is not null").select("id", "lat", "lon"), [blank]
    while True:
        around = F.explode(F.sequence(F.lit(-rings), F.lit(rings)))
        near = rest.withColumn("dx", around).withColumn("dy", around)
        near = near.withColumn("cx", F.floor(F.col("lat") / cell) + F.col("dx")).withColumn("cy", F.floor(F.col("lon") / cell) + F.col("dy"))
        dealt = there.withColumn("cx", F.floor(F.col("plat") / cell)).withColumn("cy", F.floor(F.col("plon") / cell))
        hits = near.join(dealt, ["cx", "cy"])
        best = (hits.where("id <> place") if others else hits).select("id", km.alias("km"), "place").groupBy("id").agg(F.min(F.struct("km", "place")).alias("best"))
        # what lies outside the rings is at least this far
        safe = rings * cell * geo.DEGREE * F.least(F.lit(1.0), F.cos(F.radians(F.least(F.abs("lat") + (rings + 1) * cell, F.lit(90.0)))))
        last = cell >= 360
        known = rest.join(best, "id", "left").withColumn("sure", F.lit(last) | F.coalesce(F.col("best.km") <= safe, F.lit(False)))
        path = shared_folder(spark, "nearest")
        known.write.parquet(path)
        known = spark.read.schema(known.schema).parquet(path)
        found.append(known.where("sure").select("id", "best.place", "best.km"))
        rest = known.where("not sure").select("id", "lat", "lon")
        if last or rest.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), found)
        cell *= 2


def _uncrowded(there: DataFrame, cell: float) -> float:
    """The size, halved as often as needed, of cells of which none holds more than ``CROWD`` places."""
    for _ in range(HALVINGS):
        held = there.groupBy(F.floor(F.col("plat") / cell).alias("cx"), F.floor(F.col("plon") / cell).alias("cy")).agg(F.count("*").alias("n"))
        if (held.agg(F.max("n")).first()[0] or 0) <= CROWD:
            break
        cell /= 2
    return cell


def _prefixes(text: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda n: F.substring(text, F.lit(1), n)))


def prefix_names(texts: DataFrame, names: DataFrame, *, key: str = "text") -> DataFrame:
    """key and names: all names that each distinct text begins with, shorter ones first; texts without any are left out.

    Names and texts are sorted together by ranges. All that begins with a name follows it, so that a stack of the names that the current text begins with is all that a task keeps; what a
    range needs of the ranges before it are names that its first text begins with, found by joining the few first texts. Rows grow with texts and what they begin with,
    not with their lengths.
    """
    wanted = names.select(F.col("name").alias("value")).where("value <> ''").distinct()
    items = wanted.withColumn("kind", F.lit(0)).unionByName(texts.select(F.col(key).cast("string").alias("value")).where("value <> ''").distinct().withColumn("kind", F.lit(1)))
    ranged = items.repartitionByRange("value").sortWithinPartitions("value", "kind")
    path = shared_folder(texts.sparkSession, "prefixes")
    ranged.mapInArrow(_stacked, "value string, kind int, part int, names array<string>").write.parquet(path)
    found = texts.sparkSession.read.schema("value string, kind int, part int, names array<string>").parquet(path)
    firsts = found.where("kind = 2").select("part", "value", _prefixes(F.col("value")).alias("begin")).where("begin <> value")
    before = firsts.join(wanted.select(F.col("value").alias("begin")), "begin").groupBy("part").agg(F.array_sort(F.collect_set("begin")).alias("before"))
    # as many rows as there are ranges
    joined = found.where("kind = 1").join(F.broadcast(before), "part", "left")
    older = F.filter(F.coalesce("before", F.array().cast("array<string>")), lambda n: F.startswith("value", n) & ~F.array_contains("names", n))
    return joined.select(F.col("value").alias(key), F.concat(older, "names").alias("names")).where(F.size("names") > 0)


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted names (kind 0) and texts (1): each text with the names of this range that it begins with; the first value as kind 2."""
    part, stack, first = TaskContext.get().partitionId(), [], True
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if first:
                rows.append((value, 2, part, []))
                first = False
            while stack and not value.startswith(stack[-1]):
                stack.pop()
            if kind == 0:
                stack.append(value)
            else:
                rows.append((value, 1, part, list(stack)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["value", "kind", "part", "names"])


def longest_prefix(texts: DataFrame, names: DataFrame, *, key: str = "text") -> DataFrame:
    """The longest name that each text begins with, or null."""
    best = prefix_names(texts, names, key=key).select(key, F.element_at("names", -1).alias("name"))
    return texts.join(best, key, "left")


def qualified_prefix(texts: DataFrame, names: DataFrame, *, key: str = "text") -> DataFrame:
    """The name that a text begins with, where a ward may stand before it.

    Candidates are names at the start and names after the name's own ward. One is valid if what follows is not
    itself the start of a name; valid ones come first, then those after a ward, then longer ones.
    """
    plain = prefix_names(texts, names, key=key).select(key, F.explode("names").alias("name")).select(key, "name", F.lit(False).alias("warded"), F.length("name").alias("used"))
    whole = names.select("name", F.concat("ward", "name").alias("full")).where("ward is not null and ward <> ''")
    qualified = prefix_names(texts, whole.select(F.col("full").alias("name")), key=key).select(key, F.explode("names").alias("full"))
    warded = qualified.join(whole, "full").select(key, "name", F.lit(True).alias("warded"), F.length("full").alias("used"))
    both = plain.unionByName(warded).withColumn("rest", F.substring(F.col(key), F.col("used") + 1, F.length(key)))
    starts = prefix_names(both.select("rest"), names, key="rest").select("rest", F.lit(True).alias("again"))
    ranked = both.join(starts, "rest", "left").withColumn(
        "nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col("again").isNotNull(), F.col("warded").desc(), F.length("name").desc(), "name"))
    )
    return texts.join(ranked.where("nth = 1").select(key, "name", "warded"), key, "left")


def contained(rows: DataFrame, members: DataFrame, group: str, text: str, name: str, shortest: int = 3) -> DataFrame:
    """The longest member name of the row's group that is in its text, or has the text (of some length) in it; else ''.

    Which texts and names hold each other is found once for all groups, in passes of an automaton over the distinct ones; no group pairs its texts with its members.
    """
    asked, known = rows.select(group, text).distinct(), members.select(group, name).distinct()
    texts, names = (df.select(F.col(c).alias(c_)).where(F.col(c).isNotNull()).distinct() for df, c, c_ in ((rows, text, "__text"), (members, name, "__name")))
    inner = gazetteer.inside(texts, names.select(F.col("__name").alias("name")), "__text").select("__text", F.explode("found.name").alias("__name"))
    long = texts.where(F.length("__text") >= shortest).select(F.col("__text").alias("name"))
    outer = gazetteer.inside(names, long, "__name").select(F.explode("found.name").alias("__text"), "__name")
    # an empty text is in every name
    empty = names.crossJoin(F.broadcast(texts.where((F.col("__text") == "") & (F.lit(shortest) <= 0)))).select("__text", "__name")
    hits = inner.unionByName(outer).unionByName(empty).distinct()
    held = known.join(hits, F.col(name) == F.col("__name")).select(group, F.col("__text").alias(text), name)
    best = held.join(asked, [group, text], "left_semi").groupBy(group, text).agg(F.max(F.struct(F.length(name).alias("n"), F.col(name).alias("name"))).alias("best"))
    return rows.join(best, [group, text], "left").withColumn(name, F.coalesce("best.name", F.lit(""))).drop("best")


def reconcile(official: DataFrame, reported: DataFrame) -> DataFrame:
    """Reported results against official ones of the same entity, year and meet (first two characters).

    Class A: same sport and rank; C: same sport, another rank; D: official results of the meet, none of the sport;
    B: no official result of the entity, year and meet.
    """
    keys = ["entity", "year", "meet2"]
    left = reported.withColumn("meet2", F.substring("meet", 1, 2))
    right = official.withColumn("meet2", F.substring("meet", 1, 2)).select(*keys, F.col("sports").alias("official_sports"), F.col("rank").alias("official_rank"))
    same = F.arrays_overlap("sports", "official_sports")
    joined = left.join(right, keys, "left")
    return joined.groupBy("report_id").agg(
        F.count("official_rank").alias("n_official"),
        F.when(F.count("official_rank") == 0, "B").when(F.bool_or(same & (F.col("rank") == F.col("official_rank"))), "A").when(F.bool_or(same), "C").otherwise("D").alias("class"),
        F.array_join(F.array_sort(F.collect_set(F.when(same, F.col("official_rank")))), ",").alias("official"),
    )


def by_priority(sources: list[tuple[DataFrame, int]], keys: list[str], whole: str, value: str) -> DataFrame:
    """Rows of the strongest source that has any for ``whole``; of one strength the least value for each key."""
    every = reduce(lambda a, b: a.unionByName(b), (df.withColumn("strength", F.lit(s)) for df, s in sources))
    strongest = every.withColumn("most", F.max("strength").over(Window.partitionBy(whole))).where("strength = most").drop("most")
    ranked = strongest.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(value, *(c for c in every.columns if c not in (*keys, value)))))
    return ranked.where("nth = 1").drop("nth")


def one_character(names: DataFrame, *, name: str = "name", least: int = 4, except_pairs: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of names of one length that differ in one character.

    Names meet on what is left without one position, never all of one length with each other.
    """
    distinct = names.select(F.col(name).alias("a")).distinct().where(F.length("a") >= least)
    # a hash of what is left and of the position, not the letters; holes of one name meet none
    left = lambda i: F.xxhash64(i, F.substring("a", F.lit(1), i - 1), F.substring(F.col("a"), i + 1, F.length("a")))
    keyed = distinct.select("a", F.explode(F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: F.struct(i.alias("i"), left(i).alias("hole")))).alias("h")).select("a", "h.i", "h.hole")
    several = keyed.groupBy("hole").agg(F.count("*").alias("n")).where("n > 1").select("hole")
    met = keyed.join(several, "hole", "left_semi")
    same = (F.substring("a", F.lit(1), F.col("i") - 1) == F.substring("b", F.lit(1), F.col("i") - 1)) & (F.substring(F.col("a"), F.col("i") + 1, F.length("a")) == F.substring(F.col("b"), F.col("i") + 1, F.length("b")))
    pairs = met.join(met.withColumnRenamed("a", "b"), ["hole", "i"]).where((F.col("a") < F.col("b")) & same).select("a", "b")
    if except_pairs:
        x, y = except_pairs
        pairs = pairs.where(~((F.replace("a", F.lit(x), F.lit(y)) == F.col("b")) | (F.replace("a", F.lit(y), F.lit(x)) == F.col("b"))))
    return pairs


def abbreviations(names: DataFrame, *, name: str = "name", least: int = 3, longer: int = 3) -> DataFrame:
    """For each name the first longer names that begin with it."""
    distinct = names.select(F.col(name).alias("long")).distinct()
    short = distinct.select(F.col("long").alias("short")).where(F.length("short") >= least)
    pairs = distinct.select("long", _prefixes(F.col("long")).alias("short")).where("long <> short").join(short, "short")
    ranked = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("short").orderBy("long"))).where(F.col("nth") <= longer)
    return ranked.groupBy("short").agg(F.array_join(F.array_sort(F.collect_list("long")), ",").alias("longer"))


def both_forms(names: DataFrame, *, name: str, first: str, second: str) -> DataFrame:
    """Bases that occur with either prefix."""
    forms = names.select(F.col(name).alias("x")).distinct()
    one = forms.where(F.col("x").startswith(first)).select(F.substring(F.col("x"), F.lit(len(first) + 1), F.length("x")).alias("base"))
    other = forms.where(F.col("x").startswith(second)).select(F.substring(F.col("x"), F.lit(len(second) + 1), F.length("x")).alias("base"))
    return one.join(other, "base", "left_semi").distinct()


def drop_redundant(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows but those whose name is the beginning of a longer one of the same keys."""
    begun = rows.select(*keys, F.col(name).alias("__long")).distinct().select(*keys, "__long", _prefixes(F.col("__long")).alias(name)).where(F.col("__long") != F.col(name))
    return rows.join(begun.select(*keys, name).distinct(), [*keys, name], "left_anti")


def id_conflicts(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Entities that agree in name but not in id."""
    return left.select(key, a).join(right.select(key, b), key).where(F.col(a) != F.col(b))
