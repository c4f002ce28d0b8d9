"""Gates and checks: persons, duplicates, references, structure."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns and words that give persons away; in a column's name in any case of letters.
PERSON_COLUMNS = ("氏名", "名前", "選手名", "name", "student", "学年", "grade")
PERSON_TEXT = r"(さん|君|くん|選手)(?![権団])|[一-龥]{1,2}\s[一-龥]{1,2}\s*(?:さん|君|選手)"


@dataclass(frozen=True)
class PersonRule:
    """What a source must not hold: words in some columns (None: in any), and columns by part of their name or by their whole name."""

    pattern: str | None = PERSON_TEXT
    columns: tuple[str, ...] | None = None
    forbidden: tuple[str, ...] = ()
    whole: bool = False

    def forbids(self, columns: list[str]) -> list[str]:
        if self.whole:
            return [c for c in columns if c in self.forbidden]
        return [c for c in columns if any(k.lower() in c.lower() for k in self.forbidden)]

    def broken(self, columns: list[str]) -> dict[str, Column]:
        """For each column that is looked at, whether it names a person."""
        looked = [c for c in columns if self.pattern and (self.columns is None or c in self.columns)]
        return {c: F.coalesce(F.col(c).cast("string").rlike(f"(?U){self.pattern}"), F.lit(False)) for c in looked}


# The checks of each source of results. What a page may hold differs: where baseball is played there are pitchers, "君" also ends the names of schools.
PERSON_RULES = {
    "attributed": PersonRule(forbidden=PERSON_COLUMNS),
    "baseball": PersonRule("さん|君|くん|選手(?![権団])|投手|捕手|本塁打", ("school", "rank", "event", "division")),
    "drama": PersonRule("作：|さん|君|くん", ("school", "rank")),
    "dance": PersonRule("さん|くん|[^校]君|選手(?![権団])|作[:：]", ("line",)),
    "art": PersonRule(r"[一-龥]{1,4}[\s　]+[一-龥]{1,4}", ("school",)),
    "athletics": PersonRule(None, forbidden=("name", "選手名", "grade", "record"), whole=True),
}


def check_columns(rows: DataFrame, rule: PersonRule = PERSON_RULES["attributed"]) -> DataFrame:
    """The rows; a column that a person's data would have ends the job before it begins."""
    if found := rule.forbids(rows.columns):
        raise ValueError(f"columns of persons: {', '.join(found)}")
    return rows


def person_cells(rows: DataFrame, key: str, columns: list[str], rule: PersonRule = PERSON_RULES["attributed"]) -> DataFrame:
    """Every cell that names a person: key, column, value."""
    cells = F.array(*(F.when(bad, F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, bad in rule.broken(columns).items()))
    return rows.select(key, F.explode(F.array_compact(cells)).alias("cell")).select(key, "cell.*")


def person_cells_by_source(rows: DataFrame, key: str, source: str, columns: list[str], rules: dict[str, PersonRule] = PERSON_RULES) -> DataFrame:
    """The same for rows of several sources, each with its own rule, in one pass; a source without a rule has the common one."""
    common = PERSON_RULES["attributed"]
    known = F.coalesce(F.col(source).isin(*rules), F.lit(False))
    cells = [
        F.when(condition & bad, F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
        for condition, rule in [*((F.col(source) == name, rule) for name, rule in rules.items()), (~known, common)]
        for c, bad in rule.broken(columns).items()
    ]
    return rows.select(key, source, F.explode(F.array_compact(F.array(*cells))).alias("cell")).select(key, source, "cell.*")


def gate(rows: DataFrame, columns: list[str], rule: PersonRule = PERSON_RULES["attributed"]) -> DataFrame:
    """The rows; one that names a person ends the job."""
    bad = reduce(lambda a, b: a | b, rule.broken(columns).values())
    return rows.where(F.when(bad, F.raise_error(F.lit("a row names a person")).isNull()).otherwise(True))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    broken = rows.withColumn("reasons", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))))
    return broken.where(F.size("reasons") == 0).drop("reasons"), broken.where(F.size("reasons") > 0)


def drift(rows: DataFrame, key: str, *, headers: dict[str, tuple[Column, list[str]]] | None = None, markers: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """key and problem of rows whose structure is another than it was: arrays of cells that don't begin with their header, texts that lack a marker."""
    found = [F.when(~F.coalesce(F.slice(cells, 1, len(names)) == F.array(*map(F.lit, names)), F.lit(False)), F.lit(f"header of {what}")) for what, (cells, names) in (headers or {}).items()]
    found += [F.when(~F.coalesce(F.contains(text, F.lit(word)), F.lit(False)), F.lit(f"no {what}")) for what, (text, word) in (markers or {}).items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def steady(rows: DataFrame, key: str, **expected) -> DataFrame:
    """The rows; a structure that has drifted, or no row at all, ends the job before it begins."""
    problems = drift(rows, key, **expected).groupBy("problem").agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("first")).collect()
    if problems:
        raise ValueError("; ".join(f"{p.problem}: {p.n}, first {p.first}" for p in sorted(problems)))
    if rows.isEmpty():
        raise ValueError("no rows")
    return rows


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of the child that the parent lacks."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent, key, "left_anti")


def thin(rows: DataFrame, group: str, least: int) -> DataFrame:
    """Groups of fewer rows than expected."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)


def tagged_union(sources: dict[str, DataFrame], *, exact: bool = True) -> DataFrame:
    """All rows with the name of their source; unknown columns are an error unless missing ones may be null."""
    first = next(iter(sources.values()))
    if exact:
        for name, df in sources.items():
            if odd := set(df.columns) ^ set(first.columns):
                raise ValueError(f"{name}: unknown or missing columns {', '.join(sorted(odd))}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not exact), (df.withColumn("source", F.lit(n)) for n, df in sources.items()))


def with_subject(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have any of the columns, blank ones not counting."""
    return rows.where(F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns)).isNotNull())
