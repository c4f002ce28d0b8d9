"""Sinks: tables, delimited text, replacement by key, nested fields, side outputs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import rollups


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Strings as loaded types: blank is null, numbers that aren't any are null, integers are cut."""
    def value(c: str) -> Column:
        x = F.nullif(F.trim(F.col(c)), F.lit(""))
        kind = kinds.get(c, "string")
        if kind == "int":
            return x.try_cast("double").try_cast("int")
        if kind == "boolean":
            return x.isNotNull()
        return x if kind == "string" else x.try_cast(kind)

    return rows.select(*(value(c).alias(c) for c in rows.columns))


def refresh(tables: dict[str, DataFrame], folder: str, *, partition: dict[str, str] | None = None) -> None:
    """Replace each table whole, parents before children."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition[name]) if partition and name in partition else writer).parquet(f"{folder}/{name}")


def write_csv(rows: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """The named columns, which must be all there are, in their order."""
    if odd := set(rows.columns) ^ set(columns):
        raise ValueError(f"columns that are not expected or missing: {', '.join(sorted(odd))}")
    out = rows.select(*columns)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_json_gz(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def inject(nested: DataFrame, values: DataFrame, key: str, field: str) -> DataFrame:
    """Rows with a nested field set where there is a value, and removed where there is none."""
    columns = [c for c in values.columns if c != key]
    joined = nested.drop(field).join(values.select(key, F.struct(*columns).alias(field)), key, "left")
    return joined


def to_documents(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias(name))


def append_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` and those new rows whose key it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns), allowMissingColumns=True)


def put(table: DataFrame, new: DataFrame, ttl: str) -> DataFrame:
    """A table of key, value and expiry with new values, which expire after a while."""
    fresh = new.select("key", "value", (F.current_timestamp() + F.expr(f"INTERVAL {ttl}")).alias("expires_at"))
    return table.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def write_valid(good: DataFrame, bad: DataFrame, path: str, failures: str) -> bool:
    """Valid rows to one folder, the others with their reasons to another, which goes if there are none."""
    good.write.mode("overwrite").parquet(path)
    if bad.isEmpty():
        spark: SparkSession = good.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(failures)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        return False
    bad.write.mode("overwrite").parquet(failures)
    return True


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small table as a report; what is beyond ``most`` rows is only counted."""
    shown = rows.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in shown[:most]]
    if len(shown) > most:
        lines.append(f"\n… {rows.count() - most} more rows")
    return "\n".join(lines) + "\n"


def report(rows: DataFrame, title: str, order: list[str], *, summary: str | None = None) -> DataFrame:
    """A table of any size as the lines of a Markdown report: pos and line; null cells are empty, bars in cells are escaped."""
    spark = rows.sparkSession
    cells = F.concat_ws(" | ", *(F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"\s+", " "), F.lit("")) for c in rows.columns))
    head = [f"# {title}", *([summary] if summary else []), "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    body = rollups.positions(rows, *order).select((F.col("pos") + len(head) - 1).alias("pos"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return spark.createDataFrame(list(enumerate(head)), "pos long, line string").unionByName(body)


def literal(x: Column) -> Column:
    """A value as an SQL literal: quotes doubled, null as NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def insert_statements(rows: DataFrame, table: str, columns: dict[str, bool], order: list[str], per: int = 100) -> DataFrame:
    """INSERT statements of ``per`` rows each, numbered; ``columns``: which are written, and whether as text."""
    tuples = F.concat(F.lit("("), F.concat_ws(", ", *(literal(F.col(c)) if quoted else F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c, quoted in columns.items())), F.lit(")"))
    placed = rollups.positions(rows, *order).select(F.floor((F.col("pos") - 1) / per).alias("chunk"), "pos", tuples.alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])
    head = f"INSERT INTO {table} ({', '.join(columns)}) VALUES\n  "
    return placed.groupBy("chunk").agg(listed.alias("l")).select("chunk", F.concat(F.lit(head), F.array_join("l", ",\n  "), F.lit(";")).alias("statement"))
