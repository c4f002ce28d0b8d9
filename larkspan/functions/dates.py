"""Fiscal years and eras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the year before the era's first.
ERA_BASE = 2018


def fiscal_year(day: Column) -> Column:
    """January to March belong to the year before."""
    return F.year(F.add_months(day, -3))


def era_year(day: Column) -> Column:
    return fiscal_year(day) - ERA_BASE


def era_text(year: Column) -> Column:
    """A Gregorian year as the era's."""
    n = year - ERA_BASE
    return F.concat(F.lit("令和"), F.when(n == 1, "元").otherwise(n.cast("string")), F.lit("年度"))


def era_number(value: Column) -> Column:
    """The era year of a text; the first year may be written 元."""
    found = F.regexp_extract(F.translate(value, "０１２３４５６７８９", "0123456789"), r"令和\s*(元|\d+)", 1)
    return F.when(found == "元", 1).otherwise(F.nullif(found, F.lit("")).try_cast("int"))


def edition_year(edition: Column, reference: int, era: int) -> Column:
    """Era year of a yearly edition, known for one reference edition."""
    return edition - reference + era


def hour(ts: Column) -> Column:
    """A time up to its hour, as thirteen characters."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH")
