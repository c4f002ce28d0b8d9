"""Items and links of web pages, in document order."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.operators import sequences
from larkspan.session import shared_folder

#: Headings, list items, table cells and links, with their contents.
TOKEN = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>|<li\b[^>]*>.*?</li>|<td\b[^>]*>.*?</td>"
LINK = r"(?is)<a\b[^>]*\bhref\s*=\s*\"[^\"]*\"[^>]*>.*?</a>"
BINARY = r"(?i)\.(pdf|jpe?g|png|gif|zip|docx?|xlsx?)$"
# Points of words in an address or a label of a link to a list of clubs.
LINK_POINTS = {"部活動": 10, "クラブ": 4, "部": 2, "club": 3}


def tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, pos, kind (heading or item), value and the heading above."""
    found = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(text.strip_noise(F.col(html_col)), F.lit(f"({TOKEN})"), 1)).alias("pos", "token"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.col("token"), r"(?s)<[^>]*>", " "), r"[\s　]+", " "))
    kind = F.when(F.lower("token").startswith("<h"), "heading").otherwise("item")
    typed = found.select(id_col, "pos", kind.alias("kind"), plain.alias("value"))
    return sequences.carry_forward(typed, [id_col], "pos", F.when(F.col("kind") == "heading", F.col("value")), "heading")


def items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items under their headings, each value once a page."""
    listed = tokens(pages, id_col, html_col).where("kind = 'item' and value <> ''")
    return listed.withColumn("nth", F.row_number().over(Window.partitionBy(id_col, "value").orderBy("pos"))).where("nth = 1").select(id_col, "pos", "value", "heading")


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, url and label of each link."""
    found = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(text.strip_noise(F.col(html_col)), F.lit(f"({LINK})"), 1)).alias("pos", "token"))
    url = F.regexp_replace(F.regexp_extract("token", r"(?is)href\s*=\s*\"([^\"]*)\"", 1), r"[?#].*$", "")
    return found.select(id_col, "pos", url.alias("url"), F.trim(F.regexp_replace("token", r"(?s)<[^>]*>", " ")).alias("label"))


def link_score(url: Column, label: Column, points: dict[str, int] | None = None) -> Column:
    """Points of the words that address and label have, added."""
    out = F.lit(0)
    for word, n in (points or LINK_POINTS).items():
        out = out + F.when(label.contains(word) | F.lower(url).contains(word), n).otherwise(0)
    return out


def below(url: Column, base: Column) -> Column:
    """Whether an address lies under the directory of another, on the same host, and is no file to download."""
    directory = F.regexp_replace(F.parse_url(base, F.lit("PATH")), "[^/]*$", "")
    same = F.parse_url(url, F.lit("HOST")) == F.parse_url(base, F.lit("HOST"))
    return F.coalesce(same & F.startswith(F.parse_url(url, F.lit("PATH")), directory) & ~url.rlike(BINARY), F.lit(False))


def strategies(pages: DataFrame, marker: str, id_col: str = "page_id", html_col: str = "html", enough: int = 5) -> DataFrame:
    """Names by lists of a marked class and by links, else (fewer than ``enough``) by any item."""
    marked = pages.select(id_col, F.regexp_extract_all(text.strip_noise(F.col(html_col)), F.lit(rf"(?is)(<ul\b[^>]*class\s*=\s*\"[^\"]*{marker}[^\"]*\"[^>]*>.*?</ul>)"), 1).alias("lists"))
    one = items(marked.select(id_col, F.array_join("lists", "").alias(html_col)), id_col, html_col).select(id_col, "value", F.lit(1).alias("strategy"))
    two = links(pages, id_col, html_col).where(F.col("url").contains(marker)).select(id_col, F.col("label").alias("value"), F.lit(2).alias("strategy"))
    both = one.unionByName(two).where("value <> ''")
    counts = both.groupBy(id_col).agg(F.count_distinct("value").alias("n"))
    generic = items(pages, id_col, html_col).join(counts.where(F.col("n") >= enough), id_col, "left_anti").select(id_col, "value", F.lit(3).alias("strategy"))
    every = both.unionByName(generic)
    return every.groupBy(id_col, "value").agg(F.min("strategy").alias("strategy"))


def ranked_links(pages: DataFrame, words: list[str], most: int = 4, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The first links of each page by the first word of the list that address or label has: page, nth, url.

    Addresses are whole and distinct; files to download don't count. Of one rank the first on the page leads.
    """
    base = pages.select(F.col(id_col), F.col(url_col).alias("__base"))
    found = links(pages, id_col, html_col).join(base, id_col).where("url <> ''").withColumn("whole", text.resolved(F.col("__base"), F.col("url")))
    said = F.concat_ws(" ", "url", "label")
    rank = F.coalesce(*(F.when(said.contains(w), i) for i, w in enumerate(words)))
    best = found.withColumn("rank", rank).where("rank is not null").where(~F.lower("whole").rlike("[.](pdf|jpg|png)$")).groupBy(id_col, "whole").agg(F.min(F.struct("rank", "pos")).alias("b"))
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("b"))
    return best.withColumn("nth", nth).where(F.col("nth") <= most).select(id_col, "nth", F.col("whole").alias("url"))


def headed_links(pages: DataFrame, marks: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", link: str = LINK) -> DataFrame:
    """page, pos, url (whole), label and, for each mark, what the last one before the link said: headings, contests, years, groups.

    marks: patterns with one group. Links and marks are one stream of tokens, in the order of the page; what isn't said before is null.
    """
    body = text.strip_noise(F.col(html_col)) if link == LINK else F.col(html_col)
    every = "|".join(f"(?:{re.sub('^[(][?][a-z]+[)]', '', p)})" for p in (link, *marks.values()))
    plain = re.sub(r"(?<!\\)\((?!\?)", "(?:", every)
    tokens = pages.select(F.col(id_col), F.col(url_col).alias("__base"), F.posexplode(F.regexp_extract_all(body, F.lit(f"(?is)({plain})"), 1)).alias("pos", "token"))
    said = {m: F.when(F.col("token").rlike(f"(?is)^(?:{p})$"), F.trim(F.regexp_replace(F.regexp_extract("token", f"(?is){p}", 1), r"(?s)<[^>]*>", " "))) for m, p in marks.items()}
    rows = tokens.select("*", F.col("token").rlike(f"(?is)^(?:{re.sub('^[(][?][a-z]+[)]', '', link)})$").alias("is_link"), *(v.alias(f"__{m}") for m, v in said.items()))
    for m in marks:
        rows = sequences.carry_forward(rows, [id_col], "pos", F.col(f"__{m}"), m)
    href = F.regexp_replace(F.regexp_extract("token", r"""(?is)href\s*=\s*["']([^"']*)["']""", 1), "#.*$", "")
    label = F.trim(F.regexp_replace("token", r"(?s)<[^>]*>", " "))
    return rows.where("is_link").select(id_col, "pos", text.resolved(F.col("__base"), href).alias("url"), label.alias("label"), *marks)


def entry_links(pages: DataFrame, labels: tuple[str, ...], addresses: tuple[str, ...], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url and next: the first link of each page, on its host and not to itself, whose label has one of the words or whose path one of the others."""
    found = links(pages.select(F.col(url_col).alias("page_url"), F.col(html_col).alias("html")), "page_url", "html").where("url <> ''")
    whole = found.select("page_url", "pos", text.resolved(F.col("page_url"), F.col("url")).alias("next"), F.regexp_replace("label", r"(?U)\s+", "").alias("label"))
    path = F.lower(F.regexp_replace("next", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))
    host = lambda c: F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    named = reduce(lambda a, b: a | b, [F.lit(False), *(F.contains("label", F.lit(w)) for w in labels), *(F.contains(path, F.lit(w)) for w in addresses)])
    itself = F.regexp_replace("next", "/+$", "") == F.regexp_replace("page_url", "/+$", "")
    able = whole.where((host("next") == host("page_url")) & ~itself & named)
    return able.groupBy(F.col("page_url").alias("url")).agg(F.min_by("next", "pos").alias("next"))


def follow(fetched: DataFrame, starts: DataFrame, choose: Callable[[DataFrame], DataFrame], *, hops: int) -> DataFrame:
    """start, hop and url of the pages that are reached from each start by the links that ``choose`` gives (url, next), for at most so many hops.

    fetched: url and html of pages at hand. An address that isn't fetched is reached, but leads nowhere. A frontier goes on until nothing new is
    reached: what a start has seen is left out by an anti-join, so that circles end.
    """
    spark, base = fetched.sparkSession, shared_folder(fetched.sparkSession, "frontier")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    frontier = kept(starts.select("start", F.lit(0).alias("hop"), F.col("start").alias("url")).distinct(), "hop-0")
    seen = frontier
    for hop in range(1, hops + 1):
        here = fetched.join(frontier.select("url").distinct(), "url", "left_semi")
        reached = frontier.select("start", "url").join(choose(here), "url").select("start", F.lit(hop).alias("hop"), F.col("next").alias("url")).distinct()
        frontier = kept(reached.join(seen.select("start", "url"), ["start", "url"], "left_anti").select("start", "hop", "url"), f"hop-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
