"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

A file is compared line by line (one-line notices), paragraph by paragraph (wrapped headers: consecutive lines
that are not blank) and as a whole (licence files), whatever its length; its licence is the template of greatest
cosine, at least ``COSINE``, among those whose deciding terms fit: notices of related licences differ in a word or a version (``RULES``), which no cosine
would tell apart, so that a licence without a template isn't named by a relative's name. Templates are notices and whole licence texts. A file without a licence of its own
inherits that of the nearest ancestor directory which declares one; a directory declares the licence of the licence
files in it (by name), or of the index file when it has none.

Everything is DataFrame functions. Terms and weights of the few templates are an inline table. A unit
is looked at only if it has one of the key terms of short notices, or as many terms of long ones as any of them
takes: by the Cauchy-Schwarz inequality no other unit can reach the threshold with any template, so nothing is lost. Equal units are compared once, however many files have them.
Terms that no template has count in a unit's length with the weight of a term unseen.

Defined results: null texts and empty ones have no notice; null paths are in no directory and inherit nothing; of
equal cosines the first template by name wins, and of licence files in one directory the first path; very long
texts are compared whole; repeated rows are each reported; ids are of any type; columns other than id, path and text
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import store

#: Least cosine of a match.
COSINE = 0.6
#: Terms of a notice that counts as long, at least; the key terms of the other notices are looked for one by one.
LONG = 20
#: File names, without extension and in lower case, that make a file a licence file; and index files.
LICENSE_FILES = ("license", "licence", "copying", "copyright", "notice", "unlicense")
INDEX_FILES = ("", "index", "readme")

#: Whole licence texts, as their authors published them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_1_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


#: Identifiers, and the notices that licence texts ask for, in short and in full.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        _APACHE_HEADER,
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": [f"{_BSD_1_2}\n{_BSD_END}", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        f"{_BSD_1_2}\n{_BSD_3}\n{_BSD_END}",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        _GPL_HEADER,
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [_ISC, "SPDX-License-Identifier: ISC"],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        _MIT,
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", _MPL_HEADER, "SPDX-License-Identifier: MPL-2.0"],
}


@dataclass(frozen=True)
class Rule:
    """Deciding terms: of each group of ``needs`` one, of ``bars`` none; of ``versions`` one, unless none of ``others`` is there."""

    needs: tuple[tuple[str, ...], ...] = ()
    bars: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    others: tuple[str, ...] = ()

    def fits(self, terms: set[str]) -> bool:
        versions = bool(terms & set(self.versions)) or not terms & set(self.others)
        return all(terms & set(g) for g in self.needs) and not terms & set(self.bars) and versions

    def column(self, marks: Column) -> Column:
        """The same for an array of the deciding terms that a unit has."""

        def has(words: tuple[str, ...]) -> Column:
            return F.arrays_overlap(marks, F.array(*map(F.lit, words))) if words else F.lit(False)

        return reduce(lambda a, b: a & b, map(has, self.needs), ~has(self.bars) & (has(self.versions) | ~has(self.others)))


# Words of the licences' names, by which those of one family differ.
_SHARE, _NO_TRADE, _NO_CHANGE = ("sharealike", "sa"), ("noncommercial", "nc"), ("noderivatives", "noderivs", "nd")
_AFFERO, _LESSER = ("affero", "agpl"), ("lesser", "library", "lgpl")
_OLD = ("1.0", "2.0", "2.5")
RULES = {
    "Apache-2.0": Rule(needs=(("apache",),), versions=("2.0", "2"), others=("1.0", "1.1")),
    "CC-BY-4.0": Rule(bars=(*_SHARE, *_NO_TRADE, *_NO_CHANGE), versions=("4.0", "4"), others=("3.0", *_OLD)),
    "CC-BY-NC-4.0": Rule(needs=(_NO_TRADE,), bars=(*_SHARE, *_NO_CHANGE), versions=("4.0", "4"), others=("3.0", *_OLD)),
    "GPL-3.0": Rule(bars=(*_AFFERO, *_LESSER), versions=("3", "3.0"), others=("2", "2.0", "1")),
    "ISC": Rule(needs=(("provided", "isc"),)),
    "MPL-2.0": Rule(needs=(("mozilla", "mpl"),), versions=("2.0", "2"), others=("1.0", "1.1")),
}
#: Every deciding term.
DECIDING = sorted({t for r in RULES.values() for g in (*r.needs, r.bars, r.versions, r.others) for t in g})

#: English function words, which are no terms.
FUNCTION_WORDS = ("a an and any are as at be by can for form found in is it may not of on or that the this to use with you").split()

#: Between paragraphs: a blank line or more.
PARAGRAPH = r"\n[ \t\r]*\n\s*"
#: A word or a version number.
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


class Vectors:
    """Unit TF-IDF vectors of the templates, by notice; inverse frequencies are over notices."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES) -> None:
        counted = [(name, Counter(t for t in re.findall(_TERM, notice.lower()) if t not in FUNCTION_WORDS)) for name, notices in sorted(templates.items()) for notice in notices]
        frequency = Counter(t for _, terms in counted for t in terms)
        self.idf = {t: math.log((1 + len(counted)) / (1 + n)) + 1 for t, n in frequency.items()}
        self.unseen = math.log(1 + len(counted)) + 1
        self.notices: list[tuple[str, dict[str, float]]] = []
        for name, terms in counted:
            raw = {t: n * self.idf[t] for t, n in terms.items()}
            length = math.sqrt(sum(x * x for x in raw.values()))
            self.notices.append((name, {t: x / length for t, x in sorted(raw.items())}))

    def least(self, cosine: float) -> list[int]:
        """How many terms of each notice a text needs at least to reach the cosine with it."""
        out = []
        for _, vector in self.notices:
            sums = itertools.accumulate(sorted((x * x for x in vector.values()), reverse=True))
            out.append(1 + sum(x < cosine * cosine - 1e-9 for x in sums))
        return out

    def keys(self, cosine: float, which: list[int]) -> list[str]:
        """Terms of which a text needs one to reach the cosine with any of the notices ``which``."""
        out: set[str] = set()
        for i in which:
            vector = self.notices[i][1]
            rest = sum(x * x for t, x in vector.items() if t not in out)
            for t, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
                if math.sqrt(max(rest, 0.0)) < cosine:
                    break
                if t not in out:
                    out.add(t)
                    rest -= x * x
        return sorted(out)


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """An inline table of strings and doubles."""
    literals = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" for x in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {literals} AS t({columns})"))


def _terms(x: Column) -> Column:
    return F.filter(F.regexp_extract_all(x, F.lit(f"({_TERM})"), 1), lambda t: ~t.isin(*FUNCTION_WORDS))


def match(units: DataFrame, vectors: Vectors, cosine: float) -> DataFrame:
    """The best notice of each distinct ``unit`` (a lower-case text) that reaches the cosine: struct of -cosine and name."""
    spark = units.sparkSession
    counts = units.distinct().select("unit", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n"))
    weighted = counts.join(_values(spark, "term, idf", sorted(vectors.idf.items())), "term", "left").select("unit", "term", (F.col("n") * F.coalesce("idf", F.lit(vectors.unseen))).alias("w"))
    weighted = store.written(weighted, "weights")
    lengths = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    notices = _values(spark, "notice, name, term, x", [(str(i), name, t, x) for i, (name, v) in enumerate(vectors.notices) for t, x in v.items()])
    dots = weighted.join(notices, "term").groupBy("unit", "notice", "name").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    marks = weighted.where(F.col("term").isin(*DECIDING)).groupBy("unit").agg(F.collect_set("term").alias("marks"))
    found = dots.join(lengths, "unit").select("unit", F.round(F.col("dot") / F.col("length"), 9).alias("cosine"), "name").where(F.col("cosine") >= cosine)
    found = found.join(marks, "unit", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))
    fits = F.coalesce(*(F.when(F.col("name") == name, rule.column(F.col("marks"))) for name, rule in RULES.items()), F.lit(True))
    found = found.where(fits)
    return found.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("negative"), "name")).alias("best"))


def page_files(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages as files: id, path (host and address path) and text (block tags end lines, entities are blanks)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "\n")
    lines = F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|article|nav|footer|header|title|td|tr|table|section|body|head|html)\b[^>]*>", "\n"), r"(?s)<[^>]*>|&[#A-Za-z0-9]+;", " ")
    path = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    return pages.select(F.col(id_col).alias("id"), F.nullif(F.lower(path), F.lit("")).alias("path"), lines.alias("text"))


def own(files: DataFrame, *, cosine: float = COSINE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """id, path, and the licence that each file declares itself, with its cosine."""
    vectors = Vectors(templates)
    least = vectors.least(cosine)
    short, long = ([i for i, (_, v) in enumerate(vectors.notices) if (len(v) >= LONG) == x] for x in (False, True))
    keyed = "(?<![a-z0-9])(" + "|".join(map(re.escape, vectors.keys(cosine, short))) + ")(?![a-z0-9])"
    fewest = min((least[i] for i in long), default=0)
    of_long = F.array(*map(F.lit, sorted({t for i in long for t in vectors.notices[i][1]}))).cast("array<string>")
    # the same inequality for the terms that a unit shares with each notice, first without the unit's other terms, then with
    shares = [F.array(*(F.struct(F.lit(t).alias("t"), F.lit(x * x).alias("x"), F.lit(vectors.idf[t] ** 2).alias("w")) for t, x in v.items())) for _, v in vectors.notices]
    known = F.array(*map(F.lit, sorted(vectors.idf)))
    wanted = cosine * cosine - 1e-9

    def shared(u: Column, which: list[int]) -> Column:
        return F.exists(F.array(*(shares[i] for i in which)), lambda n: F.aggregate(n, F.lit(0.0), lambda a, p: a + F.when(F.array_contains(u["common"], p["t"]), p["x"]).otherwise(0.0)) >= wanted) if which else F.lit(False)

    def able(u: Column) -> Column:
        return shared(u, short) | ((F.size(u["common"]) >= fewest) & shared(u, long))

    def near(u: Column) -> Column:
        def add(a: Column, p: Column) -> Column:
            times = F.size(u["inner"]) - F.size(F.array_remove(u["inner"], p["t"]))
            return F.struct((a["x"] + F.when(times > 0, p["x"]).otherwise(0.0)).alias("x"), (a["s"] + times * times * p["w"]).alias("s"))

        others = u["others"] * vectors.unseen**2
        start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("s"))
        return F.exists(F.array(*shares), lambda n: F.aggregate(n, start, add, lambda a: a["x"] * a["s"] >= wanted * (a["s"] + others)))

    # no unit has what the whole text lacks
    view = files.select("id", "path", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    parts = F.array_distinct(F.concat(F.split("low", "\n", -1), F.split("low", PARAGRAPH, -1)))
    # as many terms of long notices as any of them takes
    lengthy = F.lit(bool(long)) & (F.size(F.array_intersect(_terms(F.col("low")), of_long)) >= fewest)
    some = F.when(lengthy, parts).when(F.col("low").rlike(keyed), F.filter(parts, lambda x: x.rlike(keyed)))
    some = F.array_union(some, F.array("low"))
    units = F.transform(some, lambda x: F.struct(x.alias("unit"), _terms(x).alias("terms")))
    units = F.filter(F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), u["terms"].alias("terms"), F.array_intersect(u["terms"], known).alias("common"))), able)
    # how often a unit has its terms of notices, and how many other terms
    inner = F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), F.filter(u["terms"], lambda t: F.array_contains(u["common"], t)).alias("inner"), (F.size(F.array_distinct(u["terms"])) - F.size(u["common"])).alias("others")))
    left = F.transform(F.filter(inner, near), lambda u: u["unit"])
    held = store.written(view.select(F.monotonically_increasing_id().alias("row"), "id", "path", left.alias("units")), "files")
    each = held.select("row", F.explode("units").alias("unit"))
    best = each.join(match(each.select("unit"), vectors, cosine), "unit").groupBy("row").agg(F.min("best").alias("best"))
    return held.join(best, "row", "left").select("id", "path", F.col("best.name").alias("license"), F.round(-F.col("best.negative"), 6).alias("cosine"))


def _parents(path: Column) -> Column:
    """The directories above a path, nearest last, each with its depth."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("directory")))


def _directories(declared: DataFrame) -> DataFrame:
    """directory and its licence: of the licence files in it, else of its index file; the first path wins."""
    path = F.regexp_replace("path", "/+$", "")
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[a-z0-9]+$", "")
    index = F.col("path").endswith("/") | name.isin(*(x for x in INDEX_FILES if x)) | ~path.contains("/")
    kind = F.when(name.isin(*LICENSE_FILES), 0).when(index, 1)
    place = F.when(F.col("path").endswith("/") | ~path.contains("/"), path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    named = declared.where("license is not null and path is not null").select(place.alias("directory"), F.struct(kind.alias("kind"), F.col("path").alias("path"), F.col("license").alias("license")).alias("entry")).where("entry.kind is not null")
    return named.groupBy("directory").agg(F.min("entry").alias("entry")).select("directory", F.col("entry.license").alias("of_directory"))


def scan(files: DataFrame, **options) -> DataFrame:
    """Per file: id, path, license, cosine, how it is known (own, inherited, none) and from which directory."""
    declared = store.written(own(files, **options), "declared")
    directories = _directories(declared)
    paths = declared.where("license is null and path is not null").select("path").distinct()
    above = paths.select("path", F.explode(_parents(F.col("path"))).alias("a")).select("path", "a.*")
    nearest = above.join(directories, "directory").groupBy("path").agg(F.max(F.struct("depth", "directory", "of_directory")).alias("near"))
    joined = declared.join(nearest, "path", "left")
    return joined.select(
        "id",
        "path",
        F.coalesce("license", "near.of_directory").alias("license"),
        "cosine",
        F.when(F.col("license").isNotNull(), "own").when(F.col("near.of_directory").isNotNull(), "inherited").otherwise("none").alias("known"),
        F.when(F.col("license").isNull(), F.col("near.directory")).alias("directory"),
    )
