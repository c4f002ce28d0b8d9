"""Language identification by fusing evidence in Bayes' manner.

For each document and language l, the log-posterior is the sum of
  - the text's log-likelihood: hashed byte trigrams under a smoothed model of each language, tempered
    because neighbouring trigrams depend on each other, and held within ``TEXT_LIMIT`` of the best;
  - the log-probability of the declared (markup) language given l, and of the address suffix given l;
  - the log-prior of the host: its counts of languages, smoothed by those of its domain, these by those of
    all documents. A host that is its own domain leans on all documents at once.
The last three are counts over all documents, of what the text alone says, by grouped aggregation; a document's own vote is
taken out of every count that it is judged by. Beside the declared languages there is ``OTHER``, under which every trigram is as likely as any other: a text in
none of these languages, or in no language, is more likely under it.

Counts of hosts, domains, declared languages and suffixes are joined by value, broadcast where they take ``SMALL`` bytes at most. Only the text model is fitted
on a sample: at most about ``FIT_ROWS`` rows labelled by their declared language, of each language the same number, drawn by hash (of a rarer one all), so that
no declared language is lost as the table grows. Models of more than ``LANGUAGES`` languages go in blocks of that many, each a pass over the texts, whose likelihoods are
joined by row; the result is the same.

Evidence that is null is left out. A document is accepted if its best language has at least ``CONFIDENCE``
of the posterior and is not ``OTHER``, or, where a set of languages is asked for, is one of them.

Defined results: null and empty texts rest on the other evidence; without any declared language at all
every language is null and every document is accepted; of equal posteriors the first language by name wins (``OTHER`` last), and of
equal likelihoods the text says none; very long texts are read whole, each in a slice of its own; repeated rows are each
reported; ids are of any type; other columns, whatever their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: Rows that the text model is fitted on, at most, in expectation.
FIT_ROWS = 20_000
#: Languages of one block of models, and the name of what is in none of the declared ones.
LANGUAGES, OTHER = 200, "und"
#: Bytes up to which a table of counts is broadcast.
SMALL = 32 << 20
#: Weight of a trigram's log-likelihood, and the most that the text may say for one language over another.
TEMPER, TEXT_LIMIT = 0.2, 30.0
#: Pseudo-counts with which a host leans on its domain, a domain on all documents, and of channels.
LEAN, CHANNEL = 10.0, 1.0
#: Least share of the posterior with which a language is accepted.
CONFIDENCE = 0.5

BUCKETS = 1 << 16


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that begins at each byte but the slice's last two, and where texts begin."""
    raw, offsets = text.utf8(column)
    low = text.LOWER[raw].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), offsets
    whole = low[:-2] | low[1:-1] << 8 | low[2:] << 16
    return ((whole * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), offsets


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Of each trigram, whether it lies within one text."""
    out = np.ones(n, bool)
    for back in (1, 2):
        edge = offsets[1:-1] - back
        out[edge[(edge >= 0) & (edge < n)]] = False
    return out


class TextModel:
    """Log-probabilities of trigram buckets, one column per language; ``OTHER`` has the same for all."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        if OTHER in languages:
            self.table[:, languages.index(OTHER)] = -np.log(BUCKETS)

    def raw(self, column: pa.Array) -> np.ndarray:
        """Per text and language, the tempered log-likelihood."""
        buckets, offsets = _trigrams(column)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(buckets):
            return out
        inside = _inside(offsets, len(buckets))
        for k in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(np.where(inside, self.table[buckets, k], 0.0), dtype=np.float64)])
            at = np.minimum(offsets, len(buckets))
            out[:, k] = np.diff(sums[at])
        return out * TEMPER

    def likelihood(self, column: pa.Array) -> np.ndarray:
        """The same relative to the best language."""
        return relative(self.raw(column))


def relative(raw: np.ndarray) -> np.ndarray:
    """Log-likelihoods relative to the best one, none less than ``-TEXT_LIMIT``."""
    return np.maximum(raw - raw.max(axis=1, keepdims=True), -TEXT_LIMIT)


def said(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language that each text is most likely in, and whether that is one only."""
    return fits.argmax(axis=1), (fits == 0).sum(axis=1) == 1


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, lower-case; blank is null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,8})", 1), F.lit(""))


def evidence(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: str | Column | None = "lang", host: str | Column | None = "source", suffix: str | Column | None = None
) -> DataFrame:
    """id, text, declared language, address suffix, host and domain (the last two labels of the host)."""

    def of(x: str | Column | None) -> Column:
        return F.lit(None).cast("string") if x is None else F.col(x).cast("string") if isinstance(x, str) else x.cast("string")

    return docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        primary(of(declared)).alias("declared"),
        F.nullif(F.lower(of(suffix)), F.lit("")).alias("suffix"),
        F.nullif(F.lower(of(host)), F.lit("")).alias("host"),
    ).withColumn("domain", F.substring_index("host", ".", -2))


def page_evidence(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Evidence of web pages: the text between tags, the html element's lang, the host's last label."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    view = pages.select(F.col(id_col).alias("id"), plain.alias("text"), F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z0-9-]+)", 1).alias("lang"), host.alias("host"))
    return evidence(view, id_col="id", declared="lang", host="host", suffix=F.regexp_extract("host", r"\.([a-z]+)$", 1))


def languages_of(facts: DataFrame) -> dict[str, int]:
    """Declared languages by name, and their rows."""
    counts = facts.where(F.col("declared") != OTHER).groupBy("declared").agg(F.count("*").alias("n"))
    return {r.declared: r.n for r in counts.orderBy("declared").collect()}


def fit_text(facts: DataFrame, fit_rows: int = FIT_ROWS, block: int = LANGUAGES) -> list[TextModel]:
    """The text models of at most about ``fit_rows`` declared rows, dealt evenly to the languages, in blocks; ``OTHER`` ends the last one."""
    store.bounded_batches(facts.sparkSession)
    sizes = languages_of(facts)
    names = list(sizes)
    blocks = [names[i : i + block] for i in range(0, len(names), block)]
    return [_fit_block(facts, {x: sizes[x] for x in own}, fit_rows / len(names), own == blocks[-1]) for own in blocks]


def _fit_block(facts: DataFrame, sizes: dict[str, int], each: float, last: bool) -> TextModel:
    shares = {x: int(min(each / n, 1.0) * (1 << 30)) for x, n in sizes.items()}
    known = F.map_from_arrays(F.lit(list(shares)).cast("array<string>"), F.lit(list(shares.values())).cast("array<long>"))
    share = F.try_element_at(known, F.col("declared"))
    labelled = facts.where(F.col("declared").isNotNull()).where(F.pmod(F.xxhash64(F.col("id").cast("string"), "declared"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in text.slices(batches):
            buckets, offsets = _trigrams(part.column(1))
            inside = _inside(offsets, len(buckets))
            names = part.column(0).to_pylist()
            owner = np.repeat(np.arange(len(names)), np.diff(offsets))[: len(buckets)]
            numbers = {x: i for i, x in enumerate(sorted(set(names)))}
            label = np.array([numbers[x] for x in names])[owner] if len(buckets) else owner
            for name, i in numbers.items():
                own = np.bincount(buckets[inside & (label == i)], minlength=BUCKETS)
                sums[name] = sums.get(name, 0) + own
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["declared", "bucket", "n"])

    summed = labelled.select("declared", "text").mapInArrow(count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    # bounded by the sample: as many rows as the block has languages times buckets
    got = summed.toArrow()
    names = [*sizes, OTHER] if last else list(sizes)
    number = {x: i for i, x in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    if got.num_rows:
        counts[got.column("bucket").to_numpy(), [number[x] for x in got.column("declared").to_pylist()]] = got.column("n").to_numpy()
    return TextModel(names, counts)


class _Fits:
    """Where the likelihoods of a row come from: the text itself, or a column of them that passes over the texts have made."""

    def __init__(self, model: TextModel | None) -> None:
        self.model = model

    def of(self, column: pa.Array) -> np.ndarray:
        if self.model is not None:
            return self.model.likelihood(column)
        return relative(np.array(column.to_pylist(), np.float64))


def _with_fits(rows: DataFrame, text_name: str, models: list[TextModel], name: str) -> tuple[DataFrame, _Fits]:
    """``rows`` with what ``_Fits`` reads, in the column ``name``: the text, or the likelihoods of several blocks of languages."""
    if len(models) == 1:
        return rows.withColumn(name, F.col(text_name)), _Fits(models[0])
    spark = rows.sparkSession
    (row,) = store.fresh(rows, "row")
    numbered = store.written(rows.withColumn(row, F.monotonically_increasing_id()), "language-rows")
    texts, parts = numbered.select(row, F.col(text_name).alias("text")), []
    for i, model in enumerate(models):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, own: str = f"fits_{i}") -> Iterator[pa.RecordBatch]:
            for part in text.slices(batches):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(shared.value.raw(part.column(1))), pa.list_(pa.float64()))], [row, own])

        parts.append(store.written(texts.mapInArrow(run, f"`{row}` long, fits_{i} array<double>"), "likelihoods"))
        shared.destroy()
    fits = reduce(lambda a, b: a.join(b, row), parts).select(row, F.concat(*(f"fits_{i}" for i in range(len(models)))).alias(name))
    return numbered.join(fits, row).drop(row), _Fits(None)


_KEYS = ("host", "domain", "suffix", "declared")


def _spoken(facts: DataFrame, fits: _Fits) -> DataFrame:
    """How many documents of each host, domain, suffix and declared language read as each language by text alone."""
    shared = facts.sparkSession.sparkContext.broadcast(fits)
    names = [*_KEYS, "said"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 4):
            best, sure = said(shared.value.of(part.column(4)))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(best, pa.int32(), mask=~sure)], names)

    seen = facts.select(*_KEYS, "fits").mapInArrow(run, "host string, domain string, suffix string, declared string, said int")
    return seen.where("said is not null").groupBy(*names).agg(F.count("*").alias("n"))


def _sliced(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches whose texts in column ``at`` are bounded; a column of likelihoods is bounded by its rows."""
    for batch in batches:
        if pa.types.is_string(batch.column(at).type) or pa.types.is_large_string(batch.column(at).type):
            yield from text.slices(iter([batch]), at)
        elif batch.num_rows:
            yield batch


def _by_language(counts: DataFrame, key: str, n: int) -> DataFrame:
    """Counts of each language as an array, for each value of a key that is not null."""
    sums = [F.sum(F.when(F.col("said") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n)]
    return counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias("counts"))


class Counts:
    """Counts of languages: by value as tables, of all documents, and what each kind of evidence sums to."""

    def __init__(self, counts: DataFrame, n: int) -> None:
        totals = counts.withColumn("one", F.lit("all"))
        whole = _by_language(totals, "one", n).collect()
        self.every = np.array(whole[0]["counts"]) if whole else np.zeros(n)
        self.tables = {k: store.written(_by_language(counts, k, n), f"counts-{k}") for k in _KEYS}
        self.sums, self.values, self.small = {}, {}, {}
        for k, table in self.tables.items():
            row = table.agg(F.count("*").alias("values"), F.sum(F.octet_length(k)).alias("bytes"), *(F.sum(F.get("counts", F.lit(i))).alias(f"s{i}") for i in range(n))).first()
            self.sums[k] = np.array([row[f"s{i}"] or 0.0 for i in range(n)])
            self.values[k] = row["values"]
            self.small[k] = (row["bytes"] or 0) + row["values"] * (8 * n + 64) <= SMALL

    def joined(self, rows: DataFrame, names: dict[str, str]) -> DataFrame:
        """``rows`` with the counts of their values, in columns ``names[key]`` for key columns of the same name and ``_key``."""
        for k, table in self.tables.items():
            own = table.select(F.col(k).alias(names[f"{k}_key"]), F.col("counts").alias(names[k]))
            rows = rows.join(F.broadcast(own) if self.small[k] else own, names[f"{k}_key"], "left")
        return rows


class Judge:
    """Posteriors of rows from likelihoods and the counts of their values, each without the row's own vote."""

    def __init__(self, languages: list[str], fits: _Fits, counts: Counts, accept: frozenset[str] | None, wanted: float) -> None:
        self.languages, self.fits, self.accept, self.wanted = languages, fits, accept, wanted
        self.every, self.sums, self.values = counts.every, {k: counts.sums[k] for k in ("declared", "suffix")}, {k: counts.values[k] for k in ("declared", "suffix")}

    def _table(self, column: pa.Array, own: np.ndarray) -> np.ndarray:
        """Counts of the values of a column, without the own vote (a value without counts has none)."""
        none = np.zeros(own.shape[1])
        return np.maximum(np.array([none if x is None else x for x in column.to_pylist()]).reshape(own.shape) - own, 0.0)

    def _prior(self, own: np.ndarray, host: pa.Array, host_key: pa.Array, domain: pa.Array, domain_key: pa.Array) -> np.ndarray:
        prior = np.maximum(self.every - own, 0.0) + 1
        prior /= prior.sum(axis=1, keepdims=True)
        for key, table in ((domain_key, domain), (host_key, host)):
            known = np.array([x is not None for x in key.to_pylist()], bool)
            counts = self._table(table, own)
            lean = (counts + LEAN * prior) / (counts.sum(axis=1, keepdims=True) + LEAN)
            prior = np.where(known[:, None], lean, prior)
        return np.log(prior)

    def _channel(self, name: str, own: np.ndarray, key: pa.Array, table: pa.Array) -> np.ndarray:
        """log P(value | language): values seen and one more for any other."""
        known = np.array([x is not None for x in key.to_pylist()], bool)
        total = self.sums[name] - np.where(known[:, None], own, 0.0) + CHANNEL * (self.values[name] + 1)
        return np.where(known[:, None], np.log((self._table(table, own) + CHANNEL) / total), 0.0)

    def rows(self, at: dict[str, pa.Array]) -> tuple[list, np.ndarray, list, np.ndarray]:
        """Language, its share, what the text alone says, accepted."""
        fits = self.fits.of(at["fits"])
        best, sure = said(fits)
        own = np.zeros(fits.shape)
        own[np.flatnonzero(sure), best[sure]] = 1.0
        sums = fits + self._prior(own, at["host"], at["host_key"], at["domain"], at["domain_key"])
        for name in ("declared", "suffix"):
            sums += self._channel(name, own, at[f"{name}_key"], at[name])
        weight = np.exp(sums - sums.max(axis=1, keepdims=True))
        share = weight.max(axis=1) / weight.sum(axis=1)
        names = [self.languages[i] for i in sums.argmax(axis=1)]
        text_says = [self.languages[i] if s else None for i, s in zip(best, sure, strict=True)]
        good = np.array([x != OTHER if self.accept is None else x in self.accept for x in names], bool)
        return names, share, text_says, (share >= self.wanted) & good


SCHEMA = "language string, confidence double, text_language string, declared string, accepted boolean"
_VIEW = [*_KEYS, *(f"{k}_key" for k in _KEYS), "fits"]


def _prepared(facts: DataFrame, fit_rows: int, accept: Iterable[str] | None, confidence: float, block: int) -> tuple[list[TextModel], Judge | None, Counts | None]:
    models = fit_text(facts, fit_rows, block)
    languages = [x for m in models for x in m.languages]
    if not languages:
        return models, None, None
    view, fits = _with_fits(facts, "text", models, "fits")
    counts = Counts(store.written(_spoken(view, fits), "spoken"), len(languages))
    return models, Judge(languages, fits, counts, None if accept is None else frozenset(accept), confidence), counts


def _keyed(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """The key columns of evidence; a host that is its own domain counts once, as the domain."""
    own = {k: F.col(k) for k in _KEYS} | {"host": F.when(F.col("host") != F.col("domain"), F.col("host"))}
    return facts.select("*", *(own[k].alias(names[f"{k}_key"]) for k in _KEYS))


def identify(facts: DataFrame, *, accept: Iterable[str] | None = None, fit_rows: int = FIT_ROWS, confidence: float = CONFIDENCE, block: int = LANGUAGES) -> DataFrame:
    """Per row of ``evidence``: id, language, its share of the posterior, what the text alone says, accepted."""
    spark = facts.sparkSession
    models, judge, counts = _prepared(facts, fit_rows, accept, confidence, block)
    if judge is None:
        none = F.lit(None).cast("string")
        return facts.select("id", none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), "declared", F.lit(True).alias("accepted"))
    names = {k: f"of_{k}" for k in _KEYS} | {f"{k}_key": f"key_{k}" for k in _KEYS}
    view, _ = _with_fits(_keyed(facts, names).drop("host", "domain", "suffix"), "text", models, "fits")
    joined = counts.joined(view.drop("text"), names).select("id", "declared", *(names[k] for k in _VIEW[:-1]), "fits")
    shared = spark.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, part_fits := 2 + len(_VIEW) - 1):
            best, share, text_says, good = shared.value.rows(dict(zip(_VIEW, part.columns[2 : part_fits + 1], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(share), pa.array(text_says, pa.string()), part.column(1), pa.array(good)], ["id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return joined.mapInArrow(run, f"id {joined.schema[0].dataType.simpleString()}, {SCHEMA}")


def keep_accepted(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", declared: str | None = "lang", host: str | None = "source", accept: Iterable[str] | None = None, fit_rows: int = FIT_ROWS, confidence: float = CONFIDENCE, block: int = LANGUAGES
) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, columns as they are; with small tables of counts texts are not shuffled for it."""
    spark = docs.sparkSession
    facts = evidence(docs, id_col=id_col, text_col=text_col, declared=declared, host=host)
    models, judge, counts = _prepared(facts, fit_rows, accept, confidence, block)
    if judge is None:
        return docs
    names = dict(zip(_VIEW, store.fresh(docs, *_VIEW), strict=True))
    lower = F.lit(None).cast("string") if host is None else F.nullif(F.lower(F.col(host)), F.lit(""))
    domain = F.substring_index(lower, ".", -2)
    own = {"declared": F.lit(None).cast("string") if declared is None else primary(F.col(declared)), "suffix": F.lit(None).cast("string"), "host": F.when(lower != domain, lower), "domain": domain}
    view, _ = _with_fits(docs.select("*", *(own[k].alias(names[f"{k}_key"]) for k in _KEYS)), text_col, models, names["fits"])
    inline = len(models) == 1
    rest = [names[k] for k in _VIEW[:-1]] if inline else [names[k] for k in _VIEW]
    joined = counts.joined(view, names).select(*docs.columns, *rest)
    shared = spark.sparkContext.broadcast(judge)
    width, at = len(docs.columns), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, at):
            columns = [*part.columns[width:], part.column(at)] if inline else part.columns[width:]
            good = shared.value.rows(dict(zip(_VIEW, columns, strict=True)))[3]
            yield pa.RecordBatch.from_arrays(part.columns[:width], part.schema.names[:width]).filter(pa.array(good))

    return joined.mapInArrow(run, docs.schema)
