"""Quality classifier: naive Bayes support vectors over n-gram indicators.

The features of a text are the set of its words and word bigrams (hashed), of its byte bigrams and trigrams
(hashed), and of its word bigrams, trigrams and 5-grams reduced to whether all their words are equal. Each indicator is scaled by the log-ratio of its smoothed
counts in the two classes; texts are brought to length 1; a linear model of squared hinge loss is fitted
by dual coordinate descent, with the classes weighted evenly; margins become scores between 0 and 1 by
a logistic curve fitted on a part of the rows kept back from the ratios and the descent.

Only the fit is bounded: it uses at most about ``FIT_ROWS`` labelled rows, drawn by a hash of the id. All
rows are scored, over whole texts, without a shuffle.

Defined results: null and empty texts have no feature and get the score of the intercept; labels that are
null, or other than 0 and 1, are ignored; a row labelled twice counts twice; with one class or no label
at all the score is that class's share (0.5 without any); repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: Rows that the fit uses, at most, in expectation; the bound is kept within a few standard deviations.
FIT_ROWS = 8_000
#: A score from here on predicts label 1.
THRESHOLD = 0.3

_PAIRS, _TRIPLES, _GRAMS = 1 << 16, 1 << 17, 1 << 17
#: Lengths of word n-grams of which only "all words are equal" and "not all" are features.
_RUNS = (2, 3, 5)
#: Number of features: byte pairs, hashed byte triples, hashed words and word bigrams, and the runs.
SIZE = _PAIRS + _TRIPLES + 2 * _GRAMS + 2 * len(_RUNS)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text."""
    raw, offsets = text.utf8(column)
    words = text.Words(column)
    wide = raw.astype(np.uint32)
    pairs = (wide[:-1] << 8) | wide[1:]
    triples = _PAIRS + ((((pairs[:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(15))
    single = _PAIRS + _TRIPLES + (words.hashes >> np.uint64(47)).astype(np.int64)
    double = _PAIRS + _TRIPLES + _GRAMS + (text.combine(words.hashes, 2) >> np.uint64(47)).astype(np.int64)
    seen = np.zeros(SIZE, bool)
    for d in range(len(offsets) - 1):
        a, b = offsets[d], offsets[d + 1]
        if b - a > 1:
            seen[pairs[a : b - 1]] = True
        if b - a > 2:
            seen[triples[a : b - 2]] = True
        first, last = words.first[d], words.first[d + 1]
        seen[single[first:last]] = True
        seen[double[first : max(last - 1, first)]] = True
        steps = np.diff(words.hashes[words.first[d] : words.first[d + 1]]) == 0
        for k, n in enumerate(_RUNS):
            if len(steps) >= n - 1:
                runs = np.lib.stride_tricks.sliding_window_view(steps, n - 1).all(axis=1)
                seen[SIZE - 2 * k - 1] = runs.any()
                seen[SIZE - 2 * k - 2] = not runs.all()
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found.astype(np.int32)


@dataclass
class Model:
    """weights: of the features, ratio included; bias; slope and shift of the logistic curve."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        own = self.ratio[found]
        length = float(np.sqrt((own * own).sum()))
        return float(self.weights[found].sum()) / length + self.bias if length else self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for squared hinge loss; labels are -1 and 1, the bias is a feature of value 1."""
    weights, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    diagonal = 1 / (2 * cost)
    norms = np.array([float(v @ v) + 1 for v in values]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            y = labels[i]
            gradient = y * (float(weights[rows[i]] @ values[i]) + bias) - 1 + diagonal[i] * alpha[i]
            step = max(alpha[i] - gradient / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights[rows[i]] += step * y * values[i]
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic(margins: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, by Newton steps with a small ridge."""
    x = np.stack([margins, np.ones_like(margins)])
    n1, n0 = target.sum(), len(target) - target.sum()
    goal = np.where(target > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        gradient = x @ (p - goal) + 1e-3 * beta
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """The model of rows of feature numbers with labels 0 and 1."""
    y = np.array(labels, np.int64)
    if len(y) < 8 or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.5)
    back = np.arange(len(y)) % 4 == 0
    if y[~back].min() == y[~back].max():
        back[:] = False
    counts = np.ones((2, SIZE))
    for row, label, kept in zip(rows, labels, back, strict=True):
        if not kept:
            counts[label, row] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum())).astype(np.float32)

    def unit(row: np.ndarray) -> np.ndarray:
        own = ratio[row].astype(np.float64)
        length = np.sqrt(own @ own)
        return own / length if length else own

    use = np.flatnonzero(~back)
    share = np.array([(y[use] == k).mean() for k in (0, 1)])
    weights, bias = descend([rows[i] for i in use], [unit(rows[i]) for i in use], np.where(y[use] == 1, 1.0, -1.0), 4.0 * 0.5 / share[y[use]])
    model = Model(ratio, (weights * ratio).astype(np.float32), bias, 1.0, 0.0)
    tested = np.flatnonzero(back) if back.any() else use
    margins = np.array([model.margin(rows[i]) for i in tested])
    if y[tested].min() < y[tested].max():
        model.slope, model.shift = logistic(margins, y[tested])
    return model


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves 0 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """A model of labelled rows that are not held out; of more than ``fit_rows`` such labels a share drawn by hash."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & ~held_out("__id"))
    total = usable.count()
    if not total:
        return _constant(0.5)
    if total > fit_rows:
        limit = int(fit_rows / total * (1 << 30))
        usable = usable.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) < limit)
    # at most about fit_rows rows: a proven bound for the broadcast and for what the driver gathers
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(usable), "__id").select("__label", "__text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in features(part.column(1))], pa.binary())], ["label", "found"])

    rows, y = [], []
    gathered = sample.mapInArrow(extract, "label int, found binary")
    for batch in gathered.toArrow().sort_by([("label", "ascending"), ("found", "ascending")]).to_batches():
        y += batch.column(0).to_pylist()
        rows += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(1)]
    order = np.random.default_rng(11).permutation(len(y))
    return fit([rows[i] for i in order], [y[i] for i in order])


SCHEMA = "held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: its id, whether it is held out, the score of its whole text and the predicted label."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"), held_out(id_col).alias("held_out"))
    field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in text.slices(batches):
            margins = np.array([own.margin(x) for x in features(part.column(1))])
            scores = own.score(margins)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [field.name, "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"`{field.name}` {field.dataType.simpleString()}, {SCHEMA}")
