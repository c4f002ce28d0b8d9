"""Substring deduplication by compact windows.

A text is its sequence of shingles of five words. For each of ``HASHES`` hash functions, the Cartesian tree over
the shingles' hashes gives compact windows (l, c, r): every subsequence within [l, r] that holds c has its
least hash at c. Only windows in which a passage of ``WORDS`` words fits are kept, about 2n/t of them; they are
found without building the tree, as the positions that are the least of some t in a row, and reach to the next
smaller hash on either side (``REACH`` at most; longer passages are unions of shorter ones).

Windows that share a signature (function and least hash) in two or more documents are grouped; each is paired
with the window of the group's least document first. Where the intervals of a document's
windows from at least ``AGREE`` functions overlap, the documents they are paired with are candidates, and the
shingles around are compared: a window of ``WORDS`` words counts if at least as many of its shingles as a
Jaccard similarity of ``SIMILARITY`` asks for are in the aligned window of the earlier document (aligned up
to ``SLACK`` words inserted or deleted). Overlapping windows merge to passages.

The least document may share the shingle, but not the passage. Every window of ``WORDS`` words around a centre that
is not inside a passage by then is therefore grouped once more, over all members of its signature's group: by the
hash of its words, so that the least document of the group has the passage itself (no exact repeat is lost), and by
least hashes of either half of its surroundings, for near copies. These groups are pre-aggregated to their least
document and joined back: cost and rows grow with the windows, not with their pairs.

Defined results: null ids, null texts and texts of fewer than ``WORDS`` words have no passage; rows of one id are
one document, which is not compared with itself; of a repeated row one is reported; an empty table gives an
empty result. Of equal hashes in a text the leftmost is the least, of documents the one of the lowest id comes first.
Very long texts are taken apart whole, each in a slice of its own. Ids are integers, or strings of digits; other
columns are kept and may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import minhash, store, text

SHINGLE, WORDS, SIMILARITY = 5, 50, 0.8
HASHES, AGREE = 4, 2
#: Shingles to which a window reaches on either side, and the shift within an alignment.
REACH, SLACK = 100, 3
#: Passages of one earlier document that are asked for with one copy of its text, in expectation.
ASKED = 200
#: Shingles that are handed over in one batch, beside a single text's.
SENT = 1 << 22

_POSITION = (1 << 24) - 1
_TAG = (1 << 15) - 1


def compact_windows(hashes: np.ndarray, first: np.ndarray, width: int, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c, l and r of the compact windows of at least ``width`` elements; ``first``: where each sequence begins.

    Of equal hashes the leftmost is the least.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    packed = hashes & ~np.uint64(_POSITION) | np.arange(n, dtype=np.uint64) & np.uint64(_POSITION)
    least, w = packed.copy(), 1
    while 2 * w <= width:
        least = np.minimum(least[: len(least) - w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[: n - width + 1], least[width - w : width - w + n - width + 1])
    starts = np.arange(n - width + 1)
    of = np.searchsorted(first, starts, "right")
    inside = starts + width <= first[np.minimum(of, len(first) - 1)]
    low = (least[inside] & np.uint64(_POSITION)).astype(np.int64)
    base = starts[inside] & ~_POSITION
    c = np.unique(np.where(base + low < starts[inside], base + low + _POSITION + 1, base + low))
    of = np.searchsorted(first, c, "right")
    begin, end = first[of - 1], first[of]
    # equal elements on the left are smaller, on the right greater: compare value, then position
    value = packed >> np.uint64(24)
    # least values of 1, 2, 4 ... elements in a row: a side grows by the greatest power of two that it can
    table = [value]
    while 2 << len(table) - 1 <= reach and len(table[-1]) > 1 << len(table) - 1:
        table.append(np.minimum(table[-1][: -(1 << len(table) - 1)], table[-1][1 << len(table) - 1 :]))
    left, right = c.copy(), c.copy()
    mine = value[c]
    for k in reversed(range(len(table))):
        step = 1 << k
        able = np.flatnonzero((left - step >= begin) & (c - left + step <= reach))
        able = able[table[k][left[able] - step] > mine[able]]
        left[able] -= step
        able = np.flatnonzero((right + step < end) & (right - c + step <= reach))
        able = able[table[k][right[able] + 1] >= mine[able]]
        right[able] += step
    return c, left, right


def _tag(words: text.Words, d: int) -> int:
    """15 bits of a digest of a text's words: tells texts of one id apart."""
    return minhash._digest(words, d)[0] & _TAG


def _merged(owner: np.ndarray, values: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of one text that have one signature and touch, as one: a repeated shingle makes many."""
    fresh = np.ones(len(c), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1]) | (left[1:] > right[:-1] + 1) | (c[1:] >> 13 != c[:-1] >> 13)
    at = np.flatnonzero(fresh)
    several = np.diff(np.append(at, len(c))) > 1
    return owner[at], values[at], c[at], np.minimum.reduceat(left, at), np.maximum.reduceat(right, at), several


def _signatures(docs: DataFrame, shingle: int, words: int, hashes: int) -> DataFrame:
    """id, text's tag, signature h and place (c, c - l, r - c, whether it is several merged, and function, packed) of every compact window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = words - shingle + 1
        for part in text.slices(batches):
            found = text.Words(part.column(1))
            grams, at = text.ngrams(found, shingle)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            tags = np.array([_tag(found, d) if n >= words else 0 for d, n in enumerate(found.counts().tolist())], np.int64)
            for f in range(hashes):
                values = text.mix(grams ^ np.uint64((f + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                c, left, right = compact_windows(values, at, width)
                if not len(c):
                    continue
                owner, signature, c, left, right, several = _merged(np.searchsorted(at, c, "right") - 1, text.mix(values[c]), c, left, right)
                place = (c - at[owner]) << 25 | (c - left) << 18 | (right - c) << 4 | several.astype(np.int64) << 3 | f
                columns = [pa.array(ids[owner], pa.int64()), pa.array(tags[owner], pa.int32()), pa.array(signature.view(np.int64)), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "h", "place"])

    return docs.mapInArrow(run, "id long, tag int, h long, place long")


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c, l, r and function of places."""
    c = place >> 25
    return c, c - (place >> 18 & 127), c + (place >> 4 & 16383), place & 7


def _several(place: np.ndarray) -> np.ndarray:
    return (place & 8) > 0


def _dense(left: np.ndarray, right: np.ndarray, function: np.ndarray, agree: int) -> np.ndarray:
    """Which windows meet a position that windows of at least ``agree`` functions cover."""
    size = int(right.max()) + 2
    cover = np.zeros(size, np.int64)
    for f in np.unique(function):
        own = function == f
        edge = np.bincount(left[own], minlength=size) - np.bincount(right[own] + 1, minlength=size)
        cover += np.cumsum(edge) > 0
    upto = np.concatenate([[0], np.cumsum(cover >= agree)])
    return upto[right + 1] > upto[left]


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
#: What is compared: shingles a of the document with shingles b of the earlier one, aligned by shifts.
_PAIRS = "id long, tag int, first_id long, first_tag int, a struct<start:int,end:int>, b struct<start:int,end:int>, shifts array<int>"


def _candidates(batches: Iterator[pa.RecordBatch], agree: int, width: int) -> Iterator[pa.RecordBatch]:
    """Per document with its paired windows: the earlier documents to compare with, and where."""
    names = ["id", "tag", "first_id", "first_tag", "a", "b", "shifts"]
    for batch in batches:
        ids, tags, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        offsets = listed.offsets.to_numpy()
        place, first_id, first_place, first_tag = (listed.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        c, left, right, function = _unpack(place)
        fc, first_left, first_right, _ = _unpack(first_place)
        several = _several(place) | _several(first_place)
        rows = []
        for i, own in enumerate(ids):
            at = np.arange(offsets[i], offsets[i + 1])
            at = at[_dense(left[at], right[at], function[at], agree)]
            at = at[np.lexsort((first_tag[at], first_id[at]))]
            cuts = np.flatnonzero((np.diff(first_id[at]) != 0) | (np.diff(first_tag[at]) != 0)) + 1
            for g in np.split(at, cuts):
                if len(g):
                    a = {"start": max(0, int(left[g].min()) - width), "end": int(right[g].max()) + width + 1}
                    b = {"start": max(0, int(first_left[g].min()) - width - SLACK), "end": int(first_right[g].max()) + width + SLACK + 1}
                    # windows of a repeated shingle may begin or end alike
                    m = g[several[g]]
                    shifts = np.unique(np.concatenate([c[g] - fc[g], left[m] - first_left[m], right[m] - first_right[m]]))
                    rows.append((own, tags[i], int(first_id[g[0]]), int(first_tag[g[0]]), a, b, shifts))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), _SPAN, _SPAN, pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _around(place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last start of the windows of ``width`` shingles around each centre, within its compact window.

    Windows merged from several have several centres, so all of them count.
    """
    c, left, right, _ = _unpack(place)
    last = right - width + 1
    return np.where(_several(place), left, np.maximum(left, c - width + 1)), np.where(_several(place), last, np.minimum(c, last))


class _Spans:
    """Passages of the texts of a batch, for asking which intervals are inside one of them."""

    def __init__(self, start: np.ndarray, end: np.ndarray) -> None:
        order = np.argsort(start, kind="stable")
        self.start, self.end = start[order], np.maximum.accumulate(end[order]) if len(end) else end

    def hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Positions count on over all texts; an interval's ends are in one text."""
        if not len(self.start):
            return np.zeros(len(low), bool)
        at = np.searchsorted(self.start, low, "right") - 1
        return (at >= 0) & (self.end[np.maximum(at, 0)] > high)


def _flat(listed: pa.Array, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and end of all spans in a column of lists, moved by the base of each row."""
    inner = listed.flatten()
    size = np.array(pc.fill_null(pc.list_value_length(listed), 0), np.int64)
    move = np.repeat(base, size)
    return tuple(inner.field(k).to_numpy(zero_copy_only=False) + move for k in (0, 1))


#: Beyond every position in a text.
_FAR = np.int64(1 << 40)


def _open(batches: Iterator[pa.RecordBatch], agree: int, shingle: int, width: int) -> Iterator[pa.RecordBatch]:
    """Paired windows, as for ``_candidates``, around which not all is inside passages (last column, in words)."""
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy()
        listed = batch.column(2).flatten()
        place, h = (listed.field(k).to_numpy(zero_copy_only=False) for k in (0, 4))
        _, left, right, function = _unpack(place)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        low, high = _around(place, width)
        spans = _Spans(*_flat(batch.column(3), np.arange(batch.num_rows) * _FAR))
        use = (low <= high) & ~spans.hold(low + owner * _FAR, high + owner * _FAR + width + shingle - 2)
        bounds = (offsets - offsets[0]).tolist()
        for i, (a, b) in enumerate(itertools.pairwise(bounds)):
            if use[a:b].any():
                use[a:b] &= _dense(left[a:b], right[a:b], function[a:b], agree)
        rows = pa.array(owner[use])
        yield pa.RecordBatch.from_arrays([pa.array(h[use]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[use])], ["h", "id", "tag", "place"])


def _keys(grams: np.ndarray, h: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, the windows they are of, and positions in ``grams``, of compact windows in texts at begin to end.

    A key is the hash of a passage's shingles, for windows of the first function (an exact repeat has them all in
    common), or of a signature and a least hash of the half before or after its centre.
    """
    n = len(grams)
    c, _, _, function = _unpack(place)
    up, down = text._POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(grams * up[:n], out=sums[1:])
    own = np.flatnonzero(function == 0)
    low, high = _around(place[own], width)
    size = np.maximum(high - low + 1, 0)
    at = np.repeat(low + begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
    yield text.mix((sums[at + width] - sums[at]) * down[at]), np.repeat(own, size), at
    half = (width + 1) // 2
    for side, shift in ((1, half - 1), (2, 0)):
        start = c + begin - shift
        use = np.flatnonzero((start >= begin) & (start + half <= end))
        values = text.mix(grams ^ np.uint64(side * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        # the centre itself is in all of them: the least of the others
        around = start[use, None] + (np.arange(half - 1) + (side == 2))
        least = values[around].min(axis=1) if len(use) else np.zeros(0, np.uint64)
        yield text.mix(least + h[use].view(np.uint64) * np.uint64(side * 16 + 1)), use, c[use] + begin[use]


class _Texts:
    """The shingles (32 bits) of the texts of a slice whose rows are (id, text, ...).

    Rows come in order of their ids, so that a text is taken apart once for all its rows. grams: of all texts, one
    after the other; begin, end: where those of each row's text are; words: the number of its first word; tags.
    """

    def __init__(self, part: pa.RecordBatch, shingle: int) -> None:
        ids, values = part.column(0), part.column(1)
        fresh = np.ones(part.num_rows, bool)
        if part.num_rows > 1:
            same = pc.and_(pc.equal(ids.slice(1), ids.slice(0, part.num_rows - 1)), pc.equal(values.slice(1), values.slice(0, part.num_rows - 1)))
            fresh[1:] = ~same.to_numpy(zero_copy_only=False)
        words = text.Words(values.filter(pa.array(fresh)))
        grams, at = text.ngrams(words, shingle)
        self.grams = (grams >> np.uint64(32)).astype(np.uint32)
        row = np.cumsum(fresh) - 1
        self.begin, self.end, self.words = at[row], at[row + 1], words.first[row]
        self.tags = np.array([_tag(words, d) for d in range(int(fresh.sum()))], np.int32)[row]

    def row(self, i: int) -> np.ndarray:
        return self.grams[self.begin[i] : self.end[i]]


def matched_spans(a: np.ndarray, b: np.ndarray, shifts: list[int], width: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
    """Spans of ``a`` (in shingles) whose windows are in ``b``, where they begin there, and their similarity.

    A shift is a position of ``a`` less its counterpart in ``b``.
    """
    need = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    good = np.zeros(len(a), bool)
    anywhere = np.zeros(len(a), bool)
    if len(a) < width:
        return []
    for center in shifts:
        equal = np.zeros(len(a), bool)
        # the shift itself first: nothing can be added where all is equal
        for shift in sorted(range(center - SLACK, center + SLACK + 1), key=lambda x: abs(x - center)):
            low, high = max(0, shift), min(len(a), len(b) + shift)
            if low < high:
                equal[low:high] |= a[low:high] == b[low - shift : high - shift]
            if equal.all():
                break
        sums = np.concatenate([[0], np.cumsum(equal)])
        starts = np.flatnonzero(sums[width:] - sums[:-width] >= need)
        mark = np.zeros(len(a) + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + width, -1)
        good |= np.cumsum(mark[:-1]) > 0
        anywhere |= equal
    edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    out = []
    for low, high in edges.reshape(-1, 2).tolist():
        # the ends are shingles that are there, not the few that a window may lack
        there = np.flatnonzero(anywhere[low:high])
        low, high = low + int(there[0]), low + int(there[-1]) + 1
        share = float(anywhere[low:high].mean())
        there = min((low - s for s in shifts if 0 <= low - s < len(b)), key=lambda x: (-int((a[low : low + 8] == b[x : x + 8]).sum()) if len(a[low : low + 8]) == len(b[x : x + 8]) else 0, x), default=0)
        out.append((low, high, there, round(share / (2 - share), 6)))
    return out


def passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    hashes: int = HASHES,
    agree: int = AGREE,
) -> DataFrame:
    """Passages that occur in an earlier (lower-numbered) document.

    id, start and end (in words) of the passage, first_id and first_start of its counterpart, similarity; tag
    is a part of a digest of the document's words.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    width = words - shingle + 1
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    windows, path = store.kept(_signatures(source, shingle, words, hashes), "windows")
    shared = windows.groupBy("h").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")).where("first_id < last_id").drop("last_id")
    members, members_path = store.kept(windows.join(shared, "h"), "members")
    store.delete(spark, path)
    firsts = members.where("id = first_id").groupBy("h").agg(F.min(F.struct("place", "tag")).alias("first"))
    later = members.where("id > first_id").join(firsts, "h").select("id", "tag", F.struct("place", "first_id", F.col("first.place").alias("first_place"), F.col("first.tag").alias("first_tag"), "h", "n").alias("p"))
    # as many windows as a document has words, at most
    gathered, gathered_path = store.kept(later.groupBy("id", "tag").agg(F.collect_set("p").alias("pairs")), "gathered")
    pairs, pairs_path = store.kept(gathered.mapInArrow(lambda b: _candidates(b, agree, width), _PAIRS), "pairs")
    found, found_path = store.kept(_verified(source, pairs, shingle, width, similarity), "found")
    store.delete(spark, pairs_path)
    spans = found.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    # of two windows all is compared already
    most = gathered.select("id", "tag", F.filter("pairs", lambda p: p["n"] > 2).alias("pairs")).where(F.size("pairs") > 0)
    unsettled = most.join(spans, ["id", "tag"], "left").select("id", "tag", "pairs", "spans")
    opened, opened_path = store.kept(unsettled.mapInArrow(lambda b: _open(b, agree, shingle, width), "h long, id long, tag int, place long"), "open")
    wanting = opened.distinct().withColumn("wanting", F.lit(True))
    others = members.join(opened.select("h").distinct(), "h", "left_semi").join(wanting, ["h", "id", "tag", "place"], "left")
    others = others.select("id", "tag", F.struct("h", "place", F.coalesce("wanting", F.lit(False)).alias("wanting")).alias("w")).groupBy("id", "tag").agg(F.collect_set("w").alias("w"))
    others, others_path = store.kept(others.join(spans, ["id", "tag"], "left"), "others")
    for done in (gathered_path, opened_path, members_path):
        store.delete(spark, done)
    texts = source.join(others.select("id").distinct(), "id", "left_semi").join(others, "id").select("id", "text", "tag", "w", "spans")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            own = _Texts(part, shingle)
            size = np.array(pc.list_value_length(part.column(3)), np.int64)
            row = np.repeat(np.arange(part.num_rows), size)
            listed = part.column(3).flatten()
            h, place, wants = (listed.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            # texts of one id: the tag decides
            use = own.tags[row] == part.column(2).to_numpy()[row]
            h, place, wants, row = h[use], place[use], wants[use], row[use]
            spans = _Spans(*_flat(part.column(4), np.arange(part.num_rows) * _FAR))
            for k, (key, of, at) in enumerate(_keys(own.grams.astype(np.uint64), h, place, own.begin[row], own.end[row], width)):
                where = at - own.begin[row[of]]
                want = wants[of]
                if not k:
                    want &= ~spans.hold(where + row[of] * _FAR, where + row[of] * _FAR + width + shingle - 2)
                rows = pa.array(row[of])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(rows), part.column(2).take(rows), pa.array(where, pa.int32()), pa.array(want)], ["key", "id", "tag", "at", "wanting"])

    keys, keys_path = store.kept(texts.mapInArrow(keyed, "key long, id long, tag int, at int, wanting boolean"), "keys")
    store.delete(spark, others_path)
    least = keys.groupBy("key").agg(F.min(F.struct("id", "tag", "at")).alias("first"), F.max(F.when(F.col("wanting"), F.col("id"))).alias("last")).where("first.id < last").drop("last")
    again = keys.where("wanting").join(least, "key").where("id > first.id")
    shift = F.col("at") - F.col("first.at")
    a = F.struct(F.min(F.greatest(F.col("at") - 2 * width, F.lit(0))).alias("start"), F.max(F.col("at") + 3 * width).alias("end"))
    b = F.struct(F.min(F.greatest(F.col("first.at") - 2 * width - SLACK, F.lit(0))).alias("start"), F.max(F.col("first.at") + 3 * width + SLACK).alias("end"))
    more = again.groupBy("id", "tag", F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag")).agg(a.alias("a"), b.alias("b"), F.collect_set(shift).alias("shifts"))
    more, more_path = store.kept(more, "more")
    store.delete(spark, keys_path)
    some = source.join(more.select("id").union(more.select("first_id")).distinct(), "id", "left_semi")
    out = store.written(found.unionByName(_verified(some, more, shingle, width, similarity)).distinct(), "passages")
    for done in (found_path, more_path):
        store.delete(spark, done)
    return out


def _verified(source: DataFrame, pairs: DataFrame, shingle: int, width: int, similarity: float) -> DataFrame:
    """The passages of ``pairs``, as ``_candidates`` gives them.

    The earlier document's part is cut out first. One copy of its text serves some ``ASKED`` pairs, however many ask.
    """
    asked = pairs.groupBy("first_id").agg(F.ceil(F.count("*") / F.lit(ASKED)).cast("int").alias("parts")).where("parts > 1")
    request = F.struct("id", "tag", "first_tag", F.col("a.start").alias("at"), F.col("a.end").alias("to"), F.col("b.start").alias("there"), F.col("b.end").alias("until"), "shifts")
    dealt_out = pairs.join(asked, "first_id", "left").withColumn("part", F.pmod(F.xxhash64("id", "tag"), F.coalesce("parts", F.lit(1))))
    requests = dealt_out.groupBy("first_id", "part").agg(F.collect_list(request).alias("requests"))
    # texts are dealt out by id once, for both joins
    dealt = source.hint("merge")
    ahead = dealt.withColumnRenamed("id", "first_id").join(requests, "first_id").select("first_id", "text", "requests")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            own = _Texts(part, shingle)
            size = np.array(pc.list_value_length(part.column(2)), np.int64)
            row = np.repeat(np.arange(part.num_rows), size)
            asking = pa.RecordBatch.from_struct_array(part.column(2).flatten())
            use = asking.column(2).to_numpy() == own.tags[row]
            asking, row = asking.filter(pa.array(use)), row[use]
            length = (own.end - own.begin)[row]
            low, high = (np.minimum(asking.column(k).to_numpy(), length) for k in (5, 6))
            begin, size = own.begin[row] + low, np.maximum(high - low, 0)
            for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // SENT)) + 1):
                ends = np.concatenate([[0], np.cumsum(size[some])])
                y = own.grams[np.repeat(begin[some] - ends[:-1], size[some]) + np.arange(ends[-1])]
                y = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(4 * ends), pa.py_buffer(y)]).cast(pa.binary())
                picked = pa.array(some)
                columns = [*(asking.column(k).take(picked) for k in (0, 1)), part.column(0).take(pa.array(row[some])), *(asking.column(k).take(picked) for k in (3, 4, 5, 7)), y]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "first_id", "at", "to", "there", "shifts", "y"])

    regions = ahead.mapInArrow(cut, "id long, tag int, first_id long, at int, to int, there int, shifts array<int>, y binary")
    both = dealt.join(regions, "id").select("id", "text", "tag", "first_id", "at", "to", "there", "shifts", "y")
    names = ["id", "tag", "start", "end", "first_id", "first_start", "similarity"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches):
            texts = _Texts(part, shingle)
            rows = []
            ids, tags, firsts, at, to, there, shifts, ys = (part.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7, 8))
            for i in np.flatnonzero(texts.tags == part.column(2).to_numpy()).tolist():
                moved = [s - at[i] + there[i] for s in shifts[i]]
                for low, high, place, share in matched_spans(texts.row(i)[at[i] : to[i]], np.frombuffer(ys[i], np.uint32), moved, width, similarity):
                    rows.append((ids[i], tags[i], at[i] + low, at[i] + high + shingle - 1, firsts[i], there[i] + place, share))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    # a row that is repeated gives its passages again; they count once
    return both.mapInArrow(verify, "id long, tag int, start int, end int, first_id long, first_start int, similarity double").distinct()


def members(found: DataFrame) -> DataFrame:
    """Every document's part in a passage: the later ones, and the first ones themselves."""
    later = found.select("id", "start", "end", "first_id", "first_start", "similarity")
    first = found.select(F.col("first_id").alias("id"), F.col("first_start").alias("start"), (F.col("first_start") + F.col("end") - F.col("start")).alias("end"), "first_id", "first_start", F.lit(1.0).alias("similarity"))
    return later.unionByName(first).distinct()


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the passages that occur in an earlier document; a passage goes from its first word to its last."""
    found = passages(docs, id_col=id_col, text_col=text_col, **options)
    key, cut = store.fresh(docs, "id", "cuts")
    spans = found.groupBy("id", "tag").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    # a row for each text of an id; the text's digest decides
    cuts = spans.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("tag", "spans")).alias(cut))
    joined = docs.withColumn(key, F.col(id_col).cast("long")).join(cuts, key, "left").select(*docs.columns, cut)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, at):
            values = part.column(at).to_pylist()
            for i, cuts in enumerate(part.column(last).to_pylist()):
                if not cuts or values[i] is None:
                    continue
                words = text.Words(part.column(at).slice(i, 1))
                tag = _tag(words, 0)
                raw, kept, end = values[i].encode(), [], 0
                for span in next((c["spans"] for c in cuts if c["tag"] == tag), []):
                    low, high = int(words.start[span["start"]]), int(words.end[span["end"] - 1])
                    kept.append(raw[end : max(low, end)])
                    end = max(end, high)
                values[i] = b"".join([*kept, raw[end:]]).decode()
            columns = list(part.columns[:last])
            columns[at] = pa.array(values, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:last])

    return joined.mapInArrow(run, docs.schema)
