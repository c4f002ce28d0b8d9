r"""Chat formatting from event logs.

A log has events of conversations: ``message`` opens a message with a text, ``delta`` adds a streamed piece to it, ``edit`` gives it another text and
``regenerate`` clears it (or gives it its text anew); both of these end all messages that were opened after it until then. Each event names its message.

* ``fold`` partitions by conversation and message, sorts by sequence and folds each message's events. A conversation that holds a third of all events is thus
  dealt out; one message is in memory at a time. Messages that an edit ended are found by running minima, within ranges of
  the log and then over ranges, so that no conversation is in one task.
* ``render`` deals messages by ranges of (conversation, sequence) and writes blocks of whole turns of about ``BLOCK`` bytes, with the spans of code points under the loss mask.
  A conversation is its blocks in the order of ``part``, nothing between.
* ``read_back`` parses blocks again and takes digests, block after block: a digest must see a conversation in order, but only one block is in memory.

The template: ``### User: text</turn>`` and a line feed. In texts a backslash is doubled, ``</turn>`` is ``<\/turn>`` and ``##`` is ``#\#``, so that no control string
occurs inside; what follows a backslash stands for itself. A role of lower-case letters, digits and ``_`` is written with a capital; any other after a backslash,
with its backslashes, colons and line feeds escaped.

Defined results: null texts and roles are empty; a null kind is ``message``, unknown kinds are not read; a message opened again under its name is another message; a
delta or edit before its message opens it; null conversations are one conversation, null sequences come first; equal sequences are ordered by kind, role and text; a text of any
length is one turn, in one block; an empty log gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import store, text

#: Bytes of a block, unless one turn is longer.
BLOCK = 1 << 20

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"

#: Roles whose texts are under the loss mask.
TRAINED = ("assistant",)

_KINDS = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}
_PLAIN = re.compile("[a-z][a-z0-9_]*")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("##", "#\\#")


def unescape(value: str) -> str:
    return _ESCAPED.sub(r"\1", value)


def _role(role: str) -> str:
    if _PLAIN.fullmatch(role):
        return role[0].upper() + role[1:]
    return "\\" + role.replace("\\", "\\\\").replace(":", "\\.").replace("\n", "\\n")


def _read_role(head: str) -> str:
    if not head.startswith("\\"):
        return head[0].lower() + head[1:]
    return re.sub(r"\\(.)", lambda m: {".": ":", "n": "\n"}.get(m[1], m[1]), head[1:])


def turn(role: str, value: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head, body = HEAD + _role(role) + MIDDLE, escape(value)
    return head + body + END, len(head), len(head) + len(body)


def parse(block: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn."""
    at = 0
    while at < len(block):
        middle = block.index(MIDDLE, at)
        end = block.index(END, middle + len(MIDDLE))
        yield _read_role(block[at + len(HEAD) : middle]), unescape(block[middle + len(MIDDLE) : end])
        at = end + len(END)


# --- fold -------------------------------------------------------------------------------------------------


class _Message:
    """The fold of one message's events."""

    def __init__(self, seq: object, role: str | None) -> None:
        self.seq, self.role, self.pieces = seq, role or "", []

    def row(self, key: tuple, nth: int) -> tuple:
        return (*key, self.seq, nth, self.role, "".join(self.pieces), None)


def _fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events to messages, and to cuts: at this sequence all messages opened since ``low`` end."""
    key: tuple | None = None
    now: _Message | None = None
    nth = 0
    for conv, message, seq, kind, role, value in events:
        if (conv, message) != key:
            if now:
                yield now.row(key, nth)
            key, now, nth = (conv, message), None, 0
        if now is None or kind == "message":
            if now:
                yield now.row(key, nth)
                nth += 1
            now = _Message(seq, role)
        elif kind != "delta":
            now.pieces.clear()
            yield (*key, seq, nth, None, None, now.seq)
        now.pieces.append(value or "")
    if now:
        yield now.row(key, nth)


_FOLDED = ["conv", "message", "seq", "nth", "role", "text", "low"]


def _message_kind(log: DataFrame, names: list[str]) -> str:
    conv, message, seq = (log.schema[c].dataType.simpleString() for c in names)
    return f"conv {conv}, message {message}, seq {seq}, nth int, role string, text string, low {seq}"


def _batched(rows: Iterator[tuple], kinds: Callable[[], list[pa.DataType]], names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``ARROW_ROWS`` rows and about as many bytes of text as a slice; ``size``: the column of texts."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds(), strict=True)], names)

    for row in rows:
        held.append(row)
        n += len(row[size] or "")
        if len(held) >= store.ARROW_ROWS or n >= text.SLICE_BYTES:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch], at: int, kinds: list[pa.DataType]) -> Iterator[tuple]:
    """Rows of batches whose texts are in column ``at``; ``kinds`` gets the types of their columns."""

    def seen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[:] = batch.schema.types
            yield batch

    for part in text.slices(seen(), at):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def fold(log: DataFrame, *, conv_col: str = "conv_id", seq_col: str = "seq", message_col: str = "message", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The final messages: conv, message, seq (where it was opened), nth (of its name), role, text."""
    store.bounded_batches(log.sparkSession)
    kind = F.coalesce(F.col(kind_col), F.lit("message")).alias("kind")
    events = log.select(F.col(conv_col).alias("conv"), F.col(message_col).alias("message"), F.col(seq_col).alias("seq"), kind, F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    events = events.where(F.col("kind").isin(*_KINDS))
    schema = _message_kind(events, ["conv", "message", "seq"])
    place = F.get(F.array(*(F.lit(k) for k in _KINDS.values())), F.array_position(F.array(*(F.lit(k) for k in _KINDS)), F.col("kind")).cast("int") - 1)
    dealt = events.repartition("conv", "message").sortWithinPartitions("conv", "message", "seq", place, "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        folded = _fold(_rows(batches, 5, kinds))
        yield from _batched(folded, lambda: [*kinds[:3], pa.int32(), pa.string(), pa.string(), kinds[2]], _FOLDED, 5)

    return _surviving(store.written(dealt.mapInArrow(run, schema), "messages"))


def _surviving(folded: DataFrame) -> DataFrame:
    """Messages that no cut ended: none of a later sequence goes back to before the message was opened."""
    messages = folded.where("role is not null")
    points = folded.select("conv", "message", "seq", "nth", "low", F.col("role").isNull().alias("cut"))
    points = store.written(points.repartitionByRange("conv", "seq").withColumn("range", F.spark_partition_id()), "points")
    later = Window.partitionBy("conv", "range").orderBy(F.col("seq").desc(), "cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy("conv").orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lows = points.groupBy("conv", "range").agg(F.min("low").alias("low"))
    carried = lows.select(F.col("conv").alias("c"), F.col("range").alias("r"), F.min("low").over(beyond).alias("carried"))
    here = points.withColumn("low", F.min("low").over(later)).where("not cut")
    ended = here.join(carried, F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).where(F.least("low", "carried") < F.col("seq"))
    keys = ["conv", "message", "seq", "nth"]
    ended = ended.select(*(F.col(k).alias(f"ended_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"ended_{k}")) for k in keys]
    return messages.join(ended, same, "left_anti").select(*keys, "role", "text")


# --- render -----------------------------------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(rows: Iterator[tuple], first: int, limit: int, trained: tuple[str, ...]) -> Iterator[tuple]:
    """Blocks of whole turns of one conversation each: conv, part, formatted, turns, spans under the loss mask."""
    conv: object = None
    pieces: list[str] = []
    spans: list[dict[str, int]] = []
    n = used = 0
    for own, role, value in rows:
        if pieces and (own != conv or used >= limit):
            yield conv, first, "".join(pieces), len(pieces), spans
            first, pieces, spans, n, used = first + 1, [], [], 0, 0
        conv = own
        formatted, start, end = turn(role, value)
        if role in trained:
            spans.append({"start": n + start, "end": n + end})
        pieces.append(formatted)
        n += len(formatted)
        used += len(formatted)
    if pieces:
        yield conv, first, "".join(pieces), len(pieces), spans


def render(messages: DataFrame, *, block: int = BLOCK, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Blocks of formatted conversations: conv, part (their order), formatted, n_turns, and loss, the spans of code points to learn from."""
    order = ["conv", "seq", "message", "nth"]
    dealt = messages.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text")
    kind = messages.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        made = _blocks(_rows(batches, 2, kinds), TaskContext.get().partitionId() << 32, block, trained)
        yield from _batched(made, lambda: [kinds[0], pa.int64(), pa.string(), pa.int64(), _SPANS], ["conv", "part", "formatted", "n_turns", "loss"], 2)

    return dealt.mapInArrow(run, f"conv {kind}, part long, formatted string, n_turns long, loss array<struct<start:long,end:long>>")


# --- read back --------------------------------------------------------------------------------------------


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, block: str, spans: list[dict[str, int]]) -> None:
        for role, value in parse(block):
            self.turns.update(f"{role}\n{value}\n".encode())
            self.n_turns += 1
        for span in spans:
            learned = unescape(block[span["start"] : span["end"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.formatted_chars += len(block)

    def row(self, conv: object) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(blocks: DataFrame) -> DataFrame:
    """Per conversation, from its blocks alone: turns and what is under the loss mask, as counts and digests."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    dealt = blocks.select("conv", "part", "formatted", "loss").repartition("conv").sortWithinPartitions("conv", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def digests() -> Iterator[tuple]:
            conv, now = None, None
            for own, _, formatted, spans in _rows(batches, 2, kinds):
                if now is not None and own != conv:
                    yield now.row(conv)
                    now = None
                conv, now = own, now or _Digest()
                now.add(formatted, spans)
            if now is not None:
                yield now.row(conv)

        yield from _batched(digests(), lambda: [kinds[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], names, 2)

    return dealt.mapInArrow(run, f"conv {blocks.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_log(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A table of finished turns as a log: each row opens its message, in the order of its turn."""
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("seq"), F.col(turn_col).alias("message"), F.lit("message").alias("kind"), "role", "text")


def events_of(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The same turns as a client would have logged them.

    A text is streamed line by line. What an assistant says is first streamed otherwise and then generated anew; what others say is
    first said otherwise and answered, and then edited, which ends that answer.
    """
    steps = 1 << 32
    at = F.col(turn_col).cast("long") * steps
    lines = F.split(F.coalesce("text", F.lit("")), "(?<=\n)", -1)
    answers = F.coalesce(F.col("role") == "assistant", F.lit(False))

    def event(step: Column, kind: str, value: Column, message: Column | None = None, role: Column | None = None) -> Column:
        own = F.col(turn_col).cast("long") if message is None else message
        return F.struct((at + step).alias("seq"), own.alias("message"), F.lit(kind).alias("kind"), (F.col("role") if role is None else role).alias("role"), value.alias("text"))

    streamed = F.transform(lines, lambda line, i: event(F.lit(4) + i, "delta", line))
    again = [event(F.lit(0), "message", F.lit(None).cast("string")), event(F.lit(1), "delta", F.lit("## first </turn>")), event(F.lit(2), "regenerate", F.lit(None).cast("string"))]
    other = [
        event(F.lit(0), "message", F.lit("said otherwise")),
        event(F.lit(1), "message", F.lit("and answered"), -F.col(turn_col).cast("long") - 1, F.lit("assistant")),
        event(F.lit(2), "edit", F.lit("")),
    ]
    made = F.concat(F.when(answers, F.array(*again)).otherwise(F.array(*other)), streamed)
    return rows.select(F.col(conv_col).alias("conv_id"), F.explode(made).alias("e")).select("conv_id", "e.*")
