"""Read large export documents in parallel byte ranges.

A JSON document is read as text that ends at every closing brace, so Spark cuts
a file wherever it likes and a row holds at most what stands between two braces.
Three passes over the ranges, each one a scan without a shuffle:

1. Every range reports the parity of its quotes and its change of depth, once
   for each of the two states it may start in. (A brace never follows a
   backslash outside a string, so no escape crosses a cut.) The prefix over a
   file's ranges, one row each, gives the true state at every cut.
2. With it a range reports the brackets and keys it opens at the few outer depths.
3. With these too, ranges cut the text into messages, what else a chat holds,
   and what else the document holds. A message that lies in one range is whole;
   the two ends of others meet in one small aggregate.

No row holds a document or the messages of a chat, at any size of file and chat,
and the rows do not depend on where the ranges are cut. The state of a range is
about 100 bytes for every ``spark.sql.files.maxPartitionBytes`` of input and is
sent to the scans by broadcast up to ``SENT_RANGES`` ranges, and joined beyond.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators.ordering import add_row_number, order_rows
from chatloom.session import land, ship_package
from chatloom.sources import exports

# Depth of the messages inside {"chats": {"list": [{"messages": [...]}]}}.
DEEPEST = 5
CHUNK = 1 << 22
SENT_RANGES = 100_000
DOCUMENT, CHAT, MESSAGE, OWN_MESSAGE = range(4)  # the last: of a document that is a chat
COMMA, COLON, OPEN, CLOSE, LIST, END = b",:{}[]"
BLANKS = b" \t\r\n"


def text_ranges(spark: SparkSession, path: str | list[str], glob: str | None = None, above: int = 0) -> DataFrame:
    """Texts between closing braces of the files of more than ``above`` bytes.

    Rows of one range (``source, start``) are in file order inside a partition.
    """
    reader = spark.read.option("lineSep", "}").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (
        reader.text(path)
        .filter(F.col("_metadata.file_size") > above)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("start"),
            "value",
        )
    )


@dataclass
class Marks:
    """Brackets, commas and colons outside strings at the outer depths of some text."""

    at: np.ndarray
    letter: np.ndarray
    depth: np.ndarray  # of what the bracket encloses
    quotes: np.ndarray  # positions of the quotes that bound strings
    in_string: int  # at the end
    end_depth: int


def marks(data: np.ndarray, in_string: int, depth: int) -> Marks:
    n = len(data)
    at = np.arange(n)
    other = np.maximum.accumulate(np.where(data == ord("\\"), -1, at)) if n else at
    slashes = at - 1 - np.concatenate([[-1], other[:-1]])[:n]
    quote = (data == ord('"')) & (slashes % 2 == 0)
    inside = (np.cumsum(quote) + in_string) & 1
    outside = (inside == 0) & ~quote
    opens = outside & ((data == OPEN) | (data == LIST))
    closes = outside & ((data == CLOSE) | (data == END))
    level = depth + np.cumsum(opens.astype(np.int64) - closes)
    marked = opens | closes | (outside & ((data == COMMA) | (data == COLON)))
    where = np.flatnonzero(marked)
    of = level[where] + closes[where]
    near = (of <= DEEPEST) & (of > 0)
    where, of = where[near], of[near]
    ends = (int(inside[-1]), int(level[-1])) if n else (in_string, depth)
    return Marks(where, data[where], of, np.flatnonzero(quote), *ends)


def _ranges(scan):
    """Feed the text of each range of a partition to a new ``scan(row)`` in bounded chunks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = current = last = None
        for batch in batches:
            sources, starts = batch.column("source").to_pylist(), batch.column("start").to_pylist()
            texts = batch.column("value").cast(pa.binary()).to_pylist()
            held, size = [], 0
            for i, text in enumerate(texts):
                if (sources[i], starts[i]) != key:
                    if current is not None:
                        current.feed(b"".join(held))
                        current.finish(last)
                        yield from current.rows()
                    key, held, size, last = (sources[i], starts[i]), [], 0, None
                    current = scan({c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "value"})
                if last is not None:
                    held.append(last + b"}")
                    size += len(last) + 1
                last = text
                if size > CHUNK:
                    current.feed(b"".join(held))
                    yield from current.rows()
                    held, size = [], 0
            if held:
                current.feed(b"".join(held))
                yield from current.rows()
        if current is not None:
            current.finish(last)
            yield from current.rows()

    return apply


class _Parity:
    """Pass 1: bytes, quotes and depth of a range for both states at its start."""

    def __init__(self, row: dict) -> None:
        self.row, self.bytes, self.first = row, 0, None
        self.states = [(0, 0), (1, 0)]
        self.done = False

    def feed(self, text: bytes) -> None:
        if self.first is None and text.strip(BLANKS):
            self.first = chr(text.strip(BLANKS)[0])
        data = np.frombuffer(text, dtype=np.uint8)
        found = [marks(data, *state) for state in self.states]
        self.states = [(m.in_string, m.end_depth) for m in found]
        self.bytes += len(text)

    def finish(self, last: bytes) -> None:
        self.feed(last + b"}")
        self.done = True

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            (flips, outer), (_, inner) = self.states
            r = self.row
            yield pa.RecordBatch.from_pylist(
                [{"source": r["source"], "size": r["size"], "start": r["start"], "bytes": self.bytes, "first": self.first,
                  "flips": flips, "outer": outer, "inner": inner}],
                _PARITY,
            )


_PARITY = pa.schema(
    [("source", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("bytes", pa.int64()),
     ("first", pa.string()), ("flips", pa.int64()), ("outer", pa.int64()), ("inner", pa.int64())]
)


class _Walk:
    """State inside a range: last bracket and key of every outer depth."""

    def __init__(self, row: dict) -> None:
        self.row = row
        self.in_string, self.depth = row["in_string"], row["depth"]
        self.slots: list[str | None] = [None] * (DEEPEST + 1)
        self.done = False

    def feed(self, text: bytes) -> None:
        data = np.frombuffer(text, dtype=np.uint8)
        m = marks(data, self.in_string, self.depth)
        closing = np.searchsorted(m.quotes, m.at) - 1
        for at, letter, depth, k in zip(m.at.tolist(), m.letter.tolist(), m.depth.tolist(), closing.tolist()):
            if letter == COLON:
                # A string that began before this text holds a brace and is no key that matters.
                name = "?" if k < 1 else _string(text[m.quotes[k - 1] : m.quotes[k] + 1])
                self.slots[depth] = "{" + name
            elif letter in (OPEN, LIST):
                self.slots[depth] = chr(letter)
            self.mark(at, letter, depth, text)
        self.in_string, self.depth = m.in_string, m.end_depth
        self.rest(text)

    def finish(self, last: bytes) -> None:
        self.feed(last if self.row["open_end"] else last + b"}")
        self.done = True

    def mark(self, at: int, letter: int, depth: int, text: bytes) -> None: ...

    def rest(self, text: bytes) -> None: ...

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            slots = {f"slot_{d}": self.slots[d] for d in range(1, DEEPEST + 1)}
            yield pa.RecordBatch.from_pylist([{"source": self.row["source"], "start": self.row["start"], **slots}], _SLOTS)


_SLOT_NAMES = [f"slot_{d}" for d in range(1, DEEPEST + 1)]
_SLOTS = pa.schema([("source", pa.string()), ("start", pa.int64()), *((c, pa.string()) for c in _SLOT_NAMES)])


def _string(token: bytes) -> str:
    try:
        return json.loads(token)
    except ValueError:
        return "?"


class _Cut(_Walk):
    """Pass 3: the text of a range as parts of messages, chats and the document."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        self.slots = [None, *(row[c] for c in _SLOT_NAMES)]
        self.n_chats = self.n_messages = 0  # begun in this range; messages in its last chat
        self.listed = False
        self.begun = False  # whether the open part begins here
        self.text: list[bytes] = []
        self.at = 0
        self.out: list[tuple] = []
        self.kind = self.kind_here()

    def within(self) -> int:
        """Depth of the open list of chats, 0 outside of one."""
        if self.slots[1] == "[":
            return 1
        return 3 if self.slots[1:4] == ["{chats", "{list", "["] else 0

    def kind_here(self) -> int:
        """What the text where the range starts belongs to."""
        if self.within() > self.depth:  # the list is closed
            self.slots[self.within()] = None
        chats = self.within()
        inside = self.slots[chats + 1] == "{messages" and self.slots[chats + 2] == "[" and self.depth >= chats + 2
        return (MESSAGE if chats else OWN_MESSAGE) if inside else (CHAT if chats else DOCUMENT)

    def part(self, text: bytes, to: int, end: str | None) -> None:
        """Close the open part at ``to``."""
        self.text.append(text[self.at : to])
        body = b"".join(self.text)
        if body or self.begun or end:
            self.out.append((self.kind, self.n_chats, self.n_messages, self.begun, end, body.decode(errors="replace")))
        self.text, self.begun = [], False

    def mark(self, at: int, letter: int, depth: int, text: bytes) -> None:
        chats = self.within()
        in_message = self.kind in (MESSAGE, OWN_MESSAGE)
        if in_message and depth > chats + 2:
            return
        if letter == LIST and not in_message:
            if depth == chats and self.kind == DOCUMENT:
                self.part(text, at + 1, None)
                self.listed |= depth == 3
                self.begin(CHAT, at + 1)
            elif depth == chats + 2 and self.slots[depth - 1] == "{messages":
                self.part(text, at + 1, "[")
                self.begin(MESSAGE if chats else OWN_MESSAGE, at + 1)
        elif letter == COMMA and depth == chats + 2 * in_message and self.kind != DOCUMENT:
            self.part(text, at, ",")
            self.begin(self.kind, at + 1)
        elif letter == END and depth == chats + 2 * in_message and self.kind != DOCUMENT:
            self.part(text, at, "]")
            self.at = at
            if in_message:
                self.kind = CHAT if chats else DOCUMENT
            else:
                self.kind = DOCUMENT
                self.slots[depth] = None

    def begin(self, kind: int, at: int) -> None:
        self.kind, self.at, self.begun = kind, at, True
        if kind == CHAT:
            self.n_chats += 1
            self.n_messages = 0
        else:
            self.n_messages += 1

    def rest(self, text: bytes) -> None:
        self.text.append(text[self.at :])
        self.at = 0

    def finish(self, last: bytes) -> None:
        super().finish(last)
        self.part(b"", 0, None)
        self.out.append((None, self.n_chats, self.n_messages, self.listed, None, None))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            first = self.row.setdefault("written", 0)
            self.row["written"] += len(self.out)
            columns = [pa.array(c, t) for c, t in zip(zip(*self.out), [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()])]
            n = len(self.out)
            fixed = [pa.array([self.row["source"]] * n), pa.array([self.row["start"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())]
            self.out = []
            yield pa.RecordBatch.from_arrays([*fixed, *columns], ["source", "start", "seq", "kind", "chat", "message", "begun", "ended", "body"])


_PARTS = "source string, start long, seq long, kind int, chat long, message long, begun boolean, ended string, body string"


def _known(ranges: DataFrame, states: DataFrame) -> DataFrame:
    """Ranges with their state, in file order: sent to the scan, or sorted anew."""
    key = ["source", "start"]
    if states.count() <= SENT_RANGES:
        return ranges.join(F.broadcast(states.drop("size")), key)
    placed = ranges.withColumn("row", F.monotonically_increasing_id()).join(states.drop("size"), key)
    return placed.repartition(*key).sortWithinPartitions(*key, "row").drop("row")


@dataclass(frozen=True)
class SplitExports:
    """``chats`` (source, ordinal, name, type, opening, closing), ``messages``
    (source, ordinal, pos, text) and ``report`` (source, status, n_chats) of documents.

    ``opening`` and ``closing`` are a chat's text around its messages.
    """

    chats: DataFrame
    messages: DataFrame
    report: DataFrame


def split_exports(spark: SparkSession, path: str | list[str], glob: str | None = None, above: int = 0) -> SplitExports:
    """Chats and messages of all files of more than ``above`` bytes below ``path``.

    Equal to ``read_exports`` with ``export_messages``, for documents and chats
    of any size.
    """
    ship_package(spark)
    ranges = text_ranges(spark, path, glob, above)
    columns = "source string, size long, start long, bytes long, first string, flips long, outer long, inner long"
    parity = land(ranges.mapInArrow(_ranges(_Parity), columns), "range-parity")
    by_file = Window.partitionBy("source").orderBy("start")
    whole = Window.partitionBy("source")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    in_string = F.coalesce(F.sum("flips").over(before), zero) % 2
    change = F.when(F.col("in_string") == 0, F.col("outer")).otherwise(F.col("inner"))
    # The text after the last brace is counted with a brace that is not there;
    # a byte order mark of three bytes is not counted.
    extra = F.pmod(F.sum("bytes").over(whole) - F.col("size"), F.lit(3)) == 1
    states = land(
        parity.withColumn("in_string", in_string)
        .withColumn("depth", F.coalesce(F.sum(change).over(before), zero))
        .withColumn("is_last", F.col("start") == F.max("start").over(whole))
        .withColumn("open_end", F.col("is_last") & extra)
        .withColumn("end_depth", F.col("depth") + change + F.col("open_end").cast("bigint"))
        .withColumn("balanced", (F.col("end_depth") == 0) & ((F.col("in_string") + F.col("flips")) % 2 == 0)),
        "range-states",
    )
    slots = land(
        _known(ranges, states.select("source", "size", "start", "in_string", "depth", "open_end")).mapInArrow(
            _ranges(_Walk), "source string, start long, " + ", ".join(f"{c} string" for c in _SLOT_NAMES)
        ),
        "range-slots",
    )
    opened = land(
        states.join(slots, ["source", "start"]).select(
            "source", "size", "start", "in_string", "depth", "open_end",
            *(F.last(c, ignorenulls=True).over(before).alias(c) for c in _SLOT_NAMES),
        ),
        "range-opened",
    )
    parts = land(_known(ranges, opened).mapInArrow(_ranges(_Cut), _PARTS), "range-parts")
    return _assembled(parts, states)


def _assembled(parts: DataFrame, states: DataFrame) -> SplitExports:
    by_file = Window.partitionBy("source").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ends = parts.filter("kind IS NULL").select("source", "start", F.col("chat").alias("n_chats"), F.col("message").alias("n_messages"), F.col("begun").alias("listed"))
    # Chats and messages begun before a range: messages count from the last chat's begin.
    run = F.sum((F.col("n_chats") > 0).cast("bigint")).over(by_file)
    numbered = ends.withColumn("run", run).withColumn(
        "inside", F.sum("n_messages").over(Window.partitionBy("source", "run").orderBy("start"))
    )
    offsets = numbered.select(
        "source", "start",
        F.coalesce(F.sum("n_chats").over(before), zero).alias("chats_before"),
        F.coalesce(F.lag("inside").over(by_file), zero).alias("messages_before"),
    )
    offsets = land(offsets, "range-offsets")
    placed = parts.filter("kind IS NOT NULL").join(F.broadcast(offsets), ["source", "start"]).select(
        "source", "start", "seq", "kind", "begun", "ended", "body",
        F.when(F.col("kind") == OWN_MESSAGE, -1).otherwise(F.col("chats_before") + F.col("chat") - 1).alias("chat_no"),
        (F.when(F.col("chat") == 0, F.col("messages_before")).otherwise(zero) + F.col("message") - 1).alias("pos"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("start", "seq", "body", "ended")))
    joined = F.array_join(F.transform(ordered, lambda x: x.body), "")
    # Where a list of messages opens, counted from 1; 0 without one.
    opens = F.array_position(F.transform(ordered, lambda x: F.coalesce(x.ended == "[", F.lit(False))), True)
    opening = F.array_join(F.transform(F.slice(ordered, F.lit(1), opens.cast("int")), lambda x: x.body), "").alias("opening")
    last = F.max_by("ended", F.struct(F.col("ended").isNotNull(), "start", "seq"))
    is_message = F.col("kind").isin(MESSAGE, OWN_MESSAGE)
    whole = F.col("begun") & F.col("ended").isNotNull()
    unit = ["source", "chat_no", "pos"]
    cut = placed.filter(is_message & ~whole).groupBy(*unit).agg(joined.alias("text"), last.alias("ended"))
    messages = placed.filter(is_message & whole).select(*unit, F.col("body").alias("text"), "ended").union(cut)
    blank = F.trim(F.regexp_replace(F.col("text"), r"[ \t\r\n]+", "")) == ""
    # Nothing between the brackets of a list is no element.
    messages = land(messages.filter(~((F.length("text") < 1000) & blank & (F.col("pos") == 0) & (F.col("ended") == "]"))), "split-messages")
    heads = placed.filter(F.col("kind") == CHAT).groupBy("source", "chat_no").agg(joined.alias("text"), opening, last.alias("ended"))
    heads = heads.filter(~(blank & (F.col("chat_no") == 0) & (F.col("ended") == "]"))).drop("ended")
    rests = placed.filter(F.col("kind") == DOCUMENT).groupBy("source").agg(joined.alias("rest"), opening)
    heads = land(heads, "split-heads")
    # The first letter of a file is in its first range that has one.
    first = states.groupBy("source").agg(
        F.min_by("first", F.struct(F.col("first").isNull(), "start")).alias("first"),
        F.bool_and(~F.col("is_last") | F.col("balanced")).alias("balanced"),
    )
    lists = ends.groupBy("source").agg(F.max("listed").alias("listed"))
    files = land(first.join(rests, "source", "left").join(lists, "source", "left"), "split-files")
    broken = lambda rows: rows.filter(~exports.is_value(F.col("text"))).select("source").distinct().withColumn("broken", F.lit(True))
    bad = broken(messages.select("source", "text").union(heads.select("source", "text")))
    judged = files.join(bad, "source", "left").withColumn(
        "readable",
        F.col("broken").isNull() & F.coalesce("balanced", F.lit(False)) & F.coalesce(exports.is_readable(F.coalesce("rest", F.lit(""))), F.lit(False)),
    )
    judged = land(judged, "split-judged")
    good = judged.filter("readable").select("source", "first", "listed", "rest", F.col("opening").alias("own_opening"))
    alone = good.filter((F.col("first") == "{") & ~F.col("listed") & exports.is_chat(F.col("rest")))
    in_list = heads.join(good, "source").filter((F.col("first") == "[") | F.col("listed"))
    kept = in_list.filter(F.col("listed") | exports.is_chat(F.col("text"))).select("source", "chat_no", "opening", F.col("text").alias("header"))
    chats = kept.union(alone.select("source", F.lit(-1).cast("bigint"), "own_opening", "rest"))
    chats = add_row_number(order_rows(chats, ["source"], ["chat_no"], 100_000), "number").union()
    chats = land(chats.withColumn("ordinal", (F.col("number") - 1).cast("int")).drop("number"), "split-chats")
    head = F.from_json("header", "name string, type string")
    closing = F.expr("substring(header, length(opening) + 1)").alias("closing")
    named = chats.select("source", "ordinal", F.inline(F.array(head)), "opening", closing)
    texts = messages.join(chats.select("source", "chat_no", "ordinal"), ["source", "chat_no"]).select("source", "ordinal", "pos", "text")
    counts = chats.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(~F.col("readable"), exports.UNPARSEABLE).when(n == 0, exports.NO_CHATS).otherwise(exports.OK)
    report = judged.join(counts, "source", "left").select("source", status.alias("status"), n.alias("n_chats"))
    return SplitExports(named, texts, report)


def split_messages(found: SplitExports, files: DataFrame | None = None) -> DataFrame:
    """The messages field by field, as ``export_messages`` gives them.

    ``files`` may add columns by ``source``, in front of the others.
    """
    key = F.format_string("%s#%09d", "source", "ordinal").alias("chat_key")
    named = found.chats.select("source", "ordinal", key, "name", "type")
    others = []
    if files is not None:
        others = [c for c in files.columns if c != "source"]
        named = named.join(files, "source")
    texts = found.messages.join(named, ["source", "ordinal"])
    return exports.message_fields(texts.select(*others, "chat_key", "name", "type", "pos", "text"))


def raw_lines(found: SplitExports, messages_per_line: int = 100_000) -> DataFrame:
    """``source, ordinal, value``: chats as JSON, a long one as several lines.

    Every line is the chat with at most so many of its messages, in order, so
    that no row grows with a chat.
    """
    lines = (
        found.messages.withColumn("line", F.floor(F.col("pos") / messages_per_line))
        .groupBy("source", "ordinal", "line")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), ",").alias("inside"))
    )
    own = found.chats.select("source", "ordinal", "opening", "closing").join(lines, ["source", "ordinal"], "left")
    value = F.concat("opening", F.coalesce("inside", F.lit("")), "closing")
    # Line breaks of JSON are layout.
    return own.select("source", "ordinal", F.translate(value, "\r\n", "  ").alias("value"))
