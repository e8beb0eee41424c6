"""Greedy token blocks for chats that span several row segments.

Inside a session the block starts depend on how many tokens the open block
already holds when a segment begins. That number is unknown while the segments
are processed in parallel, so each piece of a session first reports its outcome
for every possible number (few distinct outcomes); the outcomes are chained
over the segments; then every segment finds its starts. Each segment is read
twice, and no task holds more than one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.session import land, ship_package


def long_chat_starts(messages: DataFrame, max_tokens: int) -> DataFrame:
    """Add ``block_start`` to segmented messages with sessions and sizes.

    Python sees keys, times and sizes only and returns the messages that start a
    block; every message then takes the last start before it in the JVM.
    """
    ship_package(messages.sparkSession)
    piece = ["chat_key", "session", "segment"]
    sizes = messages.select(*piece, "ts", "pos", "n_tokens")
    outcomes = sizes.groupBy("segment").applyInArrow(
        lambda rows: _edge_outcomes(rows, max_tokens), _outcome_schema(messages)
    )
    chained = (
        outcomes.repartition("chat_key", "session")
        .sortWithinPartitions(*piece, "low")
        .mapInArrow(_chain_pieces, _carried_schema(messages))
    )
    carried = land(chained, "carried")
    starts = (
        sizes.join(carried, piece, "left")
        .groupBy("segment")
        .applyInArrow(lambda rows: _mark_starts(rows, max_tokens), _start_schema(messages))
    )
    marked = starts.withColumn("block_start", F.col("pos"))
    before = Window.partitionBy(*piece).orderBy("ts", "pos")
    last_start = F.last("block_start", ignorenulls=True).over(before)
    return (
        messages.join(marked, [*piece, "pos"], "left")
        .join(carried.select(*piece, "open_start"), piece, "left")
        .withColumn("block_start", F.coalesce(last_start, F.col("open_start")))
        .drop("open_start")
    )


def _start_schema(messages: DataFrame) -> T.StructType:
    return (
        T.StructType()
        .add("chat_key", messages.schema["chat_key"].dataType)
        .add("session", T.LongType())
        .add("segment", T.IntegerType())
        .add("pos", messages.schema["pos"].dataType)
    )


def _outcome_schema(messages: DataFrame) -> T.StructType:
    key = messages.schema["chat_key"].dataType
    return (
        T.StructType()
        .add("chat_key", key)
        .add("session", T.LongType())
        .add("segment", T.IntegerType())
        # The outcome holds when the open block has low <= tokens <= high; a
        # missing high means no upper end.
        .add("low", T.LongType())
        .add("high", T.LongType())
        # Start of the block left open, missing when the piece adds none.
        .add("last_start", T.LongType())
        # Tokens of that block, or the tokens added to the block carried in.
        .add("tokens", T.LongType())
    )


def _carried_schema(messages: DataFrame) -> T.StructType:
    key = messages.schema["chat_key"].dataType
    return (
        T.StructType()
        .add("chat_key", key)
        .add("session", T.LongType())
        .add("segment", T.IntegerType())
        .add("open_tokens", T.LongType())
        .add("open_start", T.LongType())
    )


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Sorted segment with the bounds of its (chat, session) pieces."""
    rows = rows.sort_by(
        [(c, "ascending") for c in ("chat_key", "session", "ts", "pos")]
    )
    chat = rows["chat_key"].combine_chunks().dictionary_encode().indices.to_numpy()
    session = rows["session"].to_numpy()
    changes = np.flatnonzero((np.diff(chat) != 0) | (np.diff(session) != 0)) + 1
    return rows, np.concatenate([[0], changes]), np.concatenate([changes, [len(chat)]])


def next_start(sums: np.ndarray, tokens: np.ndarray, i: int, max_tokens: int) -> int:
    """Start of the block after the one that starts at ``i``."""
    fits_below = sums[i] - tokens[i] + max_tokens
    return max(i + 1, int(np.searchsorted(sums, fits_below, side="right")))


def greedy_starts(
    tokens: np.ndarray, max_tokens: int, open_tokens: int | None = None
) -> list[int]:
    """Block starts in one session piece, given the tokens of an open block."""
    sums = np.cumsum(tokens)
    i = 0
    if open_tokens is not None:
        i = int(np.searchsorted(sums, max_tokens - open_tokens, side="right"))
    starts = []
    while i < len(tokens):
        starts.append(i)
        i = next_start(sums, tokens, i, max_tokens)
    return starts


def piece_outcomes(tokens: np.ndarray, max_tokens: int) -> list[tuple]:
    """(low, high, index of the last start or None, tokens) per range of open tokens."""
    sums = np.cumsum(tokens)
    n = len(tokens)
    furthest = int(np.searchsorted(sums, max_tokens, side="right"))
    last_start_from: dict[int, int] = {}
    outcomes: list[tuple] = []
    for first in range(furthest, -1, -1):
        high = None if first == 0 else max_tokens - int(sums[first - 1])
        low = 0 if first == n else max(0, max_tokens - int(sums[first]) + 1)
        if high is not None and low > high:
            continue
        if first == n:
            outcomes.append((low, high, None, int(sums[-1])))
            continue
        path, i = [], first
        while i < n and i not in last_start_from:
            path.append(i)
            i = next_start(sums, tokens, i, max_tokens)
        last = last_start_from[i] if i < n else path[-1]
        last_start_from.update(dict.fromkeys(path, last))
        tail = int(sums[-1] - sums[last] + tokens[last])
        if outcomes and outcomes[-1][2] == last:
            outcomes[-1] = (outcomes[-1][0], high, last, tail)
        else:
            outcomes.append((low, high, last, tail))
    return outcomes


def _edge_outcomes(rows: pa.Table, max_tokens: int) -> pa.Table:
    """Outcomes of the first and the last piece; the others end inside the segment."""
    rows, begins, ends = _in_order(rows)
    tokens, pos = rows["n_tokens"].to_numpy(), rows["pos"].to_numpy()
    at, found = [], []
    for p in sorted({0, len(begins) - 1}):
        begin = int(begins[p])
        for low, high, last, total in piece_outcomes(tokens[begin : ends[p]], max_tokens):
            at.append(begin)
            found.append((low, high, None if last is None else int(pos[begin + last]), total))
    edges = rows.select(["chat_key", "session", "segment"]).take(pa.array(at, pa.int64()))
    for i, name in enumerate(("low", "high", "last_start", "tokens")):
        edges = edges.append_column(name, pa.array([f[i] for f in found], pa.int64()))
    return edges


def _chain_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the open block through the pieces of a session, in segment order.

    The state is one open block, whatever the number of pieces.
    """
    session = segment = None
    open_tokens = open_start = None  # the open block after the pieces so far
    entry_tokens = entry_start = None  # the open block at the entry of this piece
    for batch in batches:
        entries = []
        for row in batch.to_pylist():
            if session != (row["chat_key"], row["session"]):
                session, segment = (row["chat_key"], row["session"]), None
                open_tokens = open_start = None
            if segment != row["segment"]:
                segment, entry_tokens, entry_start = row["segment"], open_tokens, open_start
                if entry_tokens is not None:
                    entries.append((*session, segment, entry_tokens, entry_start))
            if _applies(row, entry_tokens):
                if row["last_start"] is None:
                    open_tokens, open_start = entry_tokens + row["tokens"], entry_start
                else:
                    open_tokens, open_start = row["tokens"], row["last_start"]
        kinds = [batch.schema.field(c).type for c in ("chat_key", "session", "segment")]
        columns = zip(*entries) if entries else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int64(), pa.int64()])],
            ["chat_key", "session", "segment", "open_tokens", "open_start"],
        )


def _applies(row: dict, entry_tokens: int | None) -> bool:
    """Whether an outcome is the one for the tokens held at the entry.

    With nothing open the first message starts a block, as it does when the open
    block is overfull: that is the outcome without upper end.
    """
    if entry_tokens is None:
        return row["high"] is None
    return row["low"] <= entry_tokens and (
        row["high"] is None or entry_tokens <= row["high"]
    )


def _mark_starts(rows: pa.Table, max_tokens: int) -> pa.Table:
    """The messages of a segment that start a block."""
    rows, begins, ends = _in_order(rows)
    tokens = rows["n_tokens"].to_numpy()
    open_tokens = rows["open_tokens"].take(begins).to_pylist()
    at = [
        int(begin) + start
        for begin, end, held in zip(begins, ends, open_tokens)
        for start in greedy_starts(tokens[begin:end], max_tokens, held)
    ]
    return rows.select(["chat_key", "session", "segment", "pos"]).take(pa.array(at, pa.int64()))
