"""Cut ordered messages into time sessions and token-bounded blocks.

Pass 1: a gap above the threshold starts a new session; inside a session a
message joins the open block while the token sum stays within the maximum.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import arrays
from chatloom.functions.text import micros_between
from chatloom.operators.messages import entity_texts
from chatloom.operators.ordering import (
    Ordered,
    add_previous,
    add_running_sum,
    order_rows,
)
from chatloom.operators.segments import long_chat_starts

# Columns that are the same for all messages of a chat.
CHAT_COLUMNS = ("run_id", "chat_key", "name", "type")
# Message columns that a block keeps; time and position come first, so that
# sorting the structs restores the message order.
MESSAGE_COLUMNS = ("ts", "pos", "role", "content", "n_tokens")

KEPT, SHORT, LONG = "kept", "short", "long"


def chronological(
    messages: DataFrame,
    whole_rows: int,
    segment_rows: int | None = None,
    counted: DataFrame | None = None,
    whole_chars: int | None = None,
) -> Ordered:
    """Messages in time order per chat; equal times keep the source order.

    ``counted`` may give a superset of the messages that is cheaper to count.
    Chats with more than ``whole_chars`` characters of text are heavy too.
    """
    keys, order = ["chat_key"], ["ts", "pos"]
    weight = None
    if whole_chars is not None and "text_entities" in (messages if counted is None else counted).columns:
        texts = F.transform(entity_texts(), F.length)
        weight = F.aggregate(F.coalesce(texts, F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return order_rows(messages, keys, order, whole_rows, segment_rows, counted, weight, whole_chars)


def message_gap(rows: Ordered) -> Ordered:
    """Add the seconds since the previous message of the chat."""
    micros = micros_between(F.col("prev_ts"), F.col("ts"))
    return add_previous(rows, "ts", "prev_ts").map(
        lambda df: df.withColumn("gap_seconds", micros / 1e6)
    )


def time_sessions(rows: Ordered, gap_seconds: int) -> Ordered:
    """Number the sessions of a chat from 0; a gap equal to the limit continues."""
    gap, longest = F.col("ts") - F.col("prev_ts"), F.lit(timedelta(seconds=gap_seconds))
    opens = F.when(gap <= longest, 0).otherwise(1)
    counted = add_running_sum(add_previous(rows, "ts", "prev_ts"), opens, "session")
    return counted.map(
        lambda df: df.withColumn("session", F.col("session") - 1).drop("prev_ts")
    )


def token_blocks(rows: Ordered, gap_seconds: int, max_tokens: int) -> DataFrame:
    """One row per block with its ordered messages.

    Columns: chat columns, ``session``, ``block_start`` (position of the first
    message, which identifies the block within its chat), ``messages``, ``n_tokens``.
    """
    blocks = _blocks_of_whole_chats(rows.light, gap_seconds, max_tokens)
    if rows.heavy is not None:
        sessions = time_sessions(rows, gap_seconds)
        starts = long_chat_starts(sessions.heavy, max_tokens)
        blocks = blocks.unionByName(_blocks_by_start(starts))
    return blocks.withColumn("n_tokens", arrays.total(F.col("messages"), "n_tokens"))


def _blocks_of_whole_chats(
    messages: DataFrame, gap_seconds: int, max_tokens: int
) -> DataFrame:
    """Light chats: one shuffle collects a chat, one fold finds all its blocks.

    This needs neither windows nor further sorts; the row limit of light chats
    bounds the arrays.
    """
    chat = _present(messages, CHAT_COLUMNS)
    collected = messages.groupBy(*chat).agg(_ordered_messages(messages))
    starts = arrays.block_starts(F.col("messages"), gap_seconds, max_tokens)
    blocks = collected.withColumn("starts", starts).select(
        *chat, F.inline(arrays.cut_blocks(F.col("messages"), F.col("starts")))
    )
    return blocks.select(
        *chat,
        "session",
        F.col("messages")[0]["pos"].alias("block_start"),
        "messages",
    )


def _blocks_by_start(messages: DataFrame) -> DataFrame:
    """Heavy chats: the block of each message is known, its size is bounded."""
    chat = _present(messages, CHAT_COLUMNS)
    return messages.groupBy(*chat, "session", "block_start").agg(_ordered_messages(messages))


def _ordered_messages(messages: DataFrame):
    fields = _present(messages, MESSAGE_COLUMNS)
    return F.array_sort(F.collect_list(F.struct(*fields))).alias("messages")


def _present(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [name for name in names if name in df.columns]


def with_verdict(blocks: DataFrame, min_tokens: int, max_tokens: int) -> DataFrame:
    """Classify blocks by token sum; both limits are inclusive."""
    verdict = (
        F.when(F.col("n_tokens") < min_tokens, SHORT)
        .when(F.col("n_tokens") > max_tokens, LONG)
        .otherwise(KEPT)
    )
    return blocks.withColumn("verdict", verdict)


def kept(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("verdict") == KEPT)


def kept_chats(blocks: DataFrame) -> DataFrame:
    """Chats with at least one block inside the token limits."""
    return kept(blocks).select(*_present(blocks, CHAT_COLUMNS)).distinct()
