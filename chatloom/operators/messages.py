"""From raw chats to usable messages: one row per message.

Raw message columns: ``chat_key, name, type, pos, from, date, text_entities,
sticker_emoji``; ``pos`` is the position of the message in its chat.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import PrepConfig
from chatloom.functions import text as tx
from chatloom.functions.arrays import add_once
from chatloom.functions.tokens import DEFAULT_COUNTER


def flatten_messages(chats: DataFrame) -> DataFrame:
    """One row per message in source order from chats with a message array."""
    others = [c for c in chats.columns if c != "messages"]
    return chats.select(
        *others, F.posexplode("messages").alias("pos", "message")
    ).select(*others, F.col("pos").cast("bigint").alias("pos"), "message.*")


def has_name() -> Column:
    return tx.is_given(F.col("name"))


def has_type(chat_types: tuple[str, ...]) -> Column:
    return F.col("type").isin(*chat_types)


def has_sender() -> Column:
    return tx.is_given(F.col("from"))


def entity_texts() -> Column:
    """The texts alone, so that a Parquet scan reads nothing else of the entities."""
    return F.col("text_entities")["text"]


def has_text() -> Column:
    """Entities or a sticker: bare media and service notes have neither."""
    entities = F.coalesce(F.array_size(entity_texts()), F.lit(0))
    return (entities > 0) | tx.is_given(F.col("sticker_emoji"))


def named_chats(raw: DataFrame) -> DataFrame:
    return raw.filter(has_name())


def chats_of_type(raw: DataFrame, chat_types: tuple[str, ...]) -> DataFrame:
    return raw.filter(has_type(chat_types))


def eligible_messages(raw: DataFrame) -> DataFrame:
    return raw.filter(has_sender() & has_text())


def since(messages: DataFrame, limit: datetime | None) -> DataFrame:
    """Keep messages at or after the limit."""
    if limit is None:
        return messages
    return messages.filter(F.col("ts") >= _wall_clock(limit))


def _wall_clock(moment: datetime) -> Column:
    """Literal that no session or process time zone shifts."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def nonempty(messages: DataFrame) -> DataFrame:
    return messages.filter(F.length("content") > 0)


def role_of(sender: Column, target: str, trim_sender: bool = False) -> Column:
    if trim_sender:
        sender, target = tx.strip(sender), target.strip()
    return F.when(sender == target, "assistant").otherwise("user")


def effective_date_limit(text: Column, now: Column) -> Column:
    """The limit as a timestamp; NULL when empty, invalid or after ``now``."""
    limit = tx.parse_timestamp(text)
    return F.when(limit <= now, limit)


def read_fields(raw: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Add ``role``, ``content`` and ``ts`` to raw messages."""
    content = tx.normalize_text(
        tx.message_text(F.col("text_entities"), F.col("sticker_emoji"))
    )
    ts = F.col("ts") if "ts" in raw.columns else tx.parse_timestamp(F.col("date"))
    return raw.withColumns(
        {
            "role": role_of(F.col("from"), cfg.target_name, cfg.trim_sender),
            "content": content,
            "ts": ts,
        }
    )


def lacks_entity_text() -> Column:
    broken = F.exists(entity_texts(), lambda text: text.isNull())
    return F.coalesce(broken, F.lit(False))


def candidates(raw: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Superset of the usable messages that is decided without reading texts."""
    return chats_of_type(named_chats(raw), cfg.chat_types).filter(has_sender())


def usable_messages(raw: DataFrame, cfg: PrepConfig, counter=DEFAULT_COUNTER) -> DataFrame:
    """Messages that take part in blocks, with role, content, time and size.

    Plain conjunctive filters come first, so a Parquet scan receives them, and
    texts are sized only for messages that survive.
    """
    raw = eligible_messages(candidates(raw, cfg)).filter(~lacks_entity_text())
    messages = read_fields(raw, cfg)
    messages = since(messages.filter(F.col("ts").isNotNull()), cfg.since)
    messages = nonempty(add_once(messages, "content", F.col("content")))
    return messages.select(
        *[c for c in ("run_id", "chat_key") if c in messages.columns],
        "name",
        "type",
        "pos",
        "ts",
        "role",
        "content",
        counter.of_text(F.col("content")).alias("n_tokens"),
    )


def quarantine(raw: DataFrame, cfg: PrepConfig) -> DataFrame:
    """Messages that are left out, with the first reason that applies."""
    limit = cfg.since
    reason = (
        F.when(~has_name(), "chat without name")
        .when(~F.coalesce(has_type(cfg.chat_types), F.lit(False)), "chat type")
        .when(~has_sender(), "no sender")
        .when(~has_text(), "no text or sticker")
        .when(lacks_entity_text(), "entity without text")
        .when(F.col("ts").isNull(), "bad date")
    )
    if limit is not None:
        reason = reason.when(
            F.col("ts") < _wall_clock(limit), "before date limit"
        )
    reason = reason.when(F.length("content") == 0, "empty content")
    return (
        read_fields(raw, cfg)
        .withColumn("reject_reason", reason)
        .filter(F.col("reject_reason").isNotNull())
    )
