"""Views of the driver tables in the shape of chats, events and run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import iso_format


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw messages, one per line of text.

    System turns have no sender, some chats have no name or a group type, some
    messages carry a sticker, and a long pause precedes turn 4.
    """
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "body")
    )
    conv, contact = F.col("conv_id"), F.concat(F.lit("contact_"), F.col("conv_id"))
    seconds = (
        conv * 86400
        + F.col("turn") * 3000
        + F.col("line")
        + F.when(F.col("turn") >= 4, 7200).otherwise(0)
    )
    sent = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    entity = lambda text: F.struct(F.lit("plain").alias("type"), text.alias("text"))
    body = F.col("body")
    return lines.select(
        conv.alias("chat_key"),
        F.when(conv % 10 != 8, contact).alias("name"),
        F.when(conv % 10 == 9, "private_group").otherwise("personal_chat").alias("type"),
        (F.col("turn") * 10000 + F.col("line")).alias("pos"),
        F.when(F.col("role") == "assistant", "Me")
        .when(F.col("role") == "user", contact)
        .alias("from"),
        iso_format(sent).alias("date"),
        F.array(
            entity(F.substring(body, 1, 10)), entity(F.substr(body, F.lit(11)))
        ).alias("text_entities"),
        F.when((conv % 7 == 3) & (F.col("line") == 0), "🙂").alias("sticker_emoji"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bare messages: a user's events are one chat."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chat_key"),
        F.col("event_id").alias("pos"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (1 + F.col("event_id") % 7).alias("n_tokens"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger of runs, one run per event."""
    kind = F.col("event_type")
    failed = kind == "error"
    return table(spark, sf_dir, "events").select(
        F.md5(F.col("event_id").cast("string")).alias("run_id"),
        F.when(F.col("event_id") % 2 == 0, "data-prep").otherwise("fine-tuning").alias("type"),
        status_of(kind).alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.when(failed, F.col("props")).alias("error"),
    )


def status_of(event_type):
    return (
        F.when(event_type == "signup", "queued")
        .when(event_type == "click", "running")
        .when(event_type == "error", "failed")
        .otherwise("completed")
    )


# Conversations that one exported document holds at most.
DOCUMENT_CONVERSATIONS = 5


def export_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chats with message arrays: a conversation is a chat, as in a JSON file."""
    raw = chat_raw(spark, sf_dir)
    message = F.struct("pos", "from", "date", "text_entities", "sticker_emoji")
    return (
        raw.groupBy("chat_key", "name", "type")
        .agg(F.array_sort(F.collect_list(message)).alias("messages"))
        .withColumn("messages", F.transform("messages", lambda m: m.dropFields("pos")))
    )


def write_exports(
    spark: SparkSession, sf_dir: str, path: str, with_bad_files: bool = False
) -> None:
    """Write chats as JSON documents of both list shapes, one document per file.

    Every fourth document can be broken, and every fourth without chats.
    """
    chat = F.struct("name", "type", "messages")
    doc = F.floor(F.col("chat_key") / DOCUMENT_CONVERSATIONS)
    listed = F.to_json("chats", {"ignoreNullFields": "false"})
    text = F.when(F.col("doc") % 2 == 0, listed).otherwise(
        F.concat(F.lit('{"about": "me", "chats": {"list": '), listed, F.lit("}}"))
    )
    if with_bad_files:
        text = (
            F.when(F.col("doc") % 4 == 3, F.concat(F.lit("{"), text))
            .when(F.col("doc") % 4 == 2, F.lit('{"other": 1}'))
            .otherwise(text)
        )
    (
        export_chats(spark, sf_dir)
        .groupBy(doc.alias("doc"))
        .agg(F.collect_list(chat).alias("chats"))
        .select("doc", text.alias("value"))
        .write.partitionBy("doc")
        .text(path)
    )


def write_chat_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write one chat per file."""
    chat = F.struct("name", "type", "messages")
    (
        export_chats(spark, sf_dir)
        .select(
            "chat_key",
            F.to_json(chat, {"ignoreNullFields": "false"}).alias("value"),
        )
        .write.partitionBy("chat_key")
        .text(path)
    )
