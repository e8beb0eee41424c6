"""Read messenger exports: JSON documents that hold one or many chats.

A document is a list of chats, an object with ``chats.list``, or one chat. Files
of ordinary size are one row each; ``sources.split`` reads larger ones with the
same result. A document is taken apart level by level as JSON text (chats, then messages), which keeps every field and has
no limit but that of a string; only single messages become VARIANT values.
Everything after the first explode is spread by chat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.schema import ENTITY

OK, UNPARSEABLE, NO_CHATS = "ok", "unparseable", "no valid chats"

# Larger documents are read in byte ranges (``sources.split``).
WHOLE_BYTES = 256 << 20

TEXTS = "array<string>"


def read_documents(spark: SparkSession, path: str, glob: str | None = None, up_to: int = WHOLE_BYTES) -> DataFrame:
    """One row per file of at most ``up_to`` bytes below ``path``: ``source`` and ``document`` text."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = (
        # As an argument: the method's default replaces an option of the reader.
        reader.text(path, wholetext=True)
        .filter(F.col("_metadata.file_size") <= up_to)
        .select(F.col("_metadata.file_path").alias("source"), "value")
    )
    return parse_documents(files)


def has_larger_files(spark: SparkSession, path: str, glob: str | None = None, above: int = WHOLE_BYTES) -> bool:
    """Whether any file exceeds ``above`` bytes; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return not reader.load(path).filter(F.col("length") > above).select("path").isEmpty()


def parse_documents(files: DataFrame) -> DataFrame:
    """Rename ``value`` to ``document``; what it holds is found by ``with_chats``."""
    others = [c for c in files.columns if c != "value"]
    return files.select(*others, F.col("value").alias("document"))


def _first_letter(text: Column) -> Column:
    """The first letter after the blanks of JSON."""
    letter = lambda x: F.substring(F.ltrim(x, F.lit(" \t\r\n")), 1, 1)
    near = letter(F.substring(text, 1, 1000))
    # Only a text that begins with more blanks is copied whole.
    return F.when(near != "", near).otherwise(letter(text))


def is_chat(text: Column) -> Column:
    """Whether a JSON text is an object with the keys of a chat."""
    keys = F.json_object_keys(text)
    has = lambda key: F.coalesce(F.array_contains(keys, key), F.lit(False))
    return has("name") & has("messages")


def is_value(text: Column) -> Column:
    """Whether a text is exactly one JSON value."""
    return F.coalesce(F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), TEXTS)) == 1, F.lit(False))


def _compact(text: Column) -> Column:
    """The JSON text without layout, NULL when it is broken."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), TEXTS)[0]


def is_readable(document: Column) -> Column:
    """Whether the text is one JSON value."""
    first = _first_letter(document)
    return (
        F.when(first == "[", F.from_json(document, TEXTS).isNotNull())
        .when(first == "{", F.json_object_keys(document).isNotNull())
        .otherwise(F.try_parse_json(document).isNotNull())
    )


def with_chats(documents: DataFrame) -> DataFrame:
    """Add ``chats``: JSON texts of the chats of each document, NULL when unreadable.

    Lists and single chats need the keys ``name`` and ``messages``; the list
    inside an export object is taken as it is.
    """
    doc = F.col("document")
    first = _first_letter(doc)
    none = F.array().cast(TEXTS)
    exported = F.from_json(doc, "chats struct<list: array<string>>")["chats"]["list"]
    in_object = F.coalesce(
        exported, F.when(is_chat(doc), F.array(_compact(doc))), F.when(is_readable(doc), none)
    )
    chats = (
        F.when(first == "[", F.filter(F.from_json(doc, TEXTS), is_chat))
        .when(first == "{", in_object)
        .when(is_readable(doc), none)
    )
    return documents.withColumn("chats", chats)


def export_file_report(documents: DataFrame) -> DataFrame:
    """Verdict and number of chats per file."""
    others = [c for c in documents.columns if c not in ("document", "chats")]
    sized = with_chats(documents).select(*others, F.size("chats").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(-1))  # NULL has size -1 or NULL
    status = F.when(n < 0, UNPARSEABLE).when(n == 0, NO_CHATS).otherwise(OK)
    return sized.select(
        *others, status.alias("status"), F.greatest(n, F.lit(0)).alias("n_chats")
    )


def read_exports(documents: DataFrame) -> DataFrame:
    """One row per chat of all readable documents.

    Columns: those of the files, ``chat_key`` (source and ordinal, sorts in
    input order), ``name``, ``type`` and the whole ``chat`` as JSON text.
    """
    others = [c for c in documents.columns if c not in ("document", "chats")]
    chats = with_chats(documents).select(
        *others, F.posexplode("chats").alias("ordinal", "chat")
    )
    key = F.format_string("%s#%09d", F.col("source"), F.col("ordinal"))
    return _named(chats, [c for c in others if c != "source"], key)


def read_export_dir(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One chat per matching file, keyed in name order; broken files are left out.

    ``dir_file_report`` tells of those.
    """
    return single_chats(read_documents(spark, path, glob=glob))


def single_chats(documents: DataFrame) -> DataFrame:
    chats = documents.select("source", _compact(F.col("document")).alias("chat"))
    return _named(chats.filter("chat is not null"), [], F.col("source"))


def dir_file_report(documents: DataFrame) -> DataFrame:
    """Verdict per file of a directory with one chat in each."""
    readable = is_value(F.col("document"))
    return documents.select(
        "source", F.when(readable, OK).otherwise(UNPARSEABLE).alias("status"), readable.cast("int").alias("n_chats")
    )


def _named(chats: DataFrame, others: list[str], key: Column) -> DataFrame:
    head = F.from_json("chat", "name string, type string")
    return chats.select(
        *others, key.alias("chat_key"), F.inline(F.array(head)), "chat"
    ).select(*others, "chat_key", "name", "type", "chat")


def n_messages(chat: str) -> Column:
    """Number of messages of a chat, -1 or NULL without a list of messages."""
    return F.size(F.from_json(chat, "messages array<string>")["messages"])


def export_messages(chats: DataFrame) -> DataFrame:
    """One row per message of chat texts, read field by field.

    A field of the wrong kind becomes NULL in its own message only.
    """
    others = [c for c in chats.columns if c != "chat"]
    texts = chats.select(
        *others,
        F.posexplode(F.from_json("chat", "messages array<string>")["messages"]).alias("pos", "text"),
    )
    return message_fields(texts)


def message_fields(texts: DataFrame) -> DataFrame:
    """The fields of messages given as JSON ``text`` beside ``pos`` and other columns."""
    others = [c for c in texts.columns if c not in ("pos", "text")]
    messages = texts.select(*others, "pos", F.try_parse_json("text").alias("message"))
    given = F.try_variant_get("message", "$.text_entities", "variant")
    entities = F.try_variant_get("message", "$.text_entities", f"array<{ENTITY.simpleString()}>")
    # Malformed entities lose the whole message, a sticker included.
    malformed = given.isNotNull() & ~F.is_variant_null(given) & entities.isNull()
    return messages.select(
        *others,
        F.col("pos").cast("bigint").alias("pos"),
        _text("message", "from").alias("from"),
        _text("message", "date").alias("date"),
        entities.alias("text_entities"),
        F.when(~F.coalesce(malformed, F.lit(False)), _text("message", "sticker_emoji")).alias(
            "sticker_emoji"
        ),
    )


def _text(variant: str, key: str) -> Column:
    return F.try_variant_get(variant, f"$.{key}", "string")
