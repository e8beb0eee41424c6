"""Training text: rendered records, response spans and length checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import metadata, templates
from chatloom.functions.tokens import DEFAULT_COUNTER

MAX_SEQ_LENGTH = 2048


def standardize(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "messages", templates.standardize_roles(F.col("messages"))
    )


def render_records(records: DataFrame, template: str) -> DataFrame:
    """Add ``text``: the record in a named chat template."""
    text = templates.render(F.col("messages"), templates.TEMPLATES[template])
    return records.withColumn("text", text)


def render_prompts(requests: DataFrame, template: str) -> DataFrame:
    """Add ``prompt``: the messages so far and an open assistant turn."""
    text = templates.render(
        F.col("messages"), templates.TEMPLATES[template], invite_reply=True
    )
    return requests.withColumn("prompt", text)


def add_markers(rows: DataFrame, template: str, model: str) -> DataFrame:
    """Add the instruction and response markers for the named columns."""
    instruction, response = templates.response_markers(F.col(template), F.col(model))
    return rows.withColumns(
        {"instruction_marker": instruction, "response_marker": response}
    )


def response_spans(rendered: DataFrame) -> DataFrame:
    """One row per span of rendered text, in order, with ``is_target``."""
    spans = templates.response_spans(
        F.col("text"), F.col("instruction_marker"), F.col("response_marker")
    )
    others = [c for c in rendered.columns if c != "text"]
    return rendered.select(*others, F.posexplode(spans).alias("span", "part")).select(
        *others, "span", "part.text", "part.is_target"
    )


def check_length(
    rendered: DataFrame, max_seq_length: int = MAX_SEQ_LENGTH, counter=DEFAULT_COUNTER
) -> DataFrame:
    """Add the token count of ``text`` and whether it exceeds the sequence cap."""
    return rendered.withColumn("n_text_tokens", counter.of_text(F.col("text"))).withColumn(
        "over_limit", F.col("n_text_tokens") > max_seq_length
    )


def typed_metadata(entries: DataFrame, key_prefix: str = "") -> DataFrame:
    """Add ``kind`` and one ``value_*`` column per kind to (key, value) rows.

    With a prefix only the keys that start with it are read.
    """
    if key_prefix:
        entries = entries.filter(F.col("key").startswith(key_prefix))
    value, kind = F.col("value"), F.col("kind")
    listed = entries.withColumn("value_list", metadata.listed_value(value))
    typed = listed.withColumn("kind", metadata.value_kind(value, F.col("value_list")))
    return typed.withColumns(
        {
            "value_bool": F.when(kind == "bool", F.lower(value) == "true"),
            "value_long": F.when(kind == "int", value.try_cast("bigint")),
            # Integers beyond 64 bits keep their digits.
            "value_big": F.when(
                (kind == "int") & value.try_cast("bigint").isNull(), value.try_cast("decimal(38,0)")
            ),
            "value_double": F.when(kind == "float", value.try_cast("double")),
            "value_str": F.when(kind == "str", value),
        }
    )
