"""Inference tables: request checks, histories and reply splitting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import strip
from chatloom.operators.ordering import (
    Ordered,
    add_row_number,
    add_running_sum,
    order_rows,
)

# Request limits.
RUN_ID = r"^[0-9a-f]{32}$"
MIN_TEMPERATURE, MAX_TEMPERATURE, DEFAULT_TEMPERATURE = 0.0, 5.0, 1.0


def prompt_text(prompt: Column, prefix: str = ">>>") -> Column:
    return F.concat(F.lit(f"{prefix} "), prompt)


def split_reply(replies: DataFrame, text: str, prefix: str = ">>>") -> DataFrame:
    """One row per message of a merged reply; blank pieces are dropped."""
    pattern = rf"(?U)\s*{re.escape(prefix)}\s*"
    pieces = F.filter(
        F.transform(F.split(F.col(text), pattern, -1), strip), lambda p: p != ""
    )
    others = [c for c in replies.columns if c != text]
    return replies.select(*others, F.posexplode(pieces).alias("part", "message"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``is_valid`` and ``reason``; a missing temperature becomes the default."""
    temperature = F.coalesce(F.col("temperature"), F.lit(DEFAULT_TEMPERATURE))
    reason = (
        F.when(~F.coalesce(F.col("run_id").rlike(RUN_ID), F.lit(False)), "run_id")
        .when(~temperature.between(MIN_TEMPERATURE, MAX_TEMPERATURE), "temperature")
        .when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "messages")
    )
    return requests.withColumns(
        {"temperature": temperature, "reason": reason, "is_valid": reason.isNull()}
    )


def rolling_history(
    turns: DataFrame, key: str, order: str, content: str, whole_rows: int
) -> Ordered:
    """Size of the history each turn sends: all turns of the conversation so far.

    The history itself is the first ``history_messages`` turns of the
    conversation, so that nothing is copied. Running totals only, linear in the turns whatever the conversation length.
    """
    rows = order_rows(turns, [key], [order], whole_rows)
    counted = add_row_number(rows, "history_messages")
    return add_running_sum(counted, F.length(content), "history_chars")


def recent_histories(
    turns: DataFrame,
    key: str,
    order: str,
    fields: Sequence[str],
    last: int,
    whole_rows: int,
    asked: Column | None = None,
) -> DataFrame:
    """The history that turns send: at most the ``last`` turns up to and including each.

    Columns ``key, order, n_earlier`` (turns left out before) and ``history``, an
    array of ``fields`` in order. ``asked`` picks the turns that get a history, all
    without it. Turns are cut into chunks of ``last`` rows, and a history lies in the
    chunk of its turn and the one before. So no row holds more than two chunks and no
    task a whole conversation, and the output grows with what is asked, not with the
    square of a conversation. ``order`` must be unique within a key; a missing key is
    a conversation of its own.
    """
    if last < 1:
        raise ValueError("last must be at least 1")
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    picked = turns.select(
        F.struct(F.col(key).alias("key")).alias("talk"),
        F.col(order).alias("at"),
        wanted.alias("wanted"),
        F.struct(*fields).alias("turn"),
    )
    numbered = add_row_number(order_rows(picked, ["talk"], ["at"], whole_rows), "number").union()
    number = F.col("number") - 1
    chunks = (
        numbered.withColumn("chunk", F.floor(number / last))
        .groupBy("talk", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("number", "at", "wanted", "turn"))).alias("rows"))
    )
    # Each chunk goes to its own number and to the next one; the pair is one group of two.
    places = F.array(
        F.struct(F.col("chunk").alias("chunk"), F.lit(True).alias("own")),
        F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(False).alias("own")),
    )
    any_wanted = F.exists("rows", lambda r: r["wanted"])
    pairs = (
        chunks.select("talk", "rows", any_wanted.alias("any_wanted"), F.explode(places).alias("place"))
        .groupBy("talk", F.col("place.chunk").alias("chunk"))
        .agg(
            F.max(F.when(F.col("place.own"), F.col("any_wanted"))).alias("any_wanted"),
            F.first(F.when(F.col("place.own"), F.col("rows")), ignorenulls=True).alias("own"),
            F.first(F.when(~F.col("place.own"), F.col("rows")), ignorenulls=True).alias("before"),
        )
        .filter("any_wanted")
    )
    both = F.concat(F.coalesce("before", F.filter("own", lambda r: F.lit(False))), F.col("own"))
    asked_rows = F.filter("own", lambda r: r["wanted"])
    row = pairs.select("talk", both.alias("both"), F.explode(asked_rows).alias("row"))
    in_reach = lambda r: (r["number"] <= F.col("row.number")) & (r["number"] > F.col("row.number") - last)
    return row.select(
        F.col("talk.key").alias(key),
        F.col("row.at").alias(order),
        F.greatest(F.col("row.number") - last, F.lit(0)).cast("bigint").alias("n_earlier"),
        F.transform(F.filter("both", in_reach), lambda r: r["turn"]).alias("history"),
    )
