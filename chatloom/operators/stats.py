"""Counts and rankings over messages and blocks.

Every grouping here aggregates partially before its shuffle, so a chat or
sender with very many rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.text import micros_between, strip
from chatloom.operators import blocks as bl
from chatloom.operators import turns as tn

OTHERS = "Others"


def block_funnel(reviewed: DataFrame) -> DataFrame:
    """One row: chats and blocks left after each stage.

    ``reviewed`` holds all pass-1 blocks with ``verdict`` and ``outcome``.
    """
    is_kept = F.col("verdict") == bl.KEPT
    out = F.col("outcome")
    per_chat = reviewed.groupBy("chat_key").agg(
        F.count_if(is_kept).alias("kept"),
        F.count_if(F.col("verdict") == bl.SHORT).alias("short"),
        F.count_if(F.col("verdict") == bl.LONG).alias("long"),
        F.count_if(is_kept & out.isNull()).alias("valid"),
        F.count_if(is_kept & (out == tn.FEW_TURNS)).alias("few"),
        F.count_if(is_kept & (out == tn.SHORT)).alias("short_merged"),
        F.count_if(is_kept & (out == tn.LONG)).alias("long_merged"),
    )
    return per_chat.agg(
        F.count(F.lit(1)).alias("chats_built"),
        F.count_if(F.col("kept") > 0).alias("chats_kept"),
        F.count_if(F.col("kept") == 0).alias("chats_discarded"),
        _sum("kept").alias("raw_blocks"),
        _sum("short").alias("short_blocks"),
        _sum("long").alias("long_blocks"),
        _sum("few").alias("few_turn_blocks"),
        _sum("short_merged").alias("short_merged_blocks"),
        _sum("long_merged").alias("long_merged_blocks"),
        _sum("valid").alias("valid_blocks"),
    )


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def duration_micros(turns: Column) -> Column:
    """Time from the first turn after the system turn to the last turn."""
    # Single fields of the array: a Parquet scan then skips the contents.
    roles, times = turns["role"], turns["ts"]
    first = F.when(F.get(roles, F.lit(0)) == "system", 1).otherwise(0)
    return micros_between(F.get(times, first), F.try_element_at(times, F.lit(-1)))


def block_durations(valid: DataFrame) -> DataFrame:
    """Valid blocks with ``duration_minutes``."""
    return valid.withColumn("duration_minutes", duration_micros(F.col("turns")) / 6e7)


def chat_stats(reviewed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over the kept blocks of all chats, one row per ``by``; NULL without blocks."""
    is_valid = F.col("outcome").isNull()
    tokens = F.when(is_valid, F.col("n_tokens"))
    micros = F.when(is_valid, duration_micros(F.col("turns")))
    per_chat = (
        bl.kept(reviewed)
        .select(*by, "chat_key", tokens.alias("tokens"), micros.alias("micros"))
        .groupBy(*by, "chat_key")
        .agg(
            F.count("tokens").alias("blocks"),
            F.sum("tokens").alias("tokens"),
            F.min("tokens").alias("min_tokens"),
            F.max("tokens").alias("max_tokens"),
            F.sum("micros").alias("micros"),
            F.min("micros").alias("min_micros"),
            F.max("micros").alias("max_micros"),
        )
    )
    n = F.sum("blocks")
    return per_chat.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_chats"),
        F.coalesce(n, F.lit(0)).alias("num_blocks"),
        F.min("min_tokens").alias("min_tokens_per_block"),
        F.max("max_tokens").alias("max_tokens_per_block"),
        F.try_divide(F.sum("tokens"), n).alias("avg_tokens_per_block"),
        (F.min("min_micros") / 6e7).alias("min_duration_minutes_per_block"),
        (F.max("max_micros") / 6e7).alias("max_duration_minutes_per_block"),
        (F.try_divide(F.sum("micros"), n) / 6e7).alias("avg_duration_minutes_per_block"),
    )


def block_breakdown(reviewed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Valid blocks per contact, zeros included, in ``first_chat`` order.

    Of several chats with one name the last one counts.
    """
    per_chat = (
        bl.kept(reviewed)
        .groupBy(*by, "chat_key", "name")
        .agg(F.count_if(F.col("outcome").isNull()).alias("num_blocks"))
    )
    return (
        per_chat.groupBy(*by, F.col("name").alias("contact_name"))
        .agg(
            F.max_by("num_blocks", "chat_key").alias("num_blocks"),
            F.min("chat_key").alias("first_chat"),
        )
    )


def top_chats(breakdown: DataFrame, k: int = 10) -> DataFrame:
    """The k contacts with most blocks, ties in input order, with their rank."""
    # The window sees only the k rows of the limit.
    rank = F.row_number().over(Window.orderBy(F.desc("num_blocks"), "first_chat"))
    return (
        breakdown.orderBy(F.desc("num_blocks"), "first_chat")
        .limit(k)
        .withColumn("rank", rank)
    )


def top_n_others(breakdown: DataFrame, k: int = 10) -> DataFrame:
    """Top k contacts plus one row for the rest, with percent shares."""
    top = top_chats(breakdown, k).select(
        "rank", "contact_name", "num_blocks", F.lit(0).cast("bigint").alias("contacts")
    )
    everyone = breakdown.agg(
        F.lit(k + 1).alias("rank"),
        F.lit(OTHERS).alias("contact_name"),
        F.sum("num_blocks").alias("num_blocks"),
        F.count(F.lit(1)).alias("contacts"),
    )
    # The window sees k rows and the row of everyone.
    rows, is_top = Window.partitionBy(), F.col("rank") <= k
    total = F.max(F.when(~is_top, F.col("num_blocks"))).over(rows)
    in_top = F.sum(F.when(is_top, F.col("num_blocks"))).over(rows)
    return (
        top.unionByName(everyone)
        .withColumns({"total": total, "in_top": in_top})
        .filter(is_top | (F.col("contacts") > k))
        .withColumn(
            "num_blocks",
            F.when(is_top, F.col("num_blocks")).otherwise(F.col("total") - F.col("in_top")),
        )
        .select(
            "rank",
            "contact_name",
            "num_blocks",
            F.try_divide(F.lit(100.0) * F.col("num_blocks"), F.col("total")).alias(
                "share_percent"
            ),
        )
    )


def sender_ranking(raw: DataFrame) -> DataFrame:
    """Senders over all raw messages by frequency, ties by first appearance."""
    return (
        raw.filter(F.coalesce(F.col("from"), F.lit("")) != "")
        .groupBy(strip(F.col("from")).alias("sender"))
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.min(F.struct("chat_key", "pos")).alias("first_seen"),
        )
        .orderBy(F.desc("n_messages"), "first_seen")
    )
