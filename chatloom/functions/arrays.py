"""Array expressions for cutting ordered lists into runs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(items: Column, starts: Column) -> Column:
    """Slice ``items`` at the given 0-based start positions."""
    return F.transform(
        starts,
        lambda start, i: F.slice(
            items,
            start + 1,
            F.coalesce(F.get(starts, i + 1), F.size(items)) - start,
        ),
    )


def run_starts(items: Column, field: str) -> Column:
    """0-based positions where ``field`` differs from the element before."""
    marked = F.transform(
        items,
        lambda item, i: F.when(
            (i == 0) | (item[field] != F.get(items, i - 1)[field]), i
        ),
    )
    return F.filter(marked, lambda i: i.isNotNull())


# Starts are gathered in lists of this length, since appending copies a list.
STARTS_PER_LIST = 256


def block_starts(messages: Column, gap_seconds: int, max_tokens: int) -> Column:
    """Starts of sessions and token-bounded blocks in the messages of one chat.

    Gives ``array<struct<at, session>>``: 0-based position of each block's first
    message and the number of its session. A message joins the open block when it
    follows within the gap and the token sum stays within the maximum.
    """
    longest = F.lit(timedelta(seconds=gap_seconds))
    start_type = "struct<at:int,session:bigint>"
    opened = F.struct(
        F.lit(None).cast("timestamp_ntz").alias("last"),
        F.lit(0).cast("bigint").alias("held"),
        F.lit(0).alias("seen"),
        F.lit(-1).cast("bigint").alias("session"),
        F.array().cast(f"array<array<{start_type}>>").alias("full"),
        F.array().cast(f"array<{start_type}>").alias("recent"),
    )

    def step(acc: Column, m: Column) -> Column:
        close = F.coalesce(m["ts"] - acc["last"] <= longest, F.lit(False))
        fits = close & (acc["held"] + m["n_tokens"] <= max_tokens)
        session = F.when(close, acc["session"]).otherwise(acc["session"] + 1)
        start = F.struct(acc["seen"].alias("at"), session.alias("session"))
        is_full = F.size(acc["recent"]) >= STARTS_PER_LIST
        return F.struct(
            m["ts"].alias("last"),
            F.when(fits, acc["held"] + m["n_tokens"]).otherwise(m["n_tokens"]).alias("held"),
            (acc["seen"] + 1).alias("seen"),
            session.alias("session"),
            F.when(~fits & is_full, F.array_append(acc["full"], acc["recent"]))
            .otherwise(acc["full"])
            .alias("full"),
            F.when(fits, acc["recent"])
            .when(is_full, F.array(start))
            .otherwise(F.array_append(acc["recent"], start))
            .alias("recent"),
        )

    def finish(acc: Column) -> Column:
        return F.flatten(F.array_append(acc["full"], acc["recent"]))

    return F.aggregate(messages, opened, step, finish)


def cut_blocks(messages: Column, starts: Column) -> Column:
    """``array<struct<session, messages>>`` for the starts of ``block_starts``."""
    return F.transform(
        starts,
        lambda start, i: F.struct(
            start["session"].alias("session"),
            F.slice(
                messages,
                start["at"] + 1,
                F.coalesce(F.get(starts, i + 1)["at"], F.size(messages)) - start["at"],
            ).alias("messages"),
        ),
    )


def total(items: Column, field: str) -> Column:
    """Sum of an integer field over an array of structs."""
    return F.aggregate(
        items, F.lit(0).cast("bigint"), lambda acc, item: acc + item[field]
    )


def add_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a costly column so that it is evaluated once per row.

    A filter on a plain column is pushed below it with a copy of its expression;
    it cannot pass a generator.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.inline(F.array(F.struct(value.alias(name)))))
