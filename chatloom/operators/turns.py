"""Pass 2: merge a block's messages into turns, trim, size and validate them.

All steps are array expressions on one row per block, so none of them shuffles.
A turn is ``struct<role, content, ts>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import PrepConfig
from chatloom.functions import arrays
from chatloom.functions.text import strip
from chatloom.functions.tokens import DEFAULT_COUNTER

FEW_TURNS, SHORT, LONG = "few turns", "short", "long"


def role_runs(blocks: DataFrame) -> DataFrame:
    """Add ``runs``: the messages grouped into runs of one role."""
    return blocks.withColumn(
        "run_starts", arrays.run_starts(F.col("messages"), "role")
    ).withColumn("runs", arrays.cut(F.col("messages"), F.col("run_starts")))


def merge_runs(blocks: DataFrame, prefix: str) -> DataFrame:
    """Replace messages by turns: prefixed lines, time of the first message."""

    def merged(run: Column) -> Column:
        lines = F.transform(run, lambda m: F.concat(F.lit(f"{prefix} "), m["content"]))
        text = F.array_join(lines, "\n")
        return F.struct(
            run[0]["role"].alias("role"),
            # Only an empty prefix leaves whitespace at an end.
            (text if prefix else strip(text)).alias("content"),
            run[0]["ts"].alias("ts"),
        )

    return (
        role_runs(blocks)
        .withColumn("turns", F.transform("runs", merged))
        .drop("messages", "run_starts", "runs")
    )


def trim_ends(blocks: DataFrame) -> DataFrame:
    """Drop assistant turns at the start and user turns at the end."""
    roles = F.transform("turns", lambda t: t["role"])
    first = F.array_position(F.transform(roles, lambda r: r == "user"), True)
    from_end = F.array_position(
        F.reverse(F.transform(roles, lambda r: r == "assistant")), True
    )
    last = F.size("turns") - from_end + 1
    inside = (first > 0) & (from_end > 0) & (last >= first)
    return blocks.withColumn(
        "turns",
        F.when(
            inside,
            F.slice("turns", first.cast("int"), (last - first + 1).cast("int")),
        ).otherwise(F.slice("turns", 1, 0)),
    )


def prepend_system(blocks: DataFrame, system_text: str | None) -> DataFrame:
    """Put a system turn without time in front of every block."""
    if system_text is None:
        return blocks
    turn = F.struct(
        F.lit("system").alias("role"),
        F.lit(system_text).alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )
    return blocks.withColumn("turns", F.concat(F.array(turn), F.col("turns")))


def turn_tokens(blocks: DataFrame, counter=DEFAULT_COUNTER) -> DataFrame:
    """Add ``n_tokens`` of the merged text."""
    sizes = counter.of_texts(F.transform("turns", lambda t: t["content"]))
    summed = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return arrays.add_once(blocks, "n_tokens", summed)


def violation(turns: Column) -> Column:
    """First broken rule of the block structure, NULL for a valid block.

    A block is an optional system turn, then user and assistant turns in strict
    alternation, starting with user and ending with assistant.
    """
    n = F.size(turns)
    skip = F.when(turns[0]["role"] == "system", 1).otherwise(0)
    body = F.slice(turns, skip + 1, F.greatest(n - skip, F.lit(0)))
    alternates = F.forall(
        F.transform(
            body,
            lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"),
        ),
        lambda ok: ok,
    )
    return (
        F.when(n == 0, "empty block")
        .when(n == skip, "only a system turn")
        .when(F.get(turns, skip)["role"] != "user", "first turn is not user")
        .when(~alternates, "roles do not alternate")
        .when(F.element_at(turns, -1)["role"] != "assistant", "last turn is not assistant")
    )


def reviewed_blocks(
    kept_blocks: DataFrame, cfg: PrepConfig, counter=DEFAULT_COUNTER
) -> DataFrame:
    """Run pass 2 on kept blocks and add ``outcome``.

    ``outcome`` is NULL for a valid block, else why it is left out; the checks
    apply in the order turns, tokens, structure.
    """
    low, high = cfg.token_limits
    fewest = 2 if cfg.system_text is None else 3
    turns = prepend_system(
        trim_ends(merge_runs(kept_blocks, cfg.line_prefix)), cfg.system_text
    )
    outcome = (
        F.when(F.size("turns") < fewest, FEW_TURNS)
        .when(F.col("n_tokens") < low, SHORT)
        .when(F.col("n_tokens") > high, LONG)
        .otherwise(violation(F.col("turns")))
    )
    turns = arrays.add_once(turns, "turns", F.col("turns"))
    return turn_tokens(turns, counter).withColumn("outcome", outcome)


def valid_blocks(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("outcome").isNull()).drop("outcome")


def training_records(valid: DataFrame) -> DataFrame:
    """One record per block: its turns with role and content only."""
    others = [c for c in valid.columns if c != "turns"]
    messages = F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    return valid.select(*others, messages.alias("messages"))
