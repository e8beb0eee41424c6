"""Sessions and token blocks against the sequential model, light and segmented."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.operators import blocks as bl
from chatloom.operators.segments import greedy_starts, piece_outcomes
from models import MESSAGE, message, sequential_blocks


def spark_blocks(spark, rows, gap, max_tokens, rows_per_segment):
    frame = spark.createDataFrame(rows, MESSAGE)
    ordered = bl.chronological(frame, rows_per_segment)
    blocks = bl.token_blocks(ordered, gap, max_tokens)
    found = blocks.select(
        "chat_key", "session", "block_start", F.explode("messages.pos").alias("pos")
    ).collect()
    assert len(found) == len(rows)
    return {(r.chat_key, r.pos): (r.session, r.block_start) for r in found}, ordered


def random_chats(seed):
    """Chats with ties, gaps at the limit, oversize messages and one giant session."""
    rng = random.Random(seed)
    rows = []
    for chat in range(5):
        seconds = 0.0
        steps = [0, 1, 2] if chat == 0 else [0, 0, 1, 5, 10, 10.000001, 11, 60]
        positions = list(range(300 if chat == 0 else rng.choice([1, 20, 150])))
        for pos in positions:
            seconds += rng.choice(steps)
            rows.append(message(chat, pos, seconds, rng.choice([0, 1, 2, 3, 8, 30, 31])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rows_per_segment", [10_000, 80, 9])
def test_blocks_equal_sequential_model(spark, seed, rows_per_segment):
    rows = random_chats(seed)
    found, ordered = spark_blocks(spark, rows, 10, 30, rows_per_segment)
    assert (ordered.heavy is None) == (rows_per_segment == 10_000)
    assert found == sequential_blocks(rows, 10, 30)


def test_equal_times_and_one_token_messages_in_one_hot_chat(spark):
    rows = [message(1, pos, 0, 1) for pos in range(200)]
    found, ordered = spark_blocks(spark, rows, 10, 30, 20)
    assert ordered.heavy.select("segment").distinct().count() > 5
    assert found == sequential_blocks(rows, 10, 30)


def test_many_blocks_in_one_chat(spark):
    rows = [message(1, pos, pos, 31 if pos % 3 else 1) for pos in range(1500)]
    found, ordered = spark_blocks(spark, rows, 10, 30, 10_000)
    assert ordered.heavy is None
    assert found == sequential_blocks(rows, 10, 30)


def test_documented_edges(spark):
    rows = [
        message(1, 0, 0, 5),
        message(1, 1, 10, 5),  # gap equal to the limit continues
        message(1, 2, 20.000001, 5),  # one microsecond more does not
        message(2, 0, 0, 31),  # oversize: a block of its own
        message(2, 1, 1, 0),  # the next message starts fresh
        message(3, 0, 0, 10),
        message(3, 1, 1, 20),  # sum equal to the maximum
    ]
    found, _ = spark_blocks(spark, rows, 10, 30, 1000)
    assert found == {
        (1, 0): (0, 0), (1, 1): (0, 0), (1, 2): (1, 2),
        (2, 0): (0, 0), (2, 1): (0, 1),
        (3, 0): (0, 0), (3, 1): (0, 0),
    }


@pytest.mark.parametrize("rows_per_segment", [10_000, 30])
def test_sessions_of_windows_and_blocks_agree(spark, rows_per_segment):
    rows = random_chats(3)
    ordered = bl.chronological(spark.createDataFrame(rows, MESSAGE), rows_per_segment)
    found = bl.time_sessions(ordered, 10).union().collect()
    model = sequential_blocks(rows, 10, 30)
    assert {(r.chat_key, r.pos): r.session for r in found} == {k: v[0] for k, v in model.items()}


def test_verdict_limits_are_inclusive(spark):
    sizes = [(0, 9), (1, 10), (2, 30), (3, 31)]
    frame = spark.createDataFrame(sizes, "i int, n_tokens bigint")
    verdicts = [r.verdict for r in bl.with_verdict(frame, 10, 30).orderBy("i").collect()]
    assert verdicts == ["short", "kept", "kept", "long"]


def test_no_messages(spark):
    frame = spark.createDataFrame([], MESSAGE)
    assert bl.token_blocks(bl.chronological(frame, 100), 10, 30).count() == 0


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.integers(0, 12), min_size=1, max_size=60),
    st.integers(1, 15),
    st.one_of(st.none(), st.integers(0, 20)),
)
def test_piece_outcomes_cover_every_entry(tokens, limit, entry):
    """The outcome chosen for an entry equals following the entry step by step."""
    tokens = np.array(tokens)
    starts = greedy_starts(tokens, limit, entry)
    applying = [
        o
        for o in piece_outcomes(tokens, limit)
        if (o[1] is None if entry is None else o[0] <= entry and (o[1] is None or entry <= o[1]))
    ]
    assert len(applying) == 1
    _, _, last, held = applying[0]
    assert last == (starts[-1] if starts else None)
    assert held == int(tokens[starts[-1] :].sum() if starts else tokens.sum())
