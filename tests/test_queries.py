"""Every registered query against its SQL on DuckDB."""

from dataclasses import replace

import pytest

import __spark_entry__ as contract
from chatloom.plans import oracle, queries
from chatloom.plans.queries import QUERIES
from compare import difference, duck

SF_DIR = "/root/testdata/sf0.01"
SQL = oracle.SQL


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    frame = contract.queries()[name](spark, SF_DIR)
    assert difference(frame, SQL[name], connection) is None


def test_entry_counts_kept_blocks(spark):
    assert contract.entry(spark).count() == 12


LOW_LIMIT = [
    "chronological", "message_gap", "time_sessions", "token_blocks", "train_blocks",
    "processed_chats", "write_run_layout", "read_train_jsonl", "chat_stats", "top_n_others",
    "sender_ranking", "queue_position", "rolling_history", "recent_history",
    "event_token_blocks", "block_funnel",
]


@pytest.mark.parametrize("name", [n for n in LOW_LIMIT if n in SQL])
def test_chat_size_limit_changes_no_output(spark, monkeypatch, name):
    """Nearly every chat takes the way of giant chats."""
    folder = "/root/testdata/sf0.001"
    low = replace(queries.CFG, whole_chat_rows=6, rows_per_segment=6)
    monkeypatch.setattr(queries, "CFG", low)
    assert difference(QUERIES[name](spark, folder), SQL[name], duck(folder)) is None
