"""Documented rules of the message, block and statistics steps."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatloom.config import PrepConfig, parse_date_limit
from chatloom.functions import text as tx
from chatloom.operators import blocks as bl
from chatloom.operators import messages, stats
from chatloom.operators import turns as tn
from chatloom.plans.prepare import prepare_chats
from chatloom.sinks import runs

RAW = (
    "chat_key bigint, name string, type string, pos bigint, `from` string, date string,"
    " text_entities array<struct<type:string,text:string>>, sticker_emoji string"
)
NOW = datetime(2024, 6, 1)


def raw(spark, *rows):
    """(chat, sender, date, text[, sticker]) to raw messages; names are c<chat>."""
    full = []
    for pos, (chat, sender, date, text, *sticker) in enumerate(rows):
        entities = [("plain", t) for t in ([text] if not isinstance(text, list) else text)]
        full.append(
            (chat, f"c{chat}", "personal_chat", pos, sender, date, entities,
             sticker[0] if sticker else None)
        )
    return spark.createDataFrame(full, RAW)


def usable(spark, *rows, **options):
    frame = messages.usable_messages(raw(spark, *rows), PrepConfig("Me", now=NOW, **options))
    return frame.orderBy("pos").collect()


def valid_turns(spark, *rows, **options):
    cfg = PrepConfig("Me", **{"min_tokens": 0, "max_tokens": 500, **options})
    reviewed = prepare_chats(raw(spark, *rows), cfg)
    blocks = tn.valid_blocks(bl.kept(reviewed)).orderBy("chat_key", "block_start")
    return [[(t.role, t.content) for t in b.turns] for b in blocks.collect()]


def at(minute, second=0):
    return f"2024-01-01T10:{minute:02d}:{second:02d}"


def test_content_is_stripped_before_newlines_become_spaces(spark):
    (row,) = usable(spark, (1, "A", at(0), "\n \xa0 a \n b　\n"))
    assert row.content == "a   b"


def test_entities_are_concatenated_and_the_sticker_follows(spark):
    (row,) = usable(spark, (1, "A", at(0), ["Hi", " you"], "🙂"))
    assert row.content == "Hi you🙂"


def test_broken_messages_are_dropped_one_by_one(spark):
    rows = usable(
        spark,
        (1, "A", "not a date", "x"),
        (1, "A", None, "x"),
        (1, "A", at(0), ["x", None]),
        (1, "A", at(0), " \xa0 \n"),
        (1, "", at(0), "x"),
        (1, None, at(0), "x"),
        (1, "A", at(0), []),
        (1, "A", at(0), [], "🙂"),
        (1, "A", "2024-01-01", "date only"),
    )
    assert [r.content for r in rows] == ["🙂", "date only"]
    assert rows[1].ts == datetime(2024, 1, 1)


def test_quarantine_complements_usable_messages(spark):
    frame = raw(spark, (1, "A", at(0), "x"), (1, "A", "?", "x"), (1, None, at(0), "x"))
    rejected = messages.quarantine(frame, PrepConfig("Me", now=NOW)).orderBy("pos").collect()
    assert [r.reject_reason for r in rejected] == ["bad date", "no sender"]


def test_role_match_is_exact_unless_trimming_is_asked_for(spark):
    rows = [(1, "Me", at(0), "x"), (1, "Me ", at(1), "x"), (1, "me", at(2), "x")]
    assert [r.role for r in usable(spark, *rows)] == ["assistant", "user", "user"]
    trimmed = usable(spark, *rows, trim_sender=True)
    assert [r.role for r in trimmed] == ["assistant", "assistant", "user"]


@pytest.mark.parametrize(
    "limit, kept",
    [
        ("2024-01-01T10:01:00", 2),  # equality stays
        ("2024-01-01 10:01:01", 1),
        ("2030-01-01", 3),  # future: no limit
        ("None", 3),  # invalid: no limit
        ("", 3),
    ],
)
def test_date_limit(spark, limit, kept):
    rows = [(1, "A", at(m), "x") for m in range(3)]
    assert len(usable(spark, *rows, date_limit=limit)) == kept


def test_date_limit_parsing():
    assert parse_date_limit("2024-05-01", NOW) == datetime(2024, 5, 1)
    assert parse_date_limit("2024-06-01", NOW) == NOW
    assert parse_date_limit("2024-06-01T00:00:01", NOW) is None
    assert parse_date_limit(None, NOW) is None


def test_limits_reset_and_defaults():
    assert PrepConfig("Me").token_limits == (300, 800)
    assert PrepConfig("Me").gap_seconds == 3600
    assert PrepConfig("Me", min_tokens=9, max_tokens=9).token_limits == (100, 3000)
    with pytest.raises(ValueError):
        PrepConfig("Me", chat_types=("channel",))


def test_equal_times_keep_the_source_order(spark):
    turns = valid_turns(
        spark, (1, "A", at(0), "one"), (1, "A", at(0), "two"), (1, "Me", at(0), "three")
    )
    assert turns == [[("user", ">>> one\n>>> two"), ("assistant", ">>> three")]]


def test_messages_are_sorted_by_time(spark):
    turns = valid_turns(spark, (1, "Me", at(5), "late"), (1, "A", at(1), "early"))
    assert turns == [[("user", ">>> early"), ("assistant", ">>> late")]]


def test_ends_are_trimmed(spark):
    turns = valid_turns(
        spark,
        (1, "Me", at(0), "lost"), (1, "A", at(1), "q"), (1, "Me", at(2), "a"), (1, "A", at(3), "z"),
    )
    assert turns == [[("user", ">>> q"), ("assistant", ">>> a")]]


def test_one_sided_blocks_have_too_few_turns(spark):
    rows = [(1, "A", at(0), "x"), (2, "Me", at(0), "x")]
    for prompt in (None, "Be kind."):
        assert valid_turns(spark, *rows, system_prompt=prompt) == []


def test_system_prompt_is_stripped_and_blank_ones_are_ignored(spark):
    rows = [(1, "A", at(0), "q"), (1, "Me", at(1), "a")]
    (block,) = valid_turns(spark, *rows, system_prompt=" Be kind. ")
    assert block[0] == ("system", "Be kind.") and len(block) == 3
    (block,) = valid_turns(spark, *rows, system_prompt="  ")
    assert len(block) == 2


def test_empty_delimiter_loses_only_the_first_space(spark):
    rows = [(1, "A", at(0), "a"), (1, "A", at(1), "b"), (1, "Me", at(2), "c")]
    assert valid_turns(spark, *rows, delimiter=" ") == [[("user", "a\n b"), ("assistant", "c")]]


def test_second_token_check_counts_prefixes_and_prompt(spark):
    rows = [(1, "A", at(0), "a b c"), (1, "Me", at(1), "d e")]
    # 5 tokens before merging, 5 + 2 * 3 after it, 3 more with the prompt
    assert len(valid_turns(spark, *rows, min_tokens=5, max_tokens=11)) == 1
    assert valid_turns(spark, *rows, min_tokens=5, max_tokens=10) == []
    prompted = {"system_prompt": "be kind."}
    assert valid_turns(spark, *rows, min_tokens=5, max_tokens=13, **prompted) == []
    assert len(valid_turns(spark, *rows, min_tokens=5, max_tokens=14, **prompted)) == 1


@pytest.mark.parametrize(
    "roles, broken",
    [
        ("", "empty block"),
        ("s", "only a system turn"),
        ("au", "first turn is not user"),
        ("sau", "first turn is not user"),
        ("uaau", "roles do not alternate"),
        ("usa", "roles do not alternate"),
        ("uau", "last turn is not assistant"),
        ("ua", None),
        ("suaua", None),
    ],
)
def test_block_structure(spark, roles, broken):
    names = {"s": "system", "u": "user", "a": "assistant"}
    turns = [(names[r], "x") for r in roles]
    frame = spark.createDataFrame([(turns,)], "turns array<struct<role:string,content:string>>")
    assert frame.select(tn.violation(F.col("turns")).alias("v")).first().v == broken


def test_statistics_and_breakdown(spark):
    rows = []
    for chat, pairs in ((1, 2), (2, 0), (3, 1)):
        for p in range(pairs):
            hour = f"2024-01-01T{10 + 3 * p:02d}"
            rows += [
                (chat, "A", f"{hour}:00:00", "q"), (chat, "A", f"{hour}:01:00", "q"),
                (chat, "Me", f"{hour}:02:00", "a"), (chat, "Me", f"{hour}:09:00", "a"),
            ]
        rows.append((chat, "A", "2024-01-02T10:00:00", "alone"))
    cfg = PrepConfig("Me", min_tokens=0, max_tokens=500)
    # chats 1 and 3 share a name: the later one counts
    named = raw(spark, *rows).withColumn(
        "name", F.when(F.col("chat_key") == 3, "c1").otherwise(F.col("name"))
    )
    reviewed = prepare_chats(named, cfg)
    row = stats.chat_stats(reviewed).first()
    assert (row.num_chats, row.num_blocks) == (3, 3)
    # from the first user message to the first message of the last run
    assert row.min_duration_minutes_per_block == row.max_duration_minutes_per_block == 2.0
    breakdown = {r.contact_name: r.num_blocks for r in stats.block_breakdown(reviewed).collect()}
    assert breakdown == {"c1": 1, "c2": 0}
    records = {(r.chat_key, r.num_blocks) for r in runs.processed_blocks(reviewed).collect()}
    assert records == {(1, 2), (2, 0), (3, 1)}


def test_no_blocks_give_nulls(spark):
    reviewed = prepare_chats(raw(spark, (1, "A", at(0), "x")), PrepConfig("Me"))
    row = stats.chat_stats(reviewed).first()
    assert (row.num_chats, row.num_blocks, row.avg_tokens_per_block) == (0, 0, None)
    assert stats.top_n_others(stats.block_breakdown(reviewed)).count() == 0


def test_zone_and_clock_change_do_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(1, "A", "2024-03-10T01:30:00", "q"), (1, "Me", "2024-03-10T03:10:00", "a")]
        assert valid_turns(spark, *rows, gap_seconds=3600) == []  # 100 minutes apart
        (row,) = usable(spark, (1, "A", "2024-03-10T02:30:00", "x"))
        assert row.ts == datetime(2024, 3, 10, 2, 30)
        frame = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.5' as ts")
        iso = frame.select(tx.iso_format(F.col("ts")).alias("t")).first().t
        assert iso == "2024-03-10T02:30:00.500000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_segments_change_no_output(spark):
    rows = []
    for i in range(240):
        sender = "Me" if i % 5 in (2, 4) else "A"
        rows.append((1, sender, f"2024-01-01T{10 + i // 60}:{i % 60:02d}:00", "w " * (i % 4 + 1)))
    rows += [(2, "A", at(0), "q"), (2, "Me", at(1), "a")]
    results = []
    for rows_per_segment in (10_000, 50, 7):
        cfg = PrepConfig("Me", min_tokens=2, max_tokens=40, whole_chat_rows=rows_per_segment,
                         rows_per_segment=rows_per_segment)
        reviewed = prepare_chats(raw(spark, *rows), cfg)
        results.append(
            (
                sorted(map(str, tn.training_records(reviewed).select("chat_key", "block_start", "messages", "verdict", "outcome").collect())),
                stats.block_funnel(reviewed).collect(),
                stats.chat_stats(reviewed).collect(),
            )
        )
        small = replace(cfg, whole_chat_rows=10_000, whole_chat_chars=100)
        by_chars = prepare_chats(raw(spark, *rows), small)
        assert stats.chat_stats(by_chars).collect() == stats.chat_stats(reviewed).collect()
        lines = runs.processed_blocks(reviewed, rows_per_segment).collect()
        results[-1] += (sorted(map(str, lines)),)
        totals = stats.chat_stats(reviewed).first()
        assert sum(r.block_no is not None for r in lines) == totals.num_blocks > 0
        assert len({r.chat_key for r in lines}) == totals.num_chats
    assert results[0] == results[1] == results[2]


def test_partitioning_changes_no_output(spark):
    rows = [(c, "Me" if i % 3 else "A", at(i), f"m {i}") for c in range(4) for i in range(12)]
    cfg = PrepConfig("Me", min_tokens=2, max_tokens=30)
    frame = raw(spark, *rows)
    shown = lambda f: sorted(map(str, prepare_chats(f, cfg).collect()))
    assert shown(frame) == shown(frame.repartition(7)) == shown(frame.coalesce(1))
