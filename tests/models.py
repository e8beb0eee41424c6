"""Plain sequential models of the block rules, for comparison in tests."""

from __future__ import annotations

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)
MESSAGE = (
    "chat_key bigint, name string, type string, pos bigint, ts timestamp_ntz,"
    " role string, content string, n_tokens bigint"
)


def message(chat, pos, seconds, tokens, role="user", content="x"):
    """Row of a message frame; ``seconds`` may be fractional."""
    ts = START + timedelta(seconds=seconds)
    return (chat, f"c{chat}", "personal_chat", pos, ts, role, content, tokens)


def sequential_blocks(rows, gap, max_tokens):
    """{(chat, pos): (session, position of the block's first message)}"""
    placed = {}
    for chat in {r[0] for r in rows}:
        previous = start = None
        session, held = -1, 0
        for row in sorted((r for r in rows if r[0] == chat), key=lambda r: (r[4], r[3])):
            _, _, _, pos, ts, _, _, tokens = row
            close = previous is not None and (ts - previous).total_seconds() <= gap
            if not close:
                session += 1
            if close and held + tokens <= max_tokens:
                held += tokens
            else:
                start, held = pos, tokens
            placed[chat, pos] = (session, start)
            previous = ts
    return placed
