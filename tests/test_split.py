"""Large documents in byte ranges give what whole documents give."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.sources import exports, split


def message(rng, i):
    texts = ["plain", 'quote " and \\ slash', "braces } ] { [ , :", "é🙂\n", "", "\\", '\\"', "}" * 5]
    out = {"id": i, "from": rng.choice(["Me", "Al}ice", None]), "date": f"2024-01-01T10:00:{i % 60:02d}",
           "text_entities": [{"type": "plain", "text": rng.choice(texts)} for _ in range(rng.randrange(3))]}
    if rng.random() < 0.2:
        out["messages"] = [{"list": [1, {"messages": []}]}]
    return out


def chat(rng, n, more=True):
    out = {"name": rng.choice(["A", "B, the \"second\"", "C]}", None]), "id": 4}
    if more:
        out["type"] = "personal_chat"
    out["messages"] = [message(rng, i) for i in range(n)]
    if rng.random() < 0.5:
        out["other"] = {"messages": [1, 2], "x": [{}], "list": []}
    return out


def documents():
    rng = random.Random(2)
    layouts = [dict(separators=(",", ":")), dict(indent=1), dict(indent=3, ensure_ascii=False)]
    chats = lambda k: [chat(rng, rng.randrange(6)) for _ in range(k)]
    values = {
        "list": [*chats(4), {"name": "no messages"}, 5, None, "text", [1, {"messages": [3]}], *chats(2)],
        "export": {"about": "x}y", "chats": {"about": [1, [2]], "list": [*chats(3), 7, {"name": "n"}]}, "left": {"list": [{"messages": [1]}]}},
        "single": chat(rng, 9),
        "both": {"messages": [{"id": 1}], "name": "root", "chats": {"list": chats(2)}, "z": 1},
        "after": {"chats": {"list": chats(2)}, "name": "root", "messages": [{"id": 1}, {"id": 2}]},
        "empty_list": [],
        "empty_export": {"chats": {"list": []}},
        "no_list": {"chats": {"list": {"messages": []}}},
        "null_messages": [{"name": "a", "messages": None}, {"name": "b", "messages": []}, {"name": "c", "messages": {"messages": [1]}}],
        "odd_messages": [{"name": "a", "messages": [1, None, "x", [2], {"from": "Me"}]}],
        "number": 12,
        "nothing": {},
        "escaped": [{"name": "k", "messages": [{"from": "x"}]}],
    }
    out = {}
    for name, value in values.items():
        for k, layout in enumerate(layouts[: 3 if name in ("list", "export", "single") else 1]):
            out[f"{name}{k}"] = json.dumps(value, **layout)
    good = out["list0"]
    out |= {
        "blank": "  \n\t", "newlines": "\n\n\t" + good + "\n", "cut": good[:-30], "cut_string": good[: good.index("plain") + 2],
        "two_commas": '[{"name":"a","messages":[{"id":1},,{"id":2}]}]', "open": '{"name":"a","messages":[{"id":1}',
        "no_comma": '[{"name":"a" "messages":[]}]', "missing_comma": '[{"name":"a","messages":[{"id":1} {"id":2}]}]',
        "trailing": '[{"name":"a","messages":[{"id":1},]}]', "word": "nonsense",
    }
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("documents")
    for name, text in documents().items():
        (where / f"{name}.json").write_text(text)
    return str(where)


@pytest.fixture(scope="module")
def whole(spark, folder):
    docs = exports.read_documents(spark, folder).cache()
    chats = exports.read_exports(docs)
    return rows(chats.drop("chat")), rows(exports.export_messages(chats)), rows(exports.export_file_report(docs))


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))


def parts_of(found):
    key = F.format_string("%s#%09d", "source", "ordinal").alias("chat_key")
    chats = found.chats.select(key, "name", "type")
    texts = found.messages.join(found.chats.select("source", "ordinal", "name", "type"), ["source", "ordinal"])
    messages = exports.message_fields(texts.select(key, "name", "type", "pos", "text"))
    return rows(chats), rows(messages), rows(found.report)


@pytest.mark.parametrize("range_bytes", [250, 997])
def test_any_range_gives_the_same_rows(spark, folder, whole, range_bytes, monkeypatch):
    monkeypatch.setattr(split, "SENT_RANGES", 0 if range_bytes == 997 else 100_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts = split.split_exports(spark, folder)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for got, want in zip(parts_of(parts), whole):
        assert [x for x in got if x not in want] == [x for x in want if x not in got] == []
        assert len(got) == len(want)


def test_raw_lines_hold_the_chats(spark, folder):
    found = split.split_exports(spark, folder)
    docs = exports.read_exports(exports.read_documents(spark, folder)).select("chat_key", "chat").collect()
    want = {r.chat_key: json.loads(r.chat) for r in docs}
    for per_line in (100_000, 2):
        got = {}
        for r in split.raw_lines(found, per_line).orderBy("source", "ordinal").collect():
            got.setdefault(f"{r.source}#{r.ordinal:09d}", []).append(json.loads(r.value))
        assert got.keys() == want.keys()
        for key, lines in got.items():
            if isinstance(want[key], dict) and isinstance(want[key].get("messages"), list):
                whole = sorted((m for x in lines for m in x["messages"]), key=json.dumps)
                assert whole == sorted(want[key]["messages"], key=json.dumps)
                assert all(len(x["messages"]) <= per_line for x in lines)
                lines = [{**x, "messages": want[key]["messages"]} for x in lines]
            assert all(x == want[key] for x in lines)


def test_marks_of_parts_are_those_of_the_whole():
    text = np.frombuffer(documents()["export1"].encode(), dtype=np.uint8)
    all_marks = split.marks(text, 0, 0)
    cut = int(np.flatnonzero(text == ord("}"))[7]) + 1
    left = split.marks(text[:cut], 0, 0)
    right = split.marks(text[cut:], left.in_string, left.end_depth)
    assert np.array_equal(all_marks.at, np.concatenate([left.at, right.at + cut]))
    assert np.array_equal(all_marks.depth, np.concatenate([left.depth, right.depth]))
    assert (right.in_string, right.end_depth) == (0, 0)
