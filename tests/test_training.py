"""Templates, response spans, metadata types, dialogue and counters."""

import pytest
from pyspark.sql import functions as F

from chatloom.functions import templates
from chatloom.functions.tokens import DEFAULT_COUNTER
from chatloom.operators import dialogue, training

RECORD = "id int, messages array<struct<role:string,content:string>>"
TALK = [("system", "S"), ("user", "U1"), ("assistant", "A1"), ("user", "U2"), ("assistant", "A2")]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame([(1, TALK)], RECORD)


@pytest.mark.parametrize(
    "name, text",
    [
        ("chatml", "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU1<|im_end|>\n"
                   "<|im_start|>assistant\nA1<|im_end|>\n<|im_start|>user\nU2<|im_end|>\n"
                   "<|im_start|>assistant\nA2<|im_end|>\n"),
        ("gemma-3", "<bos><start_of_turn>user\nS\n\nU1<end_of_turn>\n<start_of_turn>model\n"
                    "A1<end_of_turn>\n<start_of_turn>user\nU2<end_of_turn>\n"
                    "<start_of_turn>model\nA2<end_of_turn>\n"),
        ("mistral", "<s>[INST] S\n\nU1 [/INST] A1</s>[INST] U2 [/INST] A2</s>"),
    ],
)
def test_templates(talk, name, text):
    assert training.render_records(talk, name).first().text == text


def test_prompt_leaves_the_reply_open(talk):
    prompt = training.render_prompts(talk, "llama-3.2").first().prompt
    assert prompt.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>")
    assert prompt.endswith("<|start_header_id|>assistant<|end_header_id|>\n\n")


@pytest.mark.parametrize(
    "template, model, answer",
    [
        ("chatml", "llama", "<|im_start|>assistant\n"),
        ("x", "unsloth/llama-3-8b-x", "<|start_header_id|>assistant<|end_header_id|>"),
        ("llama-3.2", "x", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
        ("x", "unsloth/Llama-3.2", None),  # upper case does not match
        ("gemma-3", "x", "<start_of_turn>model\n"),
    ],
)
def test_markers(spark, template, model, answer):
    frame = spark.createDataFrame([(template, model)], "t string, m string")
    assert training.add_markers(frame, "t", "m").first().response_marker == answer


@pytest.mark.parametrize("name", ["chatml", "llama-3.2", "gemma-3", "mistral"])
def test_spans_rebuild_the_text_and_mark_replies(talk, name):
    rendered = training.render_records(talk, name)
    marked = training.add_markers(rendered.withColumn("t", F.lit(name)), "t", "t")
    spans = training.response_spans(marked).orderBy("span").collect()
    assert "".join(s.text for s in spans) == rendered.first().text
    targets = [s.text for s in spans if s.is_target]
    if name == "mistral":  # no rule: everything is a target
        assert len(targets) == 1
    else:
        assert len(targets) == 2 and targets[0].startswith("A1") and "U2" not in targets[0]


def test_standard_roles(spark):
    frame = spark.sql(
        "select array(named_struct('role', null, 'content', null, 'from', 'Human', 'value', 'x'),"
        " named_struct('role', 'assistant', 'content', 'y', 'from', null, 'value', null),"
        " named_struct('role', 'tool', 'content', 'z', 'from', 'gpt', 'value', null)) as messages"
    )
    assert [tuple(m) for m in training.standardize(frame).first().messages] == [
        ("user", "x"), ("assistant", "y"), ("tool", "z"),
    ]


@pytest.mark.parametrize(
    "value, kind, typed",
    [
        ("True", "bool", True), ("12", "int", 12), ("-3", "int", -3), ("5.", "float", 5.0),
        (".5", "float", 0.5), ("-1.5", "float", -1.5), ("1e-4", "str", "1e-4"),
        ("1.2.3", "str", "1.2.3"), ("['a', 'b']", "list", ["a", "b"]),
        ("[1, 2]", "list", ["1", "2"]), ("[a", "str", "[a"), ("[a b]", "str", "[a b]"),
        ("[true]", "str", "[true]"), ("", "str", ""), (".", "str", "."), ("-", "str", "-"),
    ],
)
def test_typed_metadata(spark, value, kind, typed):
    frame = spark.createDataFrame([("k", value)], "key string, value string")
    row = training.typed_metadata(frame).first()
    column = {"int": "value_long", "float": "value_double"}.get(kind, f"value_{kind}")
    assert (row.kind, row[column]) == (kind, typed)


def test_split_reply_reverses_merging(spark):
    frame = spark.createDataFrame([(1, ">>> a b\n>>> c\n>>>  \n>>> d ")], "id int, reply string")
    rows = dialogue.split_reply(frame, "reply").orderBy("part").collect()
    assert [(r.part, r.message) for r in rows] == [(0, "a b"), (1, "c"), (2, "d")]


def test_history_is_the_same_with_segments(spark):
    turns = spark.range(60).selectExpr(
        "id % 2 as conv_id", "id as turn", "'user' as role", "repeat('x', cast(id as int)) as text"
    )
    sizes = []
    for limit in (1000, 8):
        history = dialogue.rolling_history(turns, "conv_id", "turn", "text", limit).union()
        sizes.append(sorted((r.turn, r.history_messages, r.history_chars) for r in history.collect()))
    assert sizes[0] == sizes[1]
    assert [r[1] for r in sizes[0][:4]] == [1, 1, 2, 2] and len(sizes[0]) == 60


@pytest.mark.parametrize("limit", [1000, 8])
@pytest.mark.parametrize("last", [1, 4, 100])
def test_recent_histories_of_long_and_short_conversations(spark, limit, last):
    sizes = {None: 3, 0: 1, 1: 60, 2: 9}
    rows = [(k, t, "user" if t % 2 else None, f"{k}-{t}") for k, n in sizes.items() for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    histories = dialogue.recent_histories(
        turns, "conv_id", "turn", ["text"], last, limit, F.col("role") == "user"
    )
    found = {(r.conv_id, r.turn): (r.n_earlier, [m.text for m in r.history]) for r in histories.collect()}
    expected = {
        (k, t): (max(t + 1 - last, 0), [f"{k}-{i}" for i in range(max(t + 1 - last, 0), t + 1)])
        for k, n in sizes.items()
        for t in range(1, n, 2)
    }
    assert found == expected
    assert dialogue.recent_histories(turns.limit(0), "conv_id", "turn", ["text"], last, limit).isEmpty()


def test_request_rules(spark):
    good = "0123456789abcdef0123456789abcdef"
    talk = [("user", "x")]
    rows = [
        (1, good, talk, None), (2, good.upper(), talk, 1.0), (3, good, [], 1.0),
        (4, good, None, 1.0), (5, good, talk, 5.0), (6, good, talk, 5.1), (7, good, talk, -0.1),
        (8, None, talk, 1.0),
    ]
    kind = "id int, run_id string, messages array<struct<role:string,content:string>>, temperature double"
    checked = dialogue.validate_requests(spark.createDataFrame(rows, kind)).collect()
    assert [r.reason for r in sorted(checked)] == [
        None, "run_id", "messages", "messages", None, "temperature", "temperature", "run_id",
    ]
    assert sorted(checked)[0].temperature == 1.0


def test_default_counter(spark):
    texts = [(">>> Hi, you_2", 6), ("", 0), ("é🙂", 2), (None, None)]
    frame = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    counts = [r.n for r in frame.select(DEFAULT_COUNTER.of_text(F.col("t")).alias("n")).collect()]
    assert counts == [n for _, n in texts]


def test_any_column_counter_fits(talk):
    class WordCounter:
        def of_text(self, text):
            return F.size(F.split(text, " ")).cast("bigint")

        def of_texts(self, texts):
            return F.transform(texts, self.of_text)

    rendered = talk.select("id", F.lit("a b c").alias("text"))
    row = training.check_length(rendered, 2, WordCounter()).first()
    assert (row.n_text_tokens, row.over_limit) == (3, True)


def test_every_model_has_a_template():
    assert set(templates.MODEL_TEMPLATES.values()) <= set(templates.TEMPLATES)
