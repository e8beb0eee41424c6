"""Reading exports of every shape, and whole runs written and read back."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from chatloom.config import PrepConfig
from chatloom.operators import training
from chatloom.plans.prepare import prepare_export, write_run
from chatloom.sinks import runs
from chatloom.sources import exports, records
from chatloom.plans import oracle
from chatloom.plans.queries import QUERIES
from chatloom.streaming import incremental
from compare import difference


def duck_of_folder(folder):
    connection = duckdb.connect()
    source = f"{folder}/conversations.parquet/*.parquet"
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{source}'")
    return connection


def says(sender, date, text, **more):
    return {"from": sender, "date": date, "text_entities": [{"type": "plain", "text": text}], **more}


ALICE = {
    "name": "Alice",
    "type": "personal_chat",
    "messages": [
        says("Me", "2024-01-01T10:00:00", "Hey!"),
        says("Alice", "2024-01-01T10:00:30", "Hi\nMe", sticker_emoji="🙂"),
        says("Alice", "2024-01-01T10:01:00", "How's it going?"),
        says("Me", "2024-01-01T10:02:00", "Well"),
        {"from": None, "date": "2024-01-01T10:03:00", "text_entities": []},
        {"from": "Alice", "date": "2024-01-01T10:03:30", "text_entities": "odd"},
        says("Alice", "not a date", "lost"),
        says("Alice", "2024-01-01T14:00:00", "You free?"),
    ],
}
TURNS = [("user", ">>> Hi Me🙂\n>>> How's it going?"), ("assistant", ">>> Well")]
DOCUMENTS = {
    "list": [ALICE, {"x": 1}, {"name": None, "messages": []}],
    "object": {"chats": {"list": [ALICE, {"x": 1}]}},
    "single": ALICE,
    "other": {"y": 2},
    "empty": [],
    "scalar": "just text",
}
VERDICTS = {
    "list": ("ok", 2), "object": ("ok", 2), "single": ("ok", 1),
    "other": ("no valid chats", 0), "empty": ("no valid chats", 0),
    "scalar": ("no valid chats", 0), "broken": ("unparseable", 0),
}
CFG = PrepConfig("Me", min_tokens=0, max_tokens=500)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    for name, document in DOCUMENTS.items():
        (folder / f"{name}.json").write_text(json.dumps(document), encoding="utf-8")
    (folder / "broken.json").write_text("{broken", encoding="utf-8")
    return str(folder)


def stem(column):
    return F.regexp_extract(column, r"([^/]+)\.json", 1)


def test_every_file_gets_a_verdict(spark, landing):
    report = exports.export_file_report(exports.read_documents(spark, landing))
    found = {r.file: (r.status, r.n_chats) for r in report.select(stem("source").alias("file"), "*").collect()}
    assert found == VERDICTS


def test_chats_of_all_shapes(spark, landing):
    chats = exports.read_exports(exports.read_documents(spark, landing))
    found = sorted((r.file, r.name or "") for r in chats.select(stem("chat_key").alias("file"), "name").collect())
    assert found == [("list", ""), ("list", "Alice"), ("object", ""), ("object", "Alice"), ("single", "Alice")]


def test_directory_of_single_chats(spark, landing):
    chats = exports.read_export_dir(spark, landing).orderBy("chat_key")
    names = [r.file for r in chats.select(stem("chat_key").alias("file")).collect()]
    assert names == sorted(DOCUMENTS)


def test_a_malformed_message_does_not_harm_its_chat(spark, landing):
    chats = exports.read_exports(exports.read_documents(spark, landing))
    messages = exports.export_messages(chats.filter(stem("chat_key") == "single"))
    assert messages.count() == len(ALICE["messages"])


def test_run_is_written_to_every_destination_and_read_back(spark, landing, tmp_path):
    chats = exports.read_exports(exports.read_documents(spark, landing))
    bases = [str(tmp_path / "one"), str(tmp_path / "two")]
    run_id = "0123456789abcdef0123456789abcdef"
    for _ in range(2):  # a repeated run replaces its files
        totals = write_run(chats, bases, run_id, CFG)
    assert (totals.first().num_chats, totals.first().num_blocks) == (3, 3)
    for base in bases:
        read = lambda name: runs.dataset_path(base, run_id, name)
        train = records.read_train_jsonl(spark, read(runs.TRAIN)).collect()
        assert [[tuple(m) for m in r.messages] for r in train] == [TURNS] * 3
        line = json.loads(spark.read.text(read(runs.PROCESSED)).first().value)
        assert line["num_blocks"] == 1 and line["contact_name"] == "Alice"
        assert line["block_no"] == 0 and line["messages"][0]["timestamp"] == "2024-01-01T10:00:30"
        assert spark.read.text(read(runs.RAW)).count() == 5
        assert [r.run_id for r in records.list_runs(spark, base).collect()] == [run_id]
        metadata = spark.read.schema("key string, value string").json(read(runs.METADATA))
        typed = {r.key: r for r in training.typed_metadata(metadata).collect()}
        assert typed["ft_lora_r"].value_long == 16 and typed["ft_load_in_4bit"].value_bool
        assert typed["ft_learning_rate"].value_double == 2e-4
        assert typed["ft_target_modules"].value_list[:2] == ["q_proj", "k_proj"]
        assert typed["stats_num_blocks"].value_long == 3
        assert runs.metadata_map(metadata).first().metadata["target_name"] == "Me"


def test_input_without_chats_is_an_error(spark, landing, tmp_path):
    with pytest.raises(ValueError):
        prepare_export(spark, f"{landing}/broken.json", [str(tmp_path / "out")], "a" * 32, CFG)


def test_directory_mode_takes_every_parsed_file_as_a_chat(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    totals = prepare_export(spark, landing, [out], "a" * 32, CFG, one_chat_per_file=True)
    assert totals.first().num_blocks == 1  # only "single" has a name and a type
    assert spark.read.text(runs.dataset_path(out, "a" * 32, runs.RAW)).count() == len(DOCUMENTS)


def test_system_turn_has_a_null_timestamp(spark, landing, tmp_path):
    chats = exports.read_exports(exports.read_documents(spark, landing))
    cfg = PrepConfig("Me", min_tokens=0, max_tokens=500, system_prompt="Be kind.")
    write_run(chats, [str(tmp_path / "out")], "a" * 32, cfg)
    path = runs.dataset_path(str(tmp_path / "out"), "a" * 32, runs.PROCESSED)
    first = json.loads(spark.read.text(path).first().value)["messages"][0]
    assert first == {"timestamp": None, "role": "system", "content": "Be kind."}


def test_incremental_runs_process_each_file_once(spark, landing, tmp_path):
    out = str(tmp_path / "out")

    def advance():
        query = incremental.start_incremental(spark, landing, out, f"{out}/checkpoint", CFG)
        query.awaitTermination()
        rows = incremental.read_ledger(spark, out).collect()
        return {r.source.rsplit("/", 1)[1]: (r.status, r.error) for r in rows}, len(rows)

    first, n = advance()
    assert n == len(VERDICTS)
    assert first["single.json"] == ("completed", None)
    assert first["broken.json"] == ("failed", "unparseable")
    assert first["empty.json"] == ("failed", "no valid chats")
    assert advance() == (first, n)
    (tmp_path / "exports" / "later.json").write_text(json.dumps(ALICE), encoding="utf-8")
    later, n = advance()
    assert n == len(VERDICTS) + 1 and later["later.json"] == ("completed", None)
    assert records.list_runs(spark, f"{out}/runs").count() == 4
    # Every run has the datasets of a batch run, and its stats in the ledger.
    found = spark.read.text(f"{out}/runs").groupBy("run_id").agg(F.collect_set("data").alias("data"))
    wanted = {runs.RAW, runs.PROCESSED, runs.TRAIN, runs.METADATA, runs.BREAKDOWN}
    assert all(set(r["data"]) == wanted for r in found.collect())
    done = incremental.read_ledger(spark, out).filter("status = 'completed'").collect()
    assert {r.num_blocks for r in done} == {1} and all(r.started_at <= r.completed_at for r in done)


def test_one_document_that_breaks_the_plan_fails_alone(spark, landing, tmp_path, monkeypatch):
    out, usual = str(tmp_path / "out"), incremental.prepare_chats

    def fragile(raw, cfg, counter):
        hit = F.col("from") == "Bad"
        return usual(raw.withColumn("from", F.when(hit, F.raise_error(F.lit("boom"))).otherwise(F.col("from"))), cfg, counter)

    monkeypatch.setattr(incremental, "prepare_chats", fragile)
    bad = {**ALICE, "messages": [says("Bad", "2024-01-01T10:00:00", "x")]}
    (tmp_path / "exports" / "bad.json").write_text(json.dumps(bad), encoding="utf-8")
    incremental.start_incremental(spark, landing, out, f"{out}/checkpoint", CFG).awaitTermination()
    rows = {r.source.rsplit("/", 1)[1]: r for r in incremental.read_ledger(spark, out).collect()}
    assert rows["bad.json"].status == "failed" and "boom" in rows["bad.json"].error
    assert [rows[f"{n}.json"].status for n in ("list", "object", "single")] == ["completed"] * 3


def outputs(spark, base, run_id):
    lines = spark.read.text(base).filter(F.col("run_id") == run_id).collect()
    # Raw lines of byte ranges keep their layout.
    value = lambda r: json.dumps(json.loads(r.value), sort_keys=True)
    return sorted((r["data"], value(r)) for r in lines if r["data"] != runs.METADATA or "uuid" not in r.value)


def test_a_run_in_byte_ranges_equals_a_run_of_whole_documents(spark, landing, tmp_path):
    (tmp_path / "exports" / "lines.json").write_text(json.dumps([ALICE, {**ALICE, "name": "B"}], indent=2), encoding="utf-8")
    for whole_bytes, run in ((exports.WHOLE_BYTES, "a" * 32), (900, "b" * 32)):
        prepare_export(spark, landing, [str(tmp_path / "out")], run, CFG, whole_bytes=whole_bytes)
    first, second = (outputs(spark, str(tmp_path / "out"), c * 32) for c in "ab")
    assert first == second and len(first) > 30


def test_a_batch_reads_large_files_in_ranges(spark, landing, tmp_path):
    files = incremental.listed(spark.read.format("binaryFile").load(landing))
    found = []
    for whole_bytes in (exports.WHOLE_BYTES, 900):
        out = str(tmp_path / f"out{whole_bytes}")
        incremental.process_batch(files, 0, out, CFG, whole_bytes=whole_bytes)
        ledger = incremental.read_ledger(spark, out).drop("started_at", "completed_at").orderBy("source").collect()
        found.append((ledger, sorted((r.run_id, r["data"], json.dumps(json.loads(r.value), sort_keys=True)) for r in spark.read.text(f"{out}/runs").collect())))
    assert found[0] == found[1]


def test_halving_finds_bad_files_with_few_plans(spark):
    class File:
        def __init__(self, n):
            self.run_id, self.source, self.created_at, self.n = str(n), f"f{n}", None, n

    plans = []

    def prepare(files):
        plans.append(len(files))
        if any(f.n == 437 for f in files):
            raise RuntimeError("boom")
        return incremental._ledger_rows(incremental._submitted(spark, files).withColumns({"status": F.lit(exports.OK), "n_chats": F.lit(1)}))

    rows = incremental._attempt(spark, [File(n) for n in range(1000)], prepare).collect()
    assert len(rows) == 1000 and len(plans) <= 21
    assert [(r.source, r.error) for r in rows if r.status == "failed"] == [("f437", "boom")]


def test_a_large_document_loses_nothing(spark, tmp_path):
    """One valid document of 150 MB, above the limit of a single VARIANT."""
    n, text = 15_000, "x" * 10_000
    message = json.dumps(says("Me", "2024-01-01T10:00:00", text))
    body = '{"name": "A", "type": "personal_chat", "extra": [1, {"k": null}], "messages": ['
    (tmp_path / "big.json").write_text(body + ",".join([message] * n) + "]}", encoding="utf-8")
    documents = exports.read_documents(spark, str(tmp_path))
    report = exports.export_file_report(documents).first()
    assert (report.status, report.n_chats) == ("ok", 1)
    chats = exports.read_exports(documents)
    sizes = exports.export_messages(chats).select(F.length(F.col("text_entities")[0]["text"]).alias("n"))
    assert sizes.agg(F.count("n"), F.sum("n")).first() == (n, n * len(text))
    assert chats.select(F.get_json_object("chat", "$.extra").alias("e")).first().e == '[1,{"k":null}]'


def test_broken_tails_are_unparseable(spark):
    texts = ['[{"name": 1, "messages": []}, {', '{"name": "a", "messages": [', "[1, 2", '"open', "", "{}", "[]"]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, value string")
    report = exports.export_file_report(exports.parse_documents(frame))
    found = [r.status for r in report.orderBy("source").collect()]
    assert found == ["unparseable"] * 5 + ["no valid chats"] * 2


def test_blanks_before_a_document_do_not_matter(spark):
    chat = json.dumps({"name": "A", "type": "t", "messages": []})
    bodies = [chat, f"[{chat}]", f'{{"chats": {{"list": [{chat}]}}}}']
    blanks = ["\n", "\t", "\r\n", " " * 1200, "\n\t " * 700]
    rows = [(f"{i}-{j}", b + body) for i, b in enumerate(blanks) for j, body in enumerate(bodies)]
    documents = exports.parse_documents(spark.createDataFrame(rows, "source string, value string"))
    found = {r.source: (r.status, r.n_chats) for r in exports.export_file_report(documents).collect()}
    assert found == {name: ("ok", 1) for name, _ in rows}
    assert exports.read_exports(documents).filter("name = 'A'").count() == len(rows)


@pytest.mark.parametrize("turns", [12, 60])
def test_long_conversations_stay_whole(spark, tmp_path, turns):
    rows = [(c, t, ("user", "assistant")[t % 2], f"w{t} " * 30) for c in range(12) for t in range(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("flatten_messages", "read_exports", "export_file_report", "write_run_layout", "read_train_jsonl"):
        connection = duck_of_folder(tmp_path)
        assert difference(QUERIES[name](spark, str(tmp_path)), oracle.SQL[name], connection) is None, name


def test_repeating_a_batch_changes_nothing(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    files = incremental.listed(spark.read.format("binaryFile").load(landing))
    for _ in range(2):
        incremental.process_batch(files, 0, out, CFG)
        assert incremental.read_ledger(spark, out).count() == len(VERDICTS)
        lines = spark.read.text(f"{out}/runs").filter(F.col("data") == runs.TRAIN)
        assert lines.count() == 3


def test_many_small_runs_are_written_by_many_tasks(spark, tmp_path):
    """The tasks share the runs; written again after clearing, a run has its rows once, others stay."""
    base = str(tmp_path / "runs")
    lines = spark.range(400).select(F.concat(F.lit("r"), F.col("id") % 100).alias("run_id"), F.col("id").cast("string").alias("value"))
    for some in (lines, lines.filter("run_id < 'r5'"), lines.filter("run_id = 'absent'")):
        runs.clear_runs(spark, [base], [r.run_id for r in some.select("run_id").distinct().collect()] + ["absent"])
        runs.write_dataset(some, [base], runs.TRAIN, many_runs=True, tasks=4)
    files = list((tmp_path / "runs").rglob("part-*.txt"))
    assert len(files) == 100  # one file of each run
    assert len({f.name.split("-")[1] for f in files}) == 4
    assert sorted(int(r.value) for r in spark.read.text(base).collect()) == list(range(400))
