"""Every operator as a query over the driver tables, with flat results.

Each function takes (spark, sf_dir). The SQL with the same results is in
``oracle``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import FineTuneConfig, PrepConfig
from chatloom.functions import text as tx
from chatloom.functions.templates import MODEL_TEMPLATES
from chatloom.functions.tokens import DEFAULT_COUNTER
from chatloom.operators import blocks as bl
from chatloom.operators import dialogue, ledger, messages, ordering, stats, training
from chatloom.operators import turns as tn
from chatloom.plans import adapters as ad
from chatloom.plans.prepare import message_blocks, prepare_chats, write_run
from chatloom.session import scratch_path
from chatloom.sinks import runs
from chatloom.sources import exports, records, split
from chatloom.streaming import incremental

CFG = PrepConfig("Me", min_tokens=100, max_tokens=300, now=datetime(2024, 6, 1))
LIMITED = PrepConfig(
    "Me", date_limit="2024-01-20T03:20:05", min_tokens=100, max_tokens=300,
    now=datetime(2024, 6, 1),
)
PROMPTED = PrepConfig(
    "Me", system_prompt=" Answer as Me. ", min_tokens=100, max_tokens=300,
    now=datetime(2024, 6, 1),
)
EVENT_GAP, EVENT_MIN, EVENT_MAX = 43_200, 10, 40
RUN_ID = "0123456789abcdef0123456789abcdef"
BLOCK = ["chat_key", "block_start"]

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# Building stones ------------------------------------------------------------


def in_order(spark: SparkSession, sf_dir: str) -> ordering.Ordered:
    raw = ad.chat_raw(spark, sf_dir)
    usable = messages.usable_messages(raw, CFG)
    counted = messages.candidates(raw, CFG)
    return bl.chronological(usable, CFG.whole_chat_rows, CFG.rows_per_segment, counted)


def event_order(spark: SparkSession, sf_dir: str) -> ordering.Ordered:
    events = ad.event_messages(spark, sf_dir)
    return bl.chronological(events, CFG.whole_chat_rows, CFG.rows_per_segment)


def pass_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ad.chat_raw(spark, sf_dir)
    usable = messages.usable_messages(raw, CFG)
    return message_blocks(usable, CFG, messages.candidates(raw, CFG))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.kept(pass_one(spark, sf_dir))


def reviewed(spark: SparkSession, sf_dir: str, cfg: PrepConfig = CFG) -> DataFrame:
    return prepare_chats(ad.chat_raw(spark, sf_dir), cfg)


def valid(spark: SparkSession, sf_dir: str, cfg: PrepConfig = CFG) -> DataFrame:
    return tn.valid_blocks(bl.kept(reviewed(spark, sf_dir, cfg)))


def training_records(spark: SparkSession, sf_dir: str, cfg: PrepConfig = CFG) -> DataFrame:
    return tn.training_records(valid(spark, sf_dir, cfg)).select(*BLOCK, "messages")


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 as BIGINT."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.floor(tx.micros_between(epoch, ts) / 1_000_000)


def flat_turns(blocks: DataFrame) -> DataFrame:
    """One row per turn with its number and time."""
    return blocks.select(*BLOCK, F.posexplode("turns").alias("turn_no", "turn")).select(
        *BLOCK,
        F.col("turn_no").cast("bigint").alias("turn_no"),
        "turn.role",
        "turn.content",
        seconds("turn.ts").alias("ts"),
    )


def body_text() -> Column:
    return tx.message_text(F.col("text_entities"), F.col("sticker_emoji"))


# Messages -------------------------------------------------------------------


@query
def flatten_messages(spark, sf_dir):
    flat = messages.flatten_messages(ad.export_chats(spark, sf_dir))
    return flat.select("chat_key", "pos", "from", "date", body_text().alias("body"))


@query
def message_text(spark, sf_dir):
    return ad.chat_raw(spark, sf_dir).select("chat_key", "pos", body_text().alias("body"))


@query
def normalize_text(spark, sf_dir):
    documents = ad.table(spark, sf_dir, "documents")
    return documents.select("doc_id", tx.normalize_text(F.col("text")).alias("content"))


@query
def assign_role(spark, sf_dir):
    raw = ad.chat_raw(spark, sf_dir)
    return raw.select("chat_key", "pos", messages.role_of(F.col("from"), "Me").alias("role"))


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of which some have an unusual or broken date or no text."""
    key, pos, date = F.col("chat_key"), F.col("pos"), F.col("date")
    pick = (key + pos) % 7
    blank = F.array(F.struct(F.lit("plain").alias("type"), F.lit("  \xa0\n").alias("text")))
    gone = F.array(
        F.struct(F.lit("plain").alias("type"), F.lit(None).cast("string").alias("text"))
    )
    return (
        ad.chat_raw(spark, sf_dir)
        .withColumn(
            "date",
            F.when(pick == 1, F.substring(date, 1, 10))
            .when(pick == 2, F.concat(date, F.lit("+02:00")))
            .when(pick == 3, "not a date")
            .when(pick == 4, F.substring(date, 1, 7))
            .otherwise(date),
        )
        .withColumn(
            "text_entities",
            F.when((key + pos) % 11 == 5, blank)
            .when((key + pos) % 11 == 6, gone)
            .when((key + pos) % 11 == 7, F.array().cast(gone_type()))
            .otherwise(F.col("text_entities")),
        )
    )


def gone_type() -> str:
    return "array<struct<type:string,text:string>>"


@query
def parse_timestamp(spark, sf_dir):
    raw = dirty_raw(spark, sf_dir)
    ts = tx.parse_timestamp(F.col("date"))
    return raw.select("chat_key", "pos", "date", seconds(ts).alias("ts"))


@query
def effective_date_limit(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events")
    pick, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp_ntz")
    asked = (
        F.when(pick == 0, "")
        .when(pick == 1, "None")
        .when(pick == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(pick == 3, F.date_format(ts, "yyyy-MM-dd"))
    )
    now = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    limit = messages.effective_date_limit(F.col("asked"), now)
    return events.select("event_id", asked.alias("asked")).select(
        "event_id", seconds(limit).alias("date_limit")
    )


@query
def token_count(spark, sf_dir):
    documents = ad.table(spark, sf_dir, "documents")
    return documents.select("doc_id", DEFAULT_COUNTER.of_text(F.col("text")).alias("n_tokens"))


@query
def named_chats(spark, sf_dir):
    return messages.named_chats(ad.chat_raw(spark, sf_dir)).select("chat_key", "pos", "name")


@query
def chat_type_filter(spark, sf_dir):
    raw = messages.chats_of_type(ad.chat_raw(spark, sf_dir), CFG.chat_types)
    return raw.select("chat_key", "pos", "type")


@query
def eligible_messages(spark, sf_dir):
    raw = messages.eligible_messages(dirty_raw(spark, sf_dir))
    return raw.select("chat_key", "pos", F.col("from").alias("sender"))


@query
def date_limit_filter(spark, sf_dir):
    fields = messages.read_fields(ad.chat_raw(spark, sf_dir), LIMITED)
    rows = messages.since(fields, LIMITED.since)
    return rows.select("chat_key", "pos", seconds("ts").alias("ts"))


@query
def nonempty_content(spark, sf_dir):
    rows = messages.nonempty(messages.read_fields(dirty_raw(spark, sf_dir), CFG))
    return rows.select("chat_key", "pos", "content")


@query
def quarantine(spark, sf_dir):
    rows = messages.quarantine(dirty_raw(spark, sf_dir), LIMITED)
    return rows.select("chat_key", "pos", "reject_reason")


@query
def chronological(spark, sf_dir):
    rows = in_order(spark, sf_dir)
    numbered = ordering.add_row_number(rows, "place").union()
    return numbered.select("chat_key", "pos", "place")


# Sessions and blocks --------------------------------------------------------


@query
def message_gap(spark, sf_dir):
    rows = in_order(spark, sf_dir)
    return bl.message_gap(rows).union().select("chat_key", "pos", "gap_seconds")


@query
def event_gap(spark, sf_dir):
    rows = event_order(spark, sf_dir)
    return bl.message_gap(rows).union().select("chat_key", "pos", "gap_seconds")


@query
def time_sessions(spark, sf_dir):
    rows = in_order(spark, sf_dir)
    sessions = bl.time_sessions(rows, CFG.gap_seconds).union()
    return sessions.select("chat_key", "pos", "session")


@query
def event_sessions(spark, sf_dir):
    rows = event_order(spark, sf_dir)
    sessions = bl.time_sessions(rows, EVENT_GAP).union()
    return sessions.groupBy("chat_key", "session").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("pos").alias("first_pos"),
        F.sum("n_tokens").alias("n_tokens"),
    )


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        *BLOCK,
        "session",
        F.size("messages").cast("bigint").alias("n_messages"),
        "n_tokens",
        "verdict",
    )


@query
def token_blocks(spark, sf_dir):
    return block_sizes(pass_one(spark, sf_dir))


@query
def event_token_blocks(spark, sf_dir):
    rows = event_order(spark, sf_dir)
    blocks = bl.token_blocks(rows, EVENT_GAP, EVENT_MAX)
    return block_sizes(bl.with_verdict(blocks, EVENT_MIN, EVENT_MAX))


@query
def block_token_filter(spark, sf_dir):
    return block_sizes(kept(spark, sf_dir)).drop("verdict")


@query
def kept_chats(spark, sf_dir):
    return bl.kept_chats(pass_one(spark, sf_dir)).select("chat_key", "name", "type")


@query
def role_runs(spark, sf_dir):
    rows = tn.role_runs(kept(spark, sf_dir))
    return (
        rows.select(*BLOCK, F.posexplode("runs").alias("run_no", "run"))
        .select(*BLOCK, F.col("run_no").cast("bigint").alias("run_no"), F.explode("run").alias("m"))
        .select(*BLOCK, "run_no", "m.pos", "m.role")
    )


@query
def merge_runs(spark, sf_dir):
    return flat_turns(tn.merge_runs(kept(spark, sf_dir), CFG.line_prefix))


@query
def trim_block_ends(spark, sf_dir):
    merged = tn.merge_runs(kept(spark, sf_dir), CFG.line_prefix)
    return flat_turns(tn.trim_ends(merged))


@query
def prepend_system(spark, sf_dir):
    merged = tn.trim_ends(tn.merge_runs(kept(spark, sf_dir), PROMPTED.line_prefix))
    return flat_turns(tn.prepend_system(merged, PROMPTED.system_text))


@query
def final_token_filter(spark, sf_dir):
    rows = bl.kept(reviewed(spark, sf_dir, PROMPTED))
    return rows.select(
        *BLOCK,
        F.size("turns").cast("bigint").alias("n_turns"),
        "n_tokens",
        F.coalesce("outcome", F.lit("valid")).alias("outcome"),
    )


@query
def valid_blocks(spark, sf_dir):
    merged = tn.merge_runs(kept(spark, sf_dir), CFG.line_prefix)
    broken = lambda: F.coalesce(tn.violation(F.col("turns")), F.lit("none"))
    trimmed = tn.trim_ends(merged.withColumn("before_trim", broken()))
    return trimmed.select(*BLOCK, "before_trim", broken().alias("after_trim"))


@query
def train_blocks(spark, sf_dir):
    return flat_messages(training_records(spark, sf_dir))


def flat_messages(blocks: DataFrame) -> DataFrame:
    others = [c for c in blocks.columns if c != "messages"]
    return blocks.select(
        *others, F.posexplode("messages").alias("turn_no", "turn")
    ).select(*others, F.col("turn_no").cast("bigint").alias("turn_no"), "turn.*")


@query
def processed_chats(spark, sf_dir):
    rows = runs.processed_blocks(reviewed(spark, sf_dir), CFG.whole_chat_rows)
    return rows.select("*", F.posexplode_outer("messages").alias("turn_no", "turn")).select(
        "chat_key",
        "contact_name",
        "chat_type",
        "num_blocks",
        "block_no",
        F.col("turn_no").cast("bigint").alias("turn_no"),
        "turn.timestamp",
        "turn.role",
        "turn.content",
    )


# Statistics -----------------------------------------------------------------


@query
def block_funnel(spark, sf_dir):
    return stats.block_funnel(reviewed(spark, sf_dir))


@query
def chat_stats(spark, sf_dir):
    return stats.chat_stats(reviewed(spark, sf_dir))


@query
def block_breakdown(spark, sf_dir):
    return stats.block_breakdown(reviewed(spark, sf_dir))


@query
def block_durations(spark, sf_dir):
    return stats.block_durations(valid(spark, sf_dir)).select(*BLOCK, "duration_minutes")


@query
def top_chats(spark, sf_dir):
    return stats.top_chats(stats.block_breakdown(reviewed(spark, sf_dir)))


@query
def top_n_others(spark, sf_dir):
    return stats.top_n_others(stats.block_breakdown(reviewed(spark, sf_dir)))


@query
def sender_ranking(spark, sf_dir):
    ranked = stats.sender_ranking(ad.chat_raw(spark, sf_dir))
    return ranked.select(
        "sender", "n_messages", "first_seen.chat_key", "first_seen.pos"
    )


# Training text --------------------------------------------------------------


@query
def standardize_roles(spark, sf_dir):
    turns = ad.table(spark, sf_dir, "conversations")
    old = F.col("conv_id") % 2 == 1
    role = F.when(F.col("role") == "user", "human").when(
        F.col("role") == "assistant", "GPT"
    )
    message = F.struct(
        F.when(~old, F.col("role")).alias("role"),
        F.when(~old, F.col("text")).alias("content"),
        F.when(old, role.otherwise(F.col("role"))).alias("from"),
        F.when(old, F.col("text")).alias("value"),
    )
    given = turns.select("conv_id", "turn", F.array(message).alias("messages"))
    return training.standardize(given).select("conv_id", "turn", F.inline("messages"))


@query
def render_template(spark, sf_dir):
    given = training_records(spark, sf_dir, PROMPTED)
    rendered = given
    for column, name in (
        ("chatml", "chatml"),
        ("llama_3_2", "llama-3.2"),
        ("gemma_3", "gemma-3"),
        ("mistral", "mistral"),
    ):
        rendered = training.render_records(rendered, name).withColumnRenamed("text", column)
    return rendered.drop("messages")


@query
def render_prompt(spark, sf_dir):
    """Prompt for the last reply of every record, with one more user message."""
    given = training_records(spark, sf_dir)
    asked = F.struct(
        F.lit("user").alias("role"), dialogue.prompt_text(F.lit("Really?")).alias("content")
    )
    requests = given.withColumn("messages", F.array_append("messages", asked))
    return training.render_prompts(requests, "llama-3.1").drop("messages")


def model_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base model and a template name per event."""
    offered = list(MODEL_TEMPLATES)
    pick = F.col("event_id") % 6
    model = (
        F.when(pick == 0, offered[0])
        .when(pick == 1, offered[1])
        .when(pick == 2, offered[2])
        .when(pick == 3, "tests/small-gemma-chat")
        .when(pick == 4, "tests/plain-chat")
        .otherwise("tests/tiny-llama-chat")
    )
    named = F.col("event_id") % 5
    template = (
        F.when(named == 0, "chatml")
        .when(named == 1, "llama-3.2")
        .when(named == 2, "gemma-3")
        .otherwise("mistral")
    )
    return ad.table(spark, sf_dir, "events").select(
        "event_id", model.alias("model"), template.alias("template")
    )


@query
def response_markers(spark, sf_dir):
    rows = training.add_markers(model_choices(spark, sf_dir), "template", "model")
    return rows.select(
        "event_id",
        F.coalesce("instruction_marker", F.lit("none")).alias("instruction_marker"),
        F.coalesce("response_marker", F.lit("none")).alias("response_marker"),
    )


@query
def model_template(spark, sf_dir):
    choices = model_choices(spark, sf_dir).select("event_id", "model")
    return ledger.with_model_template(choices, "model")


@query
def response_spans(spark, sf_dir):
    rendered = training.render_records(training_records(spark, sf_dir), "llama-3.2")
    named = rendered.withColumns(
        {"template": F.lit("llama-3.2"), "model": F.lit(FineTuneConfig().model_name)}
    )
    marked = training.add_markers(named, "template", "model").drop(
        "messages", "template", "model"
    )
    return training.response_spans(marked).select(
        *BLOCK, F.col("span").cast("bigint").alias("span"), "text", "is_target"
    )


@query
def seq_length_check(spark, sf_dir):
    documents = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    return training.check_length(documents).drop("text")


@query
def typed_metadata(spark, sf_dir):
    event, pick = F.col("event_id"), F.col("event_id") % 12
    number = event.cast("string")
    value = (
        F.when(pick == 0, "TRUE")
        .when(pick == 1, "false")
        .when(pick == 2, number)
        .when(pick == 3, F.concat(F.lit("-"), number))
        .when(pick == 4, F.concat(number, F.lit(".")))
        .when(pick == 5, F.concat(F.lit("."), number))
        .when(pick == 6, F.concat(F.lit("-"), number, F.lit(".25")))
        .when(pick == 7, F.concat(number, F.lit("e-4")))
        .when(pick == 8, F.concat(F.lit("['q_proj', '"), number, F.lit("']")))
        .when(pick == 9, F.concat(F.lit("[q_proj, "), number))
        .when(pick == 10, F.concat(F.lit("[oops "), number, F.lit("]")))
        .otherwise(F.col("event_type"))
    )
    entries = ad.table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    typed = training.typed_metadata(entries)
    return typed.select(
        "event_id",
        "kind",
        "value_bool",
        "value_long",
        "value_double",
        F.array_join("value_list", "|").alias("value_list"),
        "value_str",
    )


@query
def split_reply(spark, sf_dir):
    replies = flat_messages(training_records(spark, sf_dir)).filter("role = 'assistant'")
    rows = dialogue.split_reply(replies.drop("role"), "content")
    return rows.withColumn("part", F.col("part").cast("bigint"))


@query
def rolling_history(spark, sf_dir):
    turns = ad.table(spark, sf_dir, "conversations")
    history = dialogue.rolling_history(turns, "conv_id", "turn", "text", CFG.rows_per_segment)
    return history.union().select("conv_id", "turn", "history_messages", "history_chars")


@query
def recent_history(spark, sf_dir):
    """What every user turn sends with a history of three turns."""
    turns = ad.table(spark, sf_dir, "conversations")
    histories = dialogue.recent_histories(
        turns, "conv_id", "turn", ["role", "text"], 3, CFG.rows_per_segment, F.col("role") == "user"
    )
    line = lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["text"], F.lit("")))
    return histories.select(
        "conv_id",
        "turn",
        "n_earlier",
        F.size("history").cast("bigint").alias("n_history"),
        F.array_join(F.transform("history", line), "\n").alias("prompt"),
    )


@query
def validate_requests(spark, sf_dir):
    event = F.col("event_id")
    hashed = F.md5(event.cast("string"))
    message = F.struct(F.lit("user").alias("role"), F.col("props").alias("content"))
    requests = ad.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(event % 5 == 1, F.upper(hashed))
        .when(event % 5 == 2, F.substring(hashed, 1, 31))
        .otherwise(hashed)
        .alias("run_id"),
        F.when(event % 7 != 3, F.array(message)).alias("messages"),
        F.when(event % 3 != 1, F.col("value") / 50 - 0.1).alias("temperature"),
    )
    return dialogue.validate_requests(requests).select(
        "event_id", "temperature", "is_valid", F.coalesce("reason", F.lit("ok")).alias("reason")
    )


# Ledger ---------------------------------------------------------------------


def ledger_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "run_id", "type", "status", seconds("created_at").alias("created_at")
    )


@query
def ledger_filter(spark, sf_dir):
    rows = ledger.filter_ledger(
        ad.ledger(spark, sf_dir), ["queued", "failed"], ["data-prep"], "A[0-4]"
    )
    return ledger_columns(rows)


@query
def ledger_sorted(spark, sf_dir):
    return ledger_columns(ledger.newest_first(ad.ledger(spark, sf_dir)))


@query
def queue_position(spark, sf_dir):
    rows = ledger.queue_position(ad.ledger(spark, sf_dir), CFG.rows_per_segment)
    return rows.select("run_id", "type", "position")


def own_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run ids of the users whose number ends in 3."""
    events = ad.table(spark, sf_dir, "events").filter("user_id % 10 = 3")
    return events.select(F.md5(F.col("event_id").cast("string")).alias("run_id"))


@query
def my_runs(spark, sf_dir):
    return ledger_columns(ledger.my_runs(ad.ledger(spark, sf_dir), own_runs(spark, sf_dir)))


@query
def queue_with_created(spark, sf_dir):
    jobs = ad.ledger(spark, sf_dir)
    queue = ledger.queue_position(jobs, CFG.rows_per_segment)
    known = jobs.filter(F.col("created_at") < F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    rows = ledger.queue_with_created(queue.select("run_id", "position"), known)
    return rows.withColumn("created", F.substring("created", 1, 19))


@query
def new_submissions(spark, sf_dir):
    """Submissions are named after a user, so many repeat or are known already."""
    events = ad.table(spark, sf_dir, "events")
    batch = events.select(
        F.md5(F.col("user_id").cast("string")).alias("run_id"),
        "event_id",
        seconds(F.col("ts").cast("timestamp_ntz")).alias("submitted"),
    )
    known = events.filter("event_type = 'error' and value > 90").select(
        F.md5(F.col("user_id").cast("string")).alias("run_id")
    )
    return ledger.new_submissions(batch, known, ["submitted", "event_id"])


@query
def ledger_union(spark, sf_dir):
    jobs = ad.ledger(spark, sf_dir)
    jobs = jobs.withColumn("status", F.when(F.col("status") != "running", F.col("status")))
    prep, tune = (
        jobs.filter(F.col("type") == kind).drop("type") for kind in (ledger.PREP, ledger.TUNE)
    )
    rows = ledger.union_jobs(prep, tune)
    return rows.select("run_id", "type", "status", "error")


@query
def queue_summary(spark, sf_dir):
    return ledger.queue_summary(ad.ledger(spark, sf_dir))


@query
def latest_status(spark, sf_dir):
    transitions = ad.table(spark, sf_dir, "events").select(
        F.md5(F.col("user_id").cast("string")).alias("run_id"),
        ad.status_of(F.col("event_type")).alias("status"),
        "ts",
        "event_id",
    )
    return ledger.latest_status(transitions, ["ts", "event_id"])


# Files ----------------------------------------------------------------------


def exported(spark: SparkSession, sf_dir: str, with_bad_files: bool = False) -> str:
    path = scratch_path(spark, "exports")
    ad.write_exports(spark, sf_dir, path, with_bad_files)
    return path


def written_run(spark: SparkSession, sf_dir: str) -> str:
    """Base folder of a whole run over exported documents."""
    documents = exports.read_documents(spark, exported(spark, sf_dir))
    base = scratch_path(spark, "runs")
    write_run(exports.read_exports(documents), [base], RUN_ID, CFG)
    return base


@query
def read_exports(spark, sf_dir):
    documents = exports.read_documents(spark, exported(spark, sf_dir))
    rows = exports.export_messages(exports.read_exports(documents))
    return rows.select("name", "type", F.col("from").alias("sender"), "date", body_text().alias("body"))


@query
def read_export_dir(spark, sf_dir):
    path = scratch_path(spark, "chats")
    ad.write_chat_files(spark, sf_dir, path)
    chats = exports.read_export_dir(spark, path, glob="*.txt")
    n = exports.n_messages("chat")
    return chats.select("name", "type", n.cast("bigint").alias("n_messages"))


def document_number(source: str = "source") -> Column:
    return F.regexp_extract(source, r"doc=(\d+)", 1).cast("bigint")


@query
def export_file_report(spark, sf_dir):
    documents = exports.read_documents(spark, exported(spark, sf_dir, True))
    report = exports.export_file_report(documents)
    return report.select(
        document_number().alias("doc"), "status", F.col("n_chats").cast("bigint").alias("n_chats")
    )


@query
def split_exports(spark, sf_dir):
    """The messages of ``read_exports``, with every document read in byte ranges."""
    rows = split.split_messages(split.split_exports(spark, exported(spark, sf_dir)))
    return rows.select("name", "type", F.col("from").alias("sender"), "date", body_text().alias("body"))


@query
def split_file_report(spark, sf_dir):
    report = split.split_exports(spark, exported(spark, sf_dir, True)).report
    return report.select(
        document_number().alias("doc"), "status", F.col("n_chats").cast("bigint").alias("n_chats")
    )


@query
def write_raw(spark, sf_dir):
    base = written_run(spark, sf_dir)
    lines = spark.read.text(runs.dataset_path(base, RUN_ID, runs.RAW))
    chat = F.from_json("value", "name string, type string, messages array<string>")
    return lines.select(
        chat["name"].alias("name"),
        chat["type"].alias("type"),
        F.size(chat["messages"]).cast("bigint").alias("n_messages"),
    )


@query
def read_train_jsonl(spark, sf_dir):
    base = written_run(spark, sf_dir)
    path = runs.dataset_path(base, RUN_ID, runs.TRAIN)
    return flat_messages(records.read_train_jsonl(spark, path))


@query
def run_metadata(spark, sf_dir):
    totals = stats.chat_stats(reviewed(spark, sf_dir))
    entries = runs.run_metadata(totals, RUN_ID, CFG, FineTuneConfig())
    return training.typed_metadata(entries).select(
        "key", "value", "kind", "value_long", "value_double"
    )


@query
def write_run_layout(spark, sf_dir):
    base = written_run(spark, sf_dir)
    lines = spark.read.text(base)
    return lines.groupBy("run_id", F.col("data").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


@query
def list_runs(spark, sf_dir):
    base = scratch_path(spark, "runs")
    lines = training_records(spark, sf_dir).select(
        F.md5(F.floor(F.col("chat_key") / 10).cast("string")).alias("run_id"),
        F.to_json(F.struct("messages")).alias("value"),
    )
    runs.write_dataset(lines, [base], runs.TRAIN)
    return records.list_runs(spark, base)


@query
def incremental_prep(spark, sf_dir):
    """Two calls over one landing folder; the second finds nothing new."""
    landing, out = exported(spark, sf_dir, True), scratch_path(spark, "incremental")
    for _ in range(2):
        started = incremental.start_incremental(
            spark, landing, out, f"{out}/checkpoint", CFG
        )
        started.awaitTermination()
    of = lambda dataset: F.count_if(F.col("data") == dataset)
    lines = spark.read.text(f"{out}/runs").groupBy("run_id")
    written = lines.agg(of(runs.TRAIN).alias("n_train"), of(runs.METADATA).alias("n_metadata"))
    done = incremental.read_ledger(spark, out).join(written, "run_id", "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return done.select(
        document_number().alias("doc"),
        "status",
        F.coalesce("error", F.lit("")).alias("error"),
        count("n_chats"),
        count("num_blocks"),
        count("n_train"),
        count("n_metadata"),
    )
