"""The preparation plan: raw messages to reviewed blocks, and a whole run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import FineTuneConfig, PrepConfig
from chatloom.functions.text import parse_timestamp
from chatloom.functions.tokens import DEFAULT_COUNTER
from chatloom.operators import blocks as bl
from chatloom.operators import stats
from chatloom.operators.messages import candidates, usable_messages
from chatloom.operators.turns import reviewed_blocks
from chatloom.session import land, scratch_scope
from chatloom.sinks import runs
from chatloom.sources.exports import (
    WHOLE_BYTES,
    dir_file_report,
    export_file_report,
    export_messages,
    has_larger_files,
    read_documents,
    read_exports,
    single_chats,
)
from chatloom.sources.split import raw_lines, split_exports, split_messages


def message_blocks(
    messages: DataFrame, cfg: PrepConfig, counted: DataFrame | None = None
) -> DataFrame:
    """All pass-1 blocks of usable messages, with verdict.

    ``counted`` may give a superset of the messages that is cheaper to count.
    """
    low, high = cfg.token_limits
    rows = bl.chronological(
        messages, cfg.whole_chat_rows, cfg.rows_per_segment, counted, cfg.whole_chat_chars
    )
    blocks = bl.token_blocks(rows, cfg.gap_seconds, high)
    return bl.with_verdict(blocks, low, high)


def prepare_chats(raw: DataFrame, cfg: PrepConfig, counter=DEFAULT_COUNTER) -> DataFrame:
    """Raw messages to pass-1 blocks with ``verdict`` and pass-2 ``outcome``.

    One shuffle by chat carries ordinary chats through sessions, blocks and turns.
    """
    usable = usable_messages(raw, cfg, counter)
    blocks = message_blocks(usable, cfg, candidates(raw, cfg))
    return reviewed_blocks(blocks, cfg, counter)


def landed_messages(messages: DataFrame) -> DataFrame:
    """Messages as Parquet, with ``ts`` parsed for pushdown."""
    return land(messages.withColumn("ts", parse_timestamp(F.col("date"))), "messages")


def prepare_export(
    spark: SparkSession,
    path: str,
    bases: Sequence[str],
    run_id: str,
    cfg: PrepConfig,
    fine_tune: FineTuneConfig = FineTuneConfig(),
    counter=DEFAULT_COUNTER,
    one_chat_per_file: bool = False,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """A whole run from exported files; an input without any chat is an error.

    The verdict of every file is written as one more dataset of the run, so that
    files without chats leave a trace. Documents of more than ``whole_bytes`` are
    read in byte ranges, their messages never pass through a row per chat. In
    directory mode (``one_chat_per_file``) only ``*.json`` files are read, and the
    large ones may hold lists of chats as well.
    """
    glob = "*.json" if one_chat_per_file else None
    columns = ["source", "status", "n_chats"]
    with scratch_scope(spark):
        documents = read_documents(spark, path, glob, whole_bytes)
        if one_chat_per_file:
            chats, report = single_chats(documents), dir_file_report(documents)
        else:
            chats, report = read_exports(documents), export_file_report(documents)
        chats, report = land(chats, "chats"), report.select(columns)
        found = None
        if has_larger_files(spark, path, glob, whole_bytes):
            found = split_exports(spark, path, glob, whole_bytes)
            report = report.union(found.report.select(columns))
        if chats.isEmpty() and (found is None or found.chats.isEmpty()):
            raise ValueError(f"no valid chats in {path}")
        lines = report.select(F.lit(run_id).alias("run_id"), F.to_json(F.struct(*columns)).alias("value"))
        runs.write_dataset(lines, bases, runs.FILES)
        return _write_landed(chats, bases, run_id, cfg, fine_tune, counter, found)


def write_run(
    chats: DataFrame,
    bases: Sequence[str],
    run_id: str,
    cfg: PrepConfig,
    fine_tune: FineTuneConfig = FineTuneConfig(),
    counter=DEFAULT_COUNTER,
) -> DataFrame:
    """Prepare chats and write every dataset of the run; returns the stats row.

    Documents are parsed once: the chats, their messages and the reviewed blocks
    are landed as Parquet for the outputs that read them, and deleted at the end.
    """
    with scratch_scope(chats.sparkSession):
        return _write_landed(land(chats, "chats"), bases, run_id, cfg, fine_tune, counter)


def _write_landed(chats, bases, run_id, cfg, fine_tune, counter, found=None) -> DataFrame:
    spark = chats.sparkSession
    run = F.lit(run_id).alias("run_id")
    raw, messages = runs.raw_lines(chats.withColumn("run_id", run)), export_messages(chats)
    if found is not None:
        raw = raw.union(raw_lines(found).select(run, "value"))
        messages = messages.unionByName(split_messages(found))
    runs.write_dataset(raw, bases, runs.RAW)
    reviewed = land(prepare_chats(landed_messages(messages.withColumn("run_id", run)), cfg, counter), "blocks")
    write_outputs(reviewed, bases, cfg)
    totals = stats.chat_stats(reviewed)
    totals = spark.createDataFrame(totals.collect(), totals.schema)  # one row
    write_descriptions(totals.withColumn("run_id", F.lit(run_id)), reviewed, bases, cfg, fine_tune)
    return totals


def write_outputs(
    reviewed: DataFrame, bases: Sequence[str], cfg: PrepConfig, many_runs: bool = False, tasks: int | None = None
) -> None:
    """Processed blocks and training lines, each under its block's ``run_id``."""
    lines = runs.processed_lines(reviewed, cfg.whole_chat_rows)
    runs.write_dataset(lines, bases, runs.PROCESSED, many_runs, tasks)
    runs.write_dataset(runs.train_lines(reviewed), bases, runs.TRAIN, many_runs, tasks)


def write_descriptions(
    totals: DataFrame,
    reviewed: DataFrame,
    bases: Sequence[str],
    cfg: PrepConfig,
    fine_tune: FineTuneConfig,
    many_runs: bool = False,
    tasks: int | None = None,
) -> None:
    """Metadata and block breakdown of every run in ``totals`` (with ``run_id``)."""
    metadata = runs.run_metadata(totals, None, cfg, fine_tune)
    lines = metadata.select("run_id", F.to_json(F.struct("key", "value")).alias("value"))
    runs.write_dataset(lines, bases, runs.METADATA, many_runs, tasks)
    breakdown = stats.block_breakdown(reviewed, ["run_id"]).select(
        "run_id", F.to_json(F.struct("contact_name", "num_blocks")).alias("value")
    )
    runs.write_dataset(breakdown, bases, runs.BREAKDOWN, many_runs, tasks)
