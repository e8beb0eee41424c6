"""Prepare newly landed exports incrementally, one run per file.

A file source lists new documents without reading them; every micro-batch is one
plan over all its submissions, keyed by run. Documents of any size are read, the
large ones in byte ranges. A document that cannot be read becomes a failed row of
the ledger. Should a plan fail, its files are halved until the bad ones stand
alone: one bad file of ``n`` costs about ``2 log2(n)`` plans.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.config import FineTuneConfig, PrepConfig
from chatloom.functions.tokens import DEFAULT_COUNTER
from chatloom.operators import stats
from chatloom.operators.ledger import COMPLETED, FAILED, PREP, unknown_runs
from chatloom.plans.prepare import (
    landed_messages,
    prepare_chats,
    write_descriptions,
    write_outputs,
)
from chatloom.session import land, scratch_scope
from chatloom.sinks import runs
from chatloom.sources import exports, split

# Runs, and bytes of documents, that one task writes.
RUNS_PER_TASK, BYTES_PER_TASK = 50, 64 << 20

LEDGER = (
    "run_id string, source string, type string, status string, created_at timestamp,"
    " error string, n_chats int, num_chats bigint, num_blocks bigint,"
    " min_tokens_per_block bigint, max_tokens_per_block bigint, avg_tokens_per_block double,"
    " min_duration_minutes_per_block double, max_duration_minutes_per_block double,"
    " avg_duration_minutes_per_block double, started_at timestamp, completed_at timestamp,"
    " batch bigint"
)


def start_incremental(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    cfg: PrepConfig,
    counter=DEFAULT_COUNTER,
    files_per_batch: int = 100_000,
) -> StreamingQuery:
    """Process what has landed since the last call, then stop.

    Outputs go to ``<out>/runs``, the ledger to ``<out>/ledger``. All new files
    are processed, in batches of at most ``files_per_batch``.
    """
    # Contents are left out of the scan.
    submissions = listed(
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(landing)
    )

    def process(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, out, cfg, counter)

    return (
        submissions.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def listed(files: DataFrame) -> DataFrame:
    """Submissions of files given as rows of the ``binaryFile`` source."""
    return files.select(
        F.md5("_metadata.file_path").alias("run_id"),
        F.col("_metadata.file_path").alias("source"),
        F.col("modificationTime").alias("created_at"),
        "path",
        F.col("length").alias("size"),
    )


def process_batch(
    batch: DataFrame,
    batch_id: int,
    out: str,
    cfg: PrepConfig,
    counter=DEFAULT_COUNTER,
    fine_tune: FineTuneConfig = FineTuneConfig(),
    whole_bytes: int = exports.WHOLE_BYTES,
) -> None:
    """One plan for all submissions of a batch; repeating it changes nothing.

    Every run gets the datasets of a batch run. The names of a batch's files,
    not their contents, pass through the driver.
    """
    spark = batch.sparkSession
    earlier = read_ledger(spark, out).filter(F.col("batch") < batch_id)
    started = datetime.now()
    with scratch_scope(spark):
        # A file is listed once per batch, so its run_id cannot repeat inside it.
        files = unknown_runs(batch, earlier).orderBy("source").collect()
        done = _attempt(spark, files, lambda some: _prepare(spark, some, out, cfg, counter, fine_tune, whole_bytes))
        if done is None:
            done = spark.createDataFrame([], LEDGER).drop("batch")
        rows = done.withColumns(
            {"started_at": F.lit(started), "completed_at": F.lit(datetime.now())}
        )
        rows.write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id}")


def _attempt(spark: SparkSession, files: Sequence, prepare) -> DataFrame | None:
    """Ledger rows of ``files``; a failing set is halved down to its bad files."""
    if not files:
        return None
    try:
        return land(prepare(files), "ledger-rows")
    except Exception as error:  # one bad document must not stop the stream
        if len(files) == 1:
            report = _submitted(spark, files).withColumns({"status": F.lit(str(error)[:500]), "n_chats": F.lit(0)})
            return _ledger_rows(report)
    half = len(files) // 2
    first, second = (_attempt(spark, some, prepare) for some in (files[:half], files[half:]))
    return first.unionByName(second, allowMissingColumns=True)


def _submitted(spark: SparkSession, files: Sequence) -> DataFrame:
    rows = [(f.run_id, f.source, f.created_at) for f in files]
    return spark.createDataFrame(rows, "run_id string, source string, created_at timestamp")


def _literal(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _prepare(spark, files, out, cfg, counter, fine_tune, whole_bytes) -> DataFrame:
    """Write all datasets of all runs and return their ledger rows."""
    bases = [f"{out}/runs"]
    ids = _submitted(spark, files)
    small = [_literal(f.path) for f in files if f.size <= whole_bytes]
    large = [_literal(f.path) for f in files if f.size > whole_bytes]
    # Runs of large documents are split by rebalancing instead.
    tasks = None if large else max(len(files) // RUNS_PER_TASK, sum(f.size for f in files) // BYTES_PER_TASK) + 1
    runs.clear_runs(spark, bases, [f.run_id for f in files])
    report = raw = messages = None
    if small:
        texts = spark.read.text(small, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
        documents = exports.parse_documents(land(texts.join(ids, "source"), "submissions"))
        report = exports.export_file_report(documents)
        chats = exports.read_exports(documents).select("run_id", "chat_key", "name", "type", "chat")
        chats = land(chats, "chats")
        raw, messages = runs.raw_lines(chats), exports.export_messages(chats)
    if large:
        found = split.split_exports(spark, large)
        run = ids.select("source", "run_id")
        report = _plus(report, found.report.join(ids, "source"))
        raw = _plus(raw, split.raw_lines(found).join(run, "source").select("run_id", "value"))
        messages = _plus(messages, split.split_messages(found, run))
    report = land(report, "reports")
    runs.write_dataset(raw, bases, runs.RAW, many_runs=True, tasks=tasks)
    reviewed = land(prepare_chats(landed_messages(messages), cfg, counter), "blocks")
    write_outputs(reviewed, bases, cfg, many_runs=True, tasks=tasks)
    ok = report.filter(F.col("status") == exports.OK).select("run_id")
    found_stats = stats.chat_stats(reviewed, ["run_id"])
    counts = ["num_chats", "num_blocks"]  # a run without kept blocks has zeros
    totals = land(ok.join(found_stats, "run_id", "left").fillna(0, counts), "totals")
    write_descriptions(totals, reviewed, bases, cfg, fine_tune, many_runs=True, tasks=tasks)
    return _ledger_rows(report).join(totals, "run_id", "left")


def _plus(rows: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if rows is None else rows.unionByName(more)


def _ledger_rows(report: DataFrame) -> DataFrame:
    status = F.col("status")
    return report.select(
        "run_id",
        "source",
        F.lit(PREP).alias("type"),
        F.when(status == exports.OK, COMPLETED).otherwise(FAILED).alias("status"),
        "created_at",
        F.when(status != exports.OK, status).alias("error"),
        "n_chats",
    )


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """All ledger rows so far; empty before the first batch."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
