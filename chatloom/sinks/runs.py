"""Write the datasets of a run below ``<base>/run_id=<id>/data=<dataset>/``.

Every dataset is JSON lines. Writing replaces the partitions of the run it
writes and touches no others, so a repeated run leaves the same files.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.config import FineTuneConfig, PrepConfig
from chatloom.functions.text import iso_format
from chatloom.operators import blocks as bl
from chatloom.operators.ordering import add_row_number, order_rows
from chatloom.operators.turns import training_records, valid_blocks

FILES = "files.jsonl"
RAW, PROCESSED, TRAIN = "raw.json", "processed.json", "train.jsonl"
BREAKDOWN, METADATA = "breakdown.jsonl", "metadata.jsonl"


def write_dataset(
    lines: DataFrame, bases: Sequence[str], dataset: str, many_runs: bool = False, tasks: int | None = None
) -> None:
    """Write rows of ``run_id`` and ``value`` to every destination.

    Rows of many runs are gathered by run first, so that a run gets few files.
    With ``tasks`` that many tasks share the runs, since files cost more than
    bytes when runs are small; without, rebalancing splits a run that is too
    large for one task. Many runs are added to what is there, which
    ``clear_runs`` empties first: replacing renames one partition after the
    other on the driver.
    """
    rows = lines.select("value", "run_id", F.lit(dataset).alias("data"))
    if many_runs:
        rows = rows.repartition(tasks, "run_id") if tasks else rows.hint("rebalance", "run_id")
    for base in bases:
        (
            rows.write.mode("append" if many_runs else "overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id", "data")
            .text(base)
        )


def clear_runs(spark: SparkSession, bases: Sequence[str], run_ids: Sequence[str]) -> None:
    """Delete what earlier attempts have written of these runs."""
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for base in bases:
        store = new_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(new_path(base)):
            with ThreadPoolExecutor(16) as pool:
                # A missing folder is no error.
                list(pool.map(lambda run_id: store.delete(new_path(f"{base}/run_id={run_id}"), True), run_ids))


def dataset_path(base: str, run_id: str, dataset: str) -> str:
    return f"{base.rstrip('/')}/run_id={run_id}/data={dataset}"


def raw_lines(chats: DataFrame) -> DataFrame:
    """The accepted raw chats before any filter, one per line."""
    return chats.select("run_id", F.col("chat").alias("value"))


def processed_blocks(reviewed: DataFrame, whole_rows: int = 10_000) -> DataFrame:
    """One row per valid block of every kept chat, in the same form at any chat size.

    Columns: ``chat_key, contact_name, chat_type``, ``num_blocks`` of the whole
    chat, ``block_no`` from 0 in time order and ``messages``. A kept chat without
    valid blocks has one row with 0 blocks and no messages. ``whole_rows`` only
    decides how blocks are numbered, not what comes out.
    """
    turn = lambda t: F.struct(
        iso_format(t["ts"]).alias("timestamp"),
        t["role"].alias("role"),
        t["content"].alias("content"),
    )
    started = F.filter("turns", lambda t: t["ts"].isNotNull())
    keys = [c for c in ("run_id",) if c in reviewed.columns] + ["chat_key"]
    kept = bl.kept(reviewed)
    is_valid = F.col("outcome").isNull()
    valid = kept.filter(is_valid).select(
        *keys,
        F.get(started, 0)["ts"].alias("ts"),
        "block_start",
        F.transform("turns", turn).alias("messages"),
    )
    counted = kept.filter(is_valid).select(*keys)
    rows = order_rows(valid, keys, ["ts", "block_start"], whole_rows, counted=counted)
    numbered = add_row_number(rows, "number").union().drop("ts", "block_start")
    chats = kept.groupBy(*keys, "name", "type").agg(F.count_if(is_valid).alias("num_blocks"))
    return chats.join(numbered, keys, "left").select(
        *keys,
        F.col("name").alias("contact_name"),
        F.col("type").alias("chat_type"),
        "num_blocks",
        (F.col("number") - 1).alias("block_no"),
        "messages",
    )


def processed_lines(reviewed: DataFrame, whole_rows: int = 10_000) -> DataFrame:
    record = F.struct("contact_name", "chat_type", "num_blocks", "block_no", "messages")
    return processed_blocks(reviewed, whole_rows).select(
        "run_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("value")
    )


def train_lines(reviewed: DataFrame) -> DataFrame:
    """One block per line with roles and contents only."""
    records = training_records(valid_blocks(bl.kept(reviewed)))
    return records.select("run_id", F.to_json(F.struct("messages")).alias("value"))


def run_metadata(
    stats: DataFrame, run_id: str | None, cfg: PrepConfig, fine_tune: FineTuneConfig
) -> DataFrame:
    """(key, value) rows: options, ``stats_*`` totals and ``ft_*`` parameters.

    Without ``run_id`` the totals have one row per run and the result keeps the
    column ``run_id``.
    """
    tuning = {
        name: list(value) if isinstance(value, tuple) else value
        for name, value in asdict(fine_tune).items()
    }
    # The names of the options in the metadata.
    options = {
        "uuid": run_id,
        "model_id": fine_tune.model_name,
        "target_name": cfg.target_name,
        "system_prompt": cfg.system_prompt or None,
        "date_limit": cfg.date_limit or None,
        "convo_block_threshold_secs": cfg.gap_seconds,
        "min_tokens_per_block": cfg.min_tokens,
        "max_tokens_per_block": cfg.max_tokens,
        "message_delimiter": cfg.delimiter,
    }
    options.update({f"ft_{name}": value for name, value in tuning.items()})
    entries = [
        F.struct(
            F.lit(k).alias("key"),
            (F.col("run_id") if k == "uuid" and run_id is None else F.lit(str(v))).alias("value"),
        )
        for k, v in options.items()
    ]
    entries += [
        F.struct(
            F.lit(f"stats_{name}").alias("key"),
            F.coalesce(F.col(name).cast("string"), F.lit("None")).alias("value"),
        )
        for name in stats.columns
        if name != "run_id"
    ]
    keys = ["run_id"] if run_id is None else []
    return stats.select(*keys, F.inline(F.array(*entries)))


def metadata_map(entries: DataFrame) -> DataFrame:
    """The metadata rows of one run, a few dozen, as one map."""
    return entries.agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata")
    )
