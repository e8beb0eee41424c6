"""The ledger of runs: ``run_id, type, status, created_at, error`` and more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.templates import MODEL_TEMPLATES
from chatloom.operators.ordering import add_row_number, order_rows

PREP, TUNE = "data-prep", "fine-tuning"
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"


def union_jobs(prep: DataFrame, tune: DataFrame) -> DataFrame:
    """Jobs of both services with their type; gaps get the display defaults."""

    def typed(jobs: DataFrame, kind: str) -> DataFrame:
        return jobs.withColumns(
            {
                "type": F.lit(kind),
                "status": F.coalesce("status", F.lit("unknown")),
                "error": F.coalesce("error", F.lit("")),
            }
        )

    return typed(prep, PREP).unionByName(typed(tune, TUNE))


def my_runs(ledger: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Ledger rows of the listed runs; Spark picks the join by measured size."""
    return ledger.join(run_ids.select("run_id").distinct(), "run_id", "left_semi")


def filter_ledger(
    ledger: DataFrame,
    statuses: list[str] | None = None,
    types: list[str] | None = None,
    run_id_pattern: str | None = None,
) -> DataFrame:
    """Apply the given filters; the pattern ignores case and may match anywhere."""
    if statuses:
        ledger = ledger.filter(F.col("status").isin(*statuses))
    if types:
        ledger = ledger.filter(F.col("type").isin(*types))
    if run_id_pattern:
        ledger = ledger.filter(F.col("run_id").rlike(f"(?i){run_id_pattern}"))
    return ledger


def newest_first(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("created_at"), "run_id")


def queue_position(ledger: DataFrame, whole_rows: int) -> DataFrame:
    """1-based position of queued runs per type, oldest first."""
    queued = ledger.filter(F.col("status") == QUEUED)
    rows = order_rows(queued, ["type"], ["created_at", "run_id"], whole_rows)
    return add_row_number(rows, "position").union()


def queue_summary(ledger: DataFrame) -> DataFrame:
    """Per type: whether a run is active, the queue size and all statuses."""
    status = F.col("status")
    return ledger.groupBy("type").agg(
        F.bool_or(status == RUNNING).alias("running"),
        F.count_if(status == QUEUED).alias("queue_size"),
        F.count_if(status == RUNNING).alias("n_running"),
        F.count_if(status == COMPLETED).alias("n_completed"),
        F.count_if(status == FAILED).alias("n_failed"),
    )


def queue_with_created(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue rows with the creation time of their job, '' when unknown."""
    created = jobs.groupBy("run_id").agg(
        F.max("created_at").cast("string").alias("created")
    )
    return queue.join(created, "run_id", "left").withColumn(
        "created", F.coalesce("created", F.lit(""))
    )


def new_submissions(batch: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Submissions whose run_id is new, the first one per run_id.

    The first row is taken by aggregation, which a repeated run_id cannot skew.
    """
    others = [c for c in batch.columns if c != "run_id"]
    first = (
        batch.groupBy("run_id")
        .agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first"))
        .select("run_id", "first.*")
    )
    return unknown_runs(first, ledger)


def unknown_runs(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose run_id the ledger does not hold.

    The ledger side is reduced to distinct ids, so repeated ids there cost nothing.
    """
    return batch.join(ledger.select("run_id").distinct(), "run_id", "left_anti")


def latest_status(events: DataFrame, order: list[str]) -> DataFrame:
    """Newest status per run from an append-only list of transitions."""
    return events.groupBy("run_id").agg(
        F.max_by("status", F.struct(*order)).alias("status"),
        F.count(F.lit(1)).alias("n_events"),
    )


def with_model_template(rows: DataFrame, model: str) -> DataFrame:
    """Add the chat template of a model by joining the fixed list of models."""
    entries = [
        F.struct(F.lit(name).alias(model), F.lit(template).alias("chat_template"))
        for name, template in MODEL_TEMPLATES.items()
    ]
    models = rows.sparkSession.range(1).select(F.inline(F.array(*entries)))
    return rows.join(F.broadcast(models), model, "left")
