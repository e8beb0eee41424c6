"""Ordered running values are the same with and without segments."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import ledger, ordering


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    keys = ["hot"] * 120 + ["a"] * 30 + ["b"] * 5
    return [(key, i, rng.randrange(100)) for i, key in enumerate(keys)]


def result(spark, rows, limit):
    frame = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    ordered = ordering.order_rows(frame, ["k"], ["i"], limit)
    for change in (
        lambda o: ordering.add_previous(o, "v", "before"),
        lambda o: ordering.add_running_sum(o, F.col("before"), "total"),
        lambda o: ordering.add_row_number(o, "place"),
    ):
        ordered = change(ordered)
    return sorted(map(tuple, ordered.union().collect())), ordered


@pytest.mark.parametrize("limit", [40, 10, 3])
def test_segments_change_nothing(spark, rows, limit):
    plain, whole = result(spark, rows, 1000)
    split, parts = result(spark, rows, limit)
    assert whole.heavy is None and parts.heavy is not None
    assert split == plain


def test_segments_are_ordered_and_bounded(spark, rows):
    _, parts = result(spark, rows, 10)
    sizes = parts.heavy.groupBy("segment").count().collect()
    assert max(r["count"] for r in sizes) <= 30
    bounds = (
        parts.heavy.filter("k = 'hot'").groupBy("segment")
        .agg(F.min("i").alias("low"), F.max("i").alias("high")).orderBy("segment").collect()
    )
    assert all(a.high < b.low for a, b in zip(bounds, bounds[1:]))


def test_queue_position_of_a_long_queue(spark):
    jobs = spark.range(200).selectExpr(
        "md5(cast(id as string)) as run_id", "'data-prep' as type", "'queued' as status",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at",
    )
    split = ledger.queue_position(jobs, 20).orderBy("run_id").collect()
    assert [r.position for r in split] == list(range(1, 201))
