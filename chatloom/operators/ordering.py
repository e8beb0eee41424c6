"""Ordered work per key when one key may hold a large share of all rows.

A window over ``partitionBy(key)`` puts every row of a key into one task. Keys
with more rows than a limit are therefore range-partitioned by (key, order)
once, written down with their segment number, and processed per (key, segment).
What a segment needs from the earlier ones is one small row per (key, segment).
Keys below the limit, normally all of them, keep the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import land


@dataclass(frozen=True)
class Ordered:
    """Rows with a total order inside each key.

    ``light`` holds whole keys of at most the row limit; ``heavy`` the other
    keys with an extra ``segment`` column, or None when there are none. Segment
    numbers of a key ascend with its order columns. ``stored`` is the written
    table behind ``heavy``, for aggregates that need no added column.
    """

    light: DataFrame
    heavy: DataFrame | None
    keys: tuple[str, ...]
    order: tuple[str, ...]
    stored: DataFrame | None = None

    def light_window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def segment_window(self):
        return Window.partitionBy(*self.keys, "segment").orderBy(*self.order)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """The same row-wise change on both parts."""
        heavy = None if self.heavy is None else change(self.heavy)
        return replace(self, light=change(self.light), heavy=heavy)

    def union(self) -> DataFrame:
        """Both parts as one DataFrame without segment numbers."""
        if self.heavy is None:
            return self.light
        return self.light.unionByName(self.heavy.drop("segment"))


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    whole_rows: int,
    segment_rows: int | None = None,
    counted: DataFrame | None = None,
    weight: Column | None = None,
    whole_weight: int | None = None,
) -> Ordered:
    """Split rows into light keys and heavy keys with more than ``whole_rows`` rows.

    With ``weight``, a column of the counted rows, keys that weigh more than
    ``whole_weight`` are heavy as well.

    Heavy keys are cut into segments of about ``segment_rows`` rows, which
    defaults to ``whole_rows``. ``order`` must be unique within a key. Sizes come from one partially
    aggregated count, of which a single row reaches the driver. ``counted`` may
    give rows that are cheaper to scan and hold at least the keys of ``df`` as
    often as ``df`` does.
    """
    keys, order = tuple(keys), tuple(order)
    sizes = (
        (df if counted is None else counted)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.lit(0) if weight is None else weight).alias("weight"),
        )
        .filter((F.col("n_rows") > whole_rows) | (F.col("weight") > (whole_weight or 0)))
    )
    found = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows")).first()
    if not found.n:
        return Ordered(df, None, keys, order)

    heavy_keys = land(sizes.select(*keys), "heavy-keys")
    heavy = (
        df.join(heavy_keys, list(keys), "left_semi")
        .repartitionByRange(math.ceil(found.rows / (segment_rows or whole_rows)), *keys, *order)
        .withColumn("segment", F.spark_partition_id())
    )
    light = df.join(heavy_keys, list(keys), "left_anti")
    # Range bounds are sampled anew by every job, so the numbers are written
    # down. One shuffle by segment then serves all windows and groups.
    stored = land(heavy, "segments")
    return Ordered(light, stored.repartition("segment"), keys, order, stored)


def add_previous(rows: Ordered, value: str, name: str) -> Ordered:
    """Value of the row before, NULL at the first row of a key."""
    light = rows.light.withColumn(name, F.lag(value).over(rows.light_window()))
    if rows.heavy is None:
        return replace(rows, light=light)
    source = rows.stored if value in rows.stored.columns else rows.heavy
    last = F.max_by(value, F.struct(*rows.order))
    before = F.lag("carried").over(_segments_of(rows))
    window = rows.segment_window()
    lagged = F.when(F.row_number().over(window) == 1, F.col("carried")).otherwise(
        F.lag(value).over(window)
    )
    heavy = _with_carried(rows, source, last, before).withColumn(name, lagged)
    return replace(rows, light=light, heavy=heavy.drop("carried"))


def add_running_sum(rows: Ordered, value: Column, name: str) -> Ordered:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    return _running_sum(rows, value.cast("bigint"), name, rows.heavy)


def _running_sum(
    rows: Ordered, value: Column, name: str, source: DataFrame | None
) -> Ordered:
    frame = (Window.unboundedPreceding, Window.currentRow)
    light = rows.light.withColumn(
        name, F.sum(value).over(rows.light_window().rowsBetween(*frame))
    )
    if rows.heavy is None:
        return replace(rows, light=light)
    earlier = _segments_of(rows).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("carried").over(earlier), F.lit(0))
    inside = F.sum(value).over(rows.segment_window().rowsBetween(*frame))
    heavy = _with_carried(rows, source, F.sum(value), before).withColumn(
        name, inside + F.col("carried")
    )
    return replace(rows, light=light, heavy=heavy.drop("carried"))


def add_row_number(rows: Ordered, name: str) -> Ordered:
    """1-based position within the key."""
    return _running_sum(rows, F.lit(1).cast("bigint"), name, rows.stored)


def _with_carried(
    rows: Ordered, source: DataFrame, per_segment: Column, before: Column
) -> DataFrame:
    """Heavy rows with ``carried``: what their segment takes over from earlier ones.

    The carried values, one row per key and segment, are written down, so that
    later steps do not compute them again.
    """
    segment = [*rows.keys, "segment"]
    sums = source.groupBy(*segment).agg(per_segment.alias("carried"))
    carried = land(sums.withColumn("carried", before), "carried")
    return rows.heavy.join(carried, segment)


def _segments_of(rows: Ordered):
    """Window over the segments of a key: one row per segment, not per message."""
    return Window.partitionBy(*rows.keys).orderBy("segment")
