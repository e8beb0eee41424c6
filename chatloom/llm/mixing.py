"""Mix sources to target weights along a time-varying curriculum.

Method: every source has a weight schedule over training time. Its integral is
the cumulative token demand of the source; inverting it gives each document,
which sits at a known token offset of its source, a training time. Documents
are then range-sorted by the training position that belongs to that time.

Everything is DataFrame code. No window holds a whole source: offsets are
prefix sums over hash buckets of about ``BUCKET_ROWS`` documents, then over
groups of buckets, then inside a bucket.

Defined results: a missing text has size 0 and takes nothing; a missing source
is a source of its own, last in order; repeated rows are separate documents; a
missing id hashes as the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import land

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_ROWS = 128
HASH_RANGE = 1 << 32


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame,
    weights=WEIGHTS,
    slopes=SLOPES,
    share: float = SHARE,
    epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """One row per source: size, target words, schedule slope and curriculum totals.

    ``sizes`` has ``source_key`` and ``size``. Words are dealt by weight; a
    source stops at ``epochs`` times its size and the excess goes to the others
    by weight, which is the water level found by one ordered pass over the
    sources. The windows hold one row per source, never documents.
    """
    everything = Window.partitionBy()
    sums = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranked = (
        sums.withColumn("rank", F.row_number().over(everything.orderBy("source_key")) - 1)
        .withColumn("weight", _cycle(weights, F.col("rank")).cast("double"))
        .withColumn("slope", _cycle(slopes, F.col("rank")).cast("double"))
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("wanted", F.sum("source_size").over(everything).cast("double") * share)
    )
    filled = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn(
        "full", F.col("cap") <= F.col("weight") * F.col("level")
    )
    open_level = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("weight"), -F.col("rank"), "level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * open_level["level"])
    with_target = leveled.withColumn("target", target)
    # Words dealt until time t: sum over sources of target * (t + slope * (t*t - t)).
    linear = F.sum(F.col("target") * (1 - F.col("slope"))).over(everything)
    square = F.sum(F.col("target") * F.col("slope")).over(everything)
    return with_target.select(
        "source_key", "source_size", "target", "slope",
        linear.alias("linear"), square.alias("square"),
    )


def training_time(fraction: Column, slope: Column) -> Column:
    """Time at which a source with weight 1 + slope * (2t - 1) has dealt ``fraction``."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * fraction)
    return F.when(slope == 0, fraction).otherwise((slope - 1 + root) / (2 * slope))


def curriculum_mix(
    docs: DataFrame,
    weights=WEIGHTS,
    slopes=SLOPES,
    share: float = SHARE,
    epochs: int = MOST_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: how often the mix takes it and at which positions.

    Columns: ``doc_id, size, source, source_size, target, taken`` and
    ``positions``, one training position in words per time it is taken.
    """
    spark = docs.sparkSession
    token = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), "1")
        .otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
        .alias("source_key"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        token.alias("token"),
    )
    sized = land(narrow, "mix-sizes")
    n_buckets = max(1, math.ceil(sized.count() / BUCKET_ROWS))
    per_group = max(1, math.isqrt(n_buckets))
    prefix = F.conv(F.substring("token", 1, 8), 16, 10).cast("bigint")
    rows = sized.withColumn("bucket", F.floor(prefix * n_buckets / HASH_RANGE))

    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    sums = land(sums.withColumn("group", F.floor(F.col("bucket") / per_group)), "mix-buckets")
    earlier = (Window.unboundedPreceding, -1)
    groups = sums.groupBy("source_key", "group").agg(F.sum("words").alias("words"))
    group_offset = F.coalesce(
        F.sum("words").over(Window.partitionBy("source_key").orderBy("group").rowsBetween(*earlier)),
        F.lit(0),
    )
    groups = groups.select("source_key", "group", group_offset.alias("group_offset"))
    inside = Window.partitionBy("source_key", "group").orderBy("bucket").rowsBetween(*earlier)
    offsets = (
        sums.withColumn("offset", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(groups, ["source_key", "group"])
        .join(source_targets(sized, weights, slopes, share, epochs), "source_key")
        .withColumn("offset", F.col("offset") + F.col("group_offset"))
        .drop("words", "group", "group_offset")
    )
    # A bucket's rows and its offset meet in one shuffle; no key is larger than a bucket.
    offsets = land(offsets, "mix-offsets")
    order = Window.partitionBy("source_key", "bucket").orderBy("token", "size").rowsBetween(*earlier)
    placed = (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .join(offsets, ["source_key", "bucket"])
        .withColumn("start", F.col("offset") + F.col("inside"))
    )
    middle = lambda epoch: F.col("start") + F.col("source_size") * epoch + F.col("size") / 2.0
    times = F.transform(
        F.filter(
            F.array(*[F.lit(float(e)) for e in range(epochs)]),
            lambda e: (F.col("size") > 0) & (middle(e) < F.col("target")),
        ),
        lambda e: training_time(middle(e) / F.col("target"), F.col("slope")),
    )
    position = lambda t: F.col("linear") * t + F.col("square") * t * t
    timed = placed.withColumn("times", times)
    return timed.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("size") * F.size("times")).cast("bigint").alias("taken"),
        F.transform("times", position).alias("positions"),
    )


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per take, range-sorted by training position."""
    takes = mixed.select(
        F.posexplode("positions").alias("epoch", "position"), "doc_id", "source", "size"
    )
    by = ["position", "doc_id"]
    dealt = takes.repartitionByRange(partitions, *by) if partitions else takes.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_report(docs)


def mix_report(docs: DataFrame) -> DataFrame:
    """Documents in training order; those the mix leaves out come last, spread by id."""
    mixed = curriculum_mix(docs).withColumn(
        "position", F.get("positions", F.lit(0))
    )
    last = F.lit(1e18) * (1 + F.abs(F.xxhash64("doc_id")) / float(1 << 63))
    ordered = (
        mixed.drop("positions", "source")
        .withColumn("rank_key", F.coalesce("position", last))
        .repartitionByRange("rank_key", "doc_id")
        .sortWithinPartitions("rank_key", "doc_id")
    )
    return ordered.select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 3).alias("position")
    )
