"""Remove byte strings that occur more than once anywhere in the corpus.

A window is a string of ``WINDOW`` bytes at one start; windows that also start
elsewhere are removed. All suffixes of a large corpus cannot be sorted, so the
suffixes are sampled and refined block by block:

1. Cover sample. A position is sampled when its 16-byte hash is the smallest of
   the ``REACH`` starts before and after it that share a window with it. Equal
   windows hold the same sample positions, so any two suffixes that tie for
   ``WINDOW`` bytes have a common offset in the sample, which is what a
   difference cover grants; chosen by content, the sample is about forty times
   sparser than a periodic one. The rank of a sample position is the class of
   the ``CORE`` bytes behind it, counted over the whole corpus. Suffixes whose
   sample rank is unique cannot repeat and are done.
2. Buckets. The suffixes with the same rank and the same distances to their
   sample position form a bucket. A bucket is a run of neighbouring suffixes,
   known by the bytes that all of them share (its core) and by all their bytes
   (its union). Equal unions mean that all its suffixes repeat; a core that
   occurs once means that none does; else the bucket is cut into smaller ones,
   down to single suffixes. Only one member of each union class goes on, so
   that copies are compared once, and each step compares buckets of one size.

Ranks and classes are hashes of 64 bits over the bytes, counted by Spark with
partial sums, so that a string in a third of all documents is no hot task. The
driver collects nothing. Texts are shuffled by their key twice: once to cut out
the bytes around unresolved sample positions, once to remove the spans.

Defined results: a missing text has no bytes; repeated rows are two documents
with the same text, which repeat each other; a missing id is an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.scan import Rolling, Slice, as_bytes, combine, slices
from chatloom.session import land, ship_package

WINDOW = 400
REACH = WINDOW // 2  # a suffix lies at most this far before its sample position
CORE = WINDOW - REACH
SEED = 16
# Suffixes per bucket in each refinement.
CUTS = (16, 1)


def sample_positions(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """Sample position, first and last window start that it serves.

    Each window start p is served by the smallest hash in [p, p + REACH], the
    leftmost on ties.
    """
    rolling = Rolling(piece.data)
    n = len(piece.data)
    none = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return none, none, none, rolling
    at = np.arange(n - SEED + 1)
    hashes = (rolling.spans(at, at + SEED) >> np.uint64(32)).astype(np.uint32)
    # Sliding minimum by doubling; keys are unique by position on comparison.
    span, width = hashes.copy(), 1
    where = at.astype(np.int32)
    total = REACH + 1
    while width < total:
        step = min(width, total - width)
        left, right = span[: len(span) - step], span[step:]
        take = right < left
        where = np.where(take, where[step:], where[: len(where) - step])
        span = np.where(take, right, left)
        width += step
    starts = np.arange(len(where))
    owner = piece.owner(starts)
    good = (starts + WINDOW <= piece.ends[owner]) & (starts < len(where))
    starts, serves = starts[good], where[starts[good]].astype(np.int64)
    if not len(starts):
        return none, none, none, rolling
    new = np.append(True, (serves[1:] != serves[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return serves[first], starts[first], starts[last], rolling


_ANCHOR = (
    T.StructType()
    .add("rank", T.LongType())
    .add("union", T.LongType())
    .add("at", T.IntegerType())
    .add("far", T.IntegerType())  # first suffix: at - far
    .add("near", T.IntegerType())  # last suffix: at - near
)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch.column("body")):
            at, first, last, rolling = sample_positions(piece)
            if not len(at):
                continue
            doc = piece.owner(at)
            far, near = at - first, at - last
            rank = rolling.spans(at, at + CORE)
            union = combine(rolling.spans(first, last + WINDOW), far.astype(np.uint64), near.astype(np.uint64))
            rows = pa.array(doc + piece.first)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(rows) for c in ("id", "text_key")],
                    pa.array(rank.view(np.int64)),
                    pa.array(union.view(np.int64)),
                    *[pa.array(x.astype(np.int32)) for x in (at - piece.starts[doc], far, near)],
                ],
                ["id", "text_key", *_ANCHOR.fieldNames()],
            )


def resolve(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated buckets, and one member of each class that needs a finer cut.

    ``buckets`` has ``rank, union, weight, id, text_key, at, far, near``; weight
    counts occurrences that a row stands for. Both results are landed.
    """
    place = F.struct("id", "text_key", "at", "far", "near", "weight")
    classes = land(
        buckets.groupBy("rank", "union").agg(F.sum("weight").alias("n"), F.min(place).alias("one")),
        "repeat-classes",
    )
    ranks = (
        classes.groupBy("rank")
        .agg(F.count_if(F.col("n") == 1).alias("single"), F.count(F.lit(1)).alias("classes"))
        .filter((F.col("single") > 0) & (F.col("classes") > 1))
        .select("rank")
    )
    ranks = land(ranks, "repeat-ranks")
    repeated = classes.filter("n > 1").select(F.col("rank").alias("r"), F.col("union").alias("u"))
    match = (F.col("rank") == F.col("r")) & (F.col("union") == F.col("u"))
    covered = land(buckets.join(repeated, match, "left_semi").select("id", "text_key", "at", "far", "near"), "repeat-found")
    unresolved = classes.join(ranks, "rank", "left_semi").select(
        "one.id", "one.text_key", "one.at", "one.far", "one.near",
        F.least("n", F.lit(2)).cast("bigint").alias("weight"),
    )
    return covered, unresolved


def text_key(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def by_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (id, text key); a missing id meets a missing id."""
    other = right.withColumnsRenamed({"id": "other_id", "text_key": "other_key"})
    match = (F.col("text_key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id"))
    return left.join(other, match, how)


_CONTEXT = T.StructType().add("begin", T.IntegerType()).add("bytes", T.BinaryType())


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of all suffixes of every bucket of a text."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column("body")[i].as_py() or "").encode()
            places = batch.column("places")[i].as_py()
            columns = {c: [x[c] for x in places] for c in ("at", "far", "near", "weight")}
            begins = [x["at"] - x["far"] for x in places]
            parts = [text[b : x["at"] - x["near"] + WINDOW] for b, x in zip(begins, places)]
            own = pa.array([i] * len(places), pa.int32())
            ints = [pa.array(columns[c], pa.int32()) for c in ("at", "far", "near")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(own) for c in ("id", "text_key")],
                    *ints,
                    pa.array(columns["weight"], pa.int64()),
                    pa.array(begins, pa.int32()),
                    pa.array(parts, pa.binary()),
                ],
                ["id", "text_key", "at", "far", "near", "weight", *_CONTEXT.fieldNames()],
            )


def finer_buckets(size: int):
    """Cut buckets into runs of at most ``size`` suffixes at fixed distances."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = Slice(0, batch.column("bytes").to_pylist())
            rolling = Rolling(piece.data)
            at, far, near, begin = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("at", "far", "near", "begin")
            )
            # Run k holds the suffixes with distances k * size to (k + 1) * size - 1.
            low_run, high_run = near // size, far // size
            count = high_run - low_run + 1
            row = np.repeat(np.arange(len(at)), count)
            run = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low_run[row]
            own_near = np.maximum(run * size, near[row])
            own_far = np.minimum(run * size + size - 1, far[row])
            origin = (piece.starts - begin + at)[row]  # of the sample position
            # The core is shared by the suffixes of a whole run, held or not,
            # so that it is the same for buckets cut off by their text.
            core = rolling.spans(
                origin - run * size, origin - (run * size + size - 1) + WINDOW
            )
            union = rolling.spans(origin - own_far, origin - own_near + WINDOW)
            rank = combine(core, run.astype(np.uint64))
            union = combine(union, own_far.astype(np.uint64), own_near.astype(np.uint64))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(rows) for c in ("id", "text_key")],
                    pa.array(rank.view(np.int64)),
                    pa.array(union.view(np.int64)),
                    batch.column("at").take(rows),
                    pa.array(own_far.astype(np.int32)),
                    pa.array(own_near.astype(np.int32)),
                    batch.column("weight").take(rows),
                ],
                ["id", "text_key", *_ANCHOR.fieldNames(), "weight"],
            )

    return apply


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (``id, text_key, start, end`` in bytes) of repeated windows, overlapping."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").alias("id"), text_key().alias("text_key"), F.col("text").alias("body"))
    keys = rows.schema.fields[:2]
    schema = T.StructType([*keys, *_ANCHOR.fields])
    sample = land(rows.mapInArrow(_sample, schema), "repeat-sample")
    # Counts are landed, so that the join has plain sides and a hot rank is split.
    shared = land(
        sample.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rank").alias("r")),
        "repeat-shared",
    )
    candidates = land(
        sample.join(shared, F.col("rank") == F.col("r"), "left_semi").withColumn("weight", F.lit(1).cast("bigint")),
        "repeat-candidates",
    )
    covered, unresolved = resolve(candidates)
    found = [covered]
    # One row per text with its buckets; a text bounds their number.
    listed = unresolved.groupBy("id", "text_key").agg(
        F.collect_set(F.struct("at", "far", "near", "weight")).alias("places")
    )
    named = T.StructType([*unresolved.schema.fields, *_CONTEXT.fields])
    cut = by_text(rows, listed, "inner").select("id", "text_key", "body", "places").mapInArrow(_cut_contexts, named)
    # Repeated rows gave the same context more than once.
    contexts = land(cut.dropDuplicates(["id", "text_key", "at", "far", "near"]), "repeat-contexts")
    finer = T.StructType([*schema.fields, T.StructField("weight", T.LongType())])
    for size in CUTS:
        buckets = land(contexts.mapInArrow(finer_buckets(size), finer), "repeat-buckets")
        covered, unresolved = resolve(buckets)
        found.append(covered)
        if size > 1:
            contexts = _narrow(contexts, unresolved)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("id", "text_key", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + WINDOW).alias("end"))


def _narrow(contexts: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Contexts of the unresolved runs, with the run's distances."""
    runs = unresolved.withColumnsRenamed({"id": "run_id", "text_key": "run_key", "at": "run_at", "far": "run_far", "near": "run_near", "weight": "run_weight"})
    match = (
        F.col("id").eqNullSafe(F.col("run_id"))
        & (F.col("text_key") == F.col("run_key"))
        & (F.col("at") == F.col("run_at"))
        & (F.col("run_far") <= F.col("far"))
        & (F.col("run_near") >= F.col("near"))
    )
    joined = contexts.join(runs, match)
    names = contexts.columns
    return land(
        joined.select(
            *[F.col({"far": "run_far", "near": "run_near", "weight": "run_weight"}.get(c, c)).alias(c) for c in names]
        ),
        "repeat-contexts",
    )


_REMOVED = (
    T.StructType()
    .add("n_bytes", T.LongType())
    .add("n_removed", T.LongType())
    .add("n_spans", T.LongType())
    .add("kept_sha256", T.StringType())
)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Disjoint runs of a union of spans; touching spans are one run."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("body"))
        rows = []
        for text, spans in zip(texts, batch.column("spans").to_pylist()):
            if not spans:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            runs = merged([s["start"] for s in spans], [s["end"] for s in spans])
            digest, at = hashlib.sha256(), 0
            for s, e in runs:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            rows.append((len(text), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
        columns = zip(*rows) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            ["id", *_REMOVED.fieldNames()],
        )


def removal_report(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what is left, per document."""
    spans = repeated_spans(docs)
    # Spans of one text, without repeats; a text bounds their number.
    listed = spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.col("doc_id").alias("id"), text_key().alias("text_key"), F.col("text").alias("body"))
    joined = by_text(rows, listed, "left").select("id", "body", "spans")
    schema = T.StructType([joined.schema["id"], *_REMOVED.fields])
    return joined.mapInArrow(_remove, schema).withColumnRenamed("id", "doc_id")


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
