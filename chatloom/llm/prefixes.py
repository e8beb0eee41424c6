"""Prefix trie of conversations, screened by a count-min sketch.

A conversation is rebuilt from the first turns of its group's first conversation
and its own later turns. A node of the trie is a distinct sequence of first
turns. Its digest is the exclusive-or of one 128-bit value per depth and turn,
so that all prefixes of a conversation are one running exclusive-or and the
pieces of a very long conversation are digested apart.

1. Turns are hashed where they are read; only hashes and lengths are shuffled.
   A conversation is a row of arrays, one above ``whole_turns`` turns several
   rows of consecutive turns.
2. All prefix digests go into a count-min sketch whose cells stop at two. Its
   size follows the number of prefixes up to ``MAX_WIDTH`` cells a row, and only
   the bits "two or more" are broadcast (6 MB at most). A prefix with a cell
   below two occurs once for certain, and so do all longer ones: this tail is
   emitted where its conversation is, with no shuffle but one row for its parent.
   A full sketch proves less and shuffles more; results stay the same.
3. Possibly shared prefixes are grouped exactly by depth and digest.
4. A node belongs to its smallest member. Sums over a subtree need no walk: the
   nodes that a conversation owns are the lower end of its path, so a subtree's
   sum is the owner's running sum from below plus the totals of the owners that
   pass through the node, added while their prefixes are grouped.
5. Ends are joined and hashed in a stream: range-sorted ids become strings of
   bounded size, and one running SHA-256 a node reads them in order.

Defined results: rows without ``conv_id`` belong to no conversation; missing
roles and texts are empty; turns of equal number follow the MD5 of length of
role, colon, role and text, and repeated rows are repeated turns; an empty table
has no nodes, not even a root; texts may have any length; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.scan import combine, lists, mix
from chatloom.operators.ordering import add_running_sum, order_rows
from chatloom.session import land, scratch_scope, ship_package

GROUP = 100  # a conversation starts like the first of its hundred
HEADS = 6  # with 0 to 5 turns of it
WHOLE_TURNS = 10_000
SKETCH_ROWS = 3
MIN_WIDTH, MAX_WIDTH = 1 << 13, 1 << 24
BLOCK = 1 << 13  # cells
IDS_AT_ONCE = 50_000


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn"),
        F.unhex(F.md5(named)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )


def _pieces(conversations: DataFrame, whole_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """``conv, offset, n_own, turns``: sorted turns with the number of turns before them.

    Ordinary conversations are one row each; the second table, if any, holds
    the pieces of the others.
    """
    turns = _turns(conversations)
    rows = order_rows(turns, ["conv"], ["turn", "digest"], whole_turns, counted=turns.select("conv"))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "digest", "chars")))
    bare = F.transform(sorted_turns, lambda t: F.struct(t.digest.alias("digest"), t.chars.alias("chars"))).alias("turns")
    light = rows.light.groupBy("conv").agg(bare)
    light = light.select("conv", F.lit(0).cast("bigint").alias("offset"), F.size("turns").cast("bigint").alias("n_own"), "turns")
    if rows.heavy is None:
        return land(light, "prefix-light"), None
    own = Window.partitionBy("conv")
    earlier = own.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("turns").cast("bigint")
    heavy = rows.heavy.groupBy("conv", "segment").agg(bare).select(
        "conv",
        F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("offset"),
        F.sum(size).over(own).alias("n_own"),
        "turns",
    )
    return land(light, "prefix-light"), land(heavy, "prefix-heavy")


_STEP = "array<struct<digest:binary,chars:bigint>>"


def _rebuilt(pieces: DataFrame, heads: DataFrame) -> DataFrame:
    """``conv, depth, length, steps``: the rebuilt turns, depths counted from ``depth``.

    The first piece of a conversation starts with an empty step for the root.
    """
    with_heads = pieces.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(heads, "base", "left")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    taken = F.slice(F.coalesce("head", F.array().cast(_STEP)), F.lit(1), F.col("h"))
    skipped = F.greatest(F.col("h") - F.col("offset"), F.lit(0)).cast("int")
    own = F.slice("turns", F.col("skipped") + 1, F.greatest(F.size("turns") - F.col("skipped"), F.lit(0)))
    root = F.array(F.struct(F.unhex(F.lit("00" * 16)).alias("digest"), F.lit(0).cast("bigint").alias("chars"))).cast(_STEP)
    first = F.col("offset") == 0
    n_head = F.size("taken")
    return (
        with_heads.withColumn("h", h)
        .withColumn("taken", taken)
        .withColumn("skipped", skipped)
        .select(
            "conv",
            F.when(first, 0).otherwise(F.greatest(F.col("offset") - F.col("h"), F.lit(0)) + n_head + 1).cast("bigint").alias("depth"),
            (F.greatest(F.col("n_own") - F.col("h"), F.lit(0)) + n_head).cast("bigint").alias("length"),
            F.when(first, F.concat(root, "taken", own)).otherwise(own).alias("steps"),
        )
        .filter(F.size("steps") > 0)
    )


_PATH = (
    "conv long, depth long, length long, before_a long, before_b long, a array<long>, b array<long>, chars array<long>"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix digests of every piece, continued from ``before_a, before_b``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        steps = batch.column("steps")
        sizes = np.diff(steps.offsets.to_numpy())
        flat = steps.flatten()
        turn = np.frombuffer(b"".join(flat.field("digest").to_pylist()), dtype=np.uint64).reshape(-1, 2)
        start = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        depth = batch.column("depth").to_numpy()[row] + np.arange(len(row)) - start[row]
        lanes = []
        for lane, name in enumerate(("before_a", "before_b")):
            value = combine(turn[:, lane], turn[:, 1 - lane], (depth + lane * (1 << 40)).astype(np.uint64))
            value[depth == 0] = 0
            total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(value)])
            carried = batch.column(name).to_numpy().view(np.uint64)
            lanes.append(total[1:] ^ (total[start] ^ carried)[row])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv", "depth", "length", "before_a", "before_b")),
                *(lists(sizes, pa.array(x.view(np.int64))) for x in lanes),
                lists(sizes, flat.field("chars")),
            ],
            ["conv", "depth", "length", "before_a", "before_b", "a", "b", "chars"],
        )


def _paths(pieces: DataFrame, heads: DataFrame, heavy: bool) -> DataFrame:
    """Pieces of rebuilt conversations with the digests of all their prefixes."""
    rebuilt = _rebuilt(pieces, heads)
    none = F.lit(0).cast("bigint")
    fresh = rebuilt.withColumns({"before_a": none, "before_b": none})
    if not heavy:
        return fresh.mapInArrow(_digest, _PATH)
    ends = fresh.mapInArrow(_digest, _PATH).select("conv", "depth", *(F.element_at(c, -1).alias(c) for c in "ab"))
    earlier = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv", "depth", *(F.coalesce(F.bit_xor(c).over(earlier), none).alias(f"before_{c}") for c in "ab"))
    return rebuilt.join(land(carried, "prefix-carried"), ["conv", "depth"]).mapInArrow(_digest, _PATH)


def _cells(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Cell of every prefix of a batch in each row of the sketch."""
    a, b = (batch.column(c).flatten().to_numpy().view(np.uint64) for c in "ab")
    for values in (a, b, mix(a ^ mix(b)))[:SKETCH_ROWS]:
        yield (values & np.uint64(width - 1)).astype(np.int64)


def _sketch(width: int):
    """Blocks of a partition's sketch that are not empty; cells stop at two."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((SKETCH_ROWS, width), dtype=np.uint8)
        for batch in batches:
            for row, at in enumerate(_cells(batch, width)):
                where, n = np.unique(at, return_counts=True)
                cells[row, where] = np.minimum(cells[row, where] + np.minimum(n, 2), 2)
        blocks = cells.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for first in range(0, len(used), 256):
            some = used[first : first + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "cells"]
            )

    return apply


def _merge(group: pa.Table) -> pa.Table:
    """Bits of the cells of one block that were met twice or more."""
    total = np.zeros(BLOCK, dtype=np.uint8)
    for cells in group.column("cells").to_pylist():
        total = np.minimum(total + np.frombuffer(cells, dtype=np.uint8), 2).astype(np.uint8)
    bits = np.packbits(total == 2, bitorder="little").tobytes()
    return pa.Table.from_arrays([group.column("block").slice(0, 1).combine_chunks(), pa.array([bits], pa.binary())], ["block", "bits"])


def _screen(shared, width: int):
    """Depth of the first prefix of each piece that occurs once for certain, or null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((SKETCH_ROWS * width // BLOCK, BLOCK // 8), dtype=np.uint8)
        for block, found in shared.value:
            bits[block] = np.frombuffer(found, dtype=np.uint8)
        bits = bits.reshape(SKETCH_ROWS, -1)
        for batch in batches:
            sizes = np.diff(batch.column("a").offsets.to_numpy())
            single = np.zeros(int(sizes.sum()), dtype=bool)
            for row, at in enumerate(_cells(batch, width)):
                single |= (bits[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
            start = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(single)
            k = np.searchsorted(hits, start)
            has = k < len(hits)
            first = hits[np.minimum(k, len(hits) - 1)] if len(hits) else start
            has &= first < start + sizes
            depth = batch.column("depth").to_numpy() + first - start
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depth, pa.int64(), mask=~has)], [*batch.schema.names, "alone"])

    return apply


def _screened(paths: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Paths with ``alone``: the depth from which a conversation's prefixes are proven singletons.

    ``length + 1`` where no prefix is.
    """
    both = paths if heavy is None else paths.union(heavy)
    n = both.agg(F.sum(F.size("a"))).first()[0] or 0
    width = min(max(1 << (4 * n).bit_length(), MIN_WIDTH), MAX_WIDTH)
    blocks = both.select("a", "b").mapInArrow(_sketch(width), "block long, cells binary")
    merged = blocks.groupBy("block").applyInArrow(_merge, "block long, bits binary")
    shared = paths.sparkSession.sparkContext.broadcast([(r.block, bytes(r.bits)) for r in merged.collect()])
    schema = _PATH + ", alone long"
    beyond = F.col("length") + 1
    light = paths.mapInArrow(_screen(shared, width), schema).withColumn("alone", F.coalesce("alone", beyond))
    if heavy is None:
        return light
    pieces = heavy.mapInArrow(_screen(shared, width), schema)
    first = F.min("alone").over(Window.partitionBy("conv"))
    return light.union(pieces.withColumn("alone", F.coalesce(first, beyond)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, a, b, conv) to one row per node and run of ids."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b"))))
        ids = batch.column("conv").to_pylist()
        out, at = [], 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and keys[end] == keys[at] and end - at < IDS_AT_ONCE:
                end += 1
            out.append((*keys[at], ids[at], ",".join(map(str, ids[at:end]))))
            at = end
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "a", "b", "conv", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (depth, a, b, conv) to one SHA-256 per node."""
    key, state, done = None, None, []

    def rows():
        columns = list(zip(*done)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "a", "b", "ends"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids"))):
            if own != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows()
        done.clear()
    if key is not None:
        done.append((*key, state.hexdigest()))
        yield rows()


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends`` of the nodes where conversations end (``depth, a, b, conv``)."""
    order = ["depth", "a", "b", "conv"]
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    strings = ranged.mapInArrow(_joined, "depth long, a long, b long, conv long, ids string")
    whole = strings.repartition("depth", "a", "b").sortWithinPartitions(*order)
    return whole.mapInArrow(_hashed, "depth long, a long, b long, ends string")


def prefix_trie(conversations: DataFrame, whole_turns: int = WHOLE_TURNS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256`` (see the contract of the query)."""
    spark = conversations.sparkSession
    ship_package(spark)
    with scratch_scope(spark):
        light, heavy = _pieces(conversations, whole_turns)
        starts = light if heavy is None else light.union(heavy)
        heads = land(
            starts.filter((F.col("conv") % GROUP == 0) & (F.col("offset") < HEADS - 1))
            .groupBy(F.col("conv").alias("base"))
            .agg(F.sort_array(F.collect_list(F.struct("offset", F.slice("turns", 1, HEADS - 1).alias("turns")))).alias("parts"))
            .select("base", F.slice(F.flatten(F.col("parts.turns")), 1, HEADS - 1).alias("head")),
            "prefix-heads",
        )
        paths = land(_paths(light, heads, False), "prefix-paths")
        long_paths = None if heavy is None else land(_paths(heavy, heads, True), "prefix-long-paths")
        screened = land(_screened(paths, long_paths), "prefix-screened", outer=True)
    return _trie(screened, whole_turns)


KEY = ["depth", "a", "b"]


def _trie(screened: DataFrame, whole_turns: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    size = F.size("a")
    n_shared = F.least(F.greatest(F.col("alone") - F.col("depth"), zero), size).cast("int")
    cut = screened.withColumn("n_shared", n_shared)
    previous = lambda c: F.concat(F.array(f"before_{c}"), c)
    step = F.posexplode(F.arrays_zip(*(F.slice(x, F.lit(1), F.col("n_shared")).alias(n) for x, n in [
        (F.col("a"), "a"), (F.col("b"), "b"), (F.col("chars"), "chars"), (previous("a"), "up_a"), (previous("b"), "up_b"),
    ])))
    steps = cut.filter("n_shared > 0").select("conv", F.col("depth").alias("first"), step)
    nodes = land(
        steps.select((F.col("first") + F.col("pos")).alias("depth"), "col.*", "conv")
        .groupBy(*KEY)
        .agg(
            F.min("conv").alias("conv"),
            F.count(F.lit(1)).alias("n"),
            F.min("chars").alias("chars"),
            F.min("up_a").alias("up_a"),
            F.min("up_b").alias("up_b"),
        ),
        "prefix-nodes",
    )
    # The first node of every proven tail is a child of a possibly shared node.
    at = F.col("alone") - F.col("depth")
    tops = screened.filter((F.col("alone") > 0) & (at >= 0) & (at < size)).select(
        (F.col("alone") - 1).alias("up_depth"),
        *(F.element_at(previous(c), (at + 1).cast("int")).alias(f"up_{c}") for c in "ab"),
        "conv",
        "length",
    )
    inner = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("up_depth"), "up_a", "up_b", "conv", F.lit(None).cast("bigint").alias("length"))
    children = land(inner.union(tops), "prefix-children")
    up = {f"up_{c}": c for c in KEY}
    counts = children.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed(up)
    counted = land(
        nodes.join(counts, KEY, "left").select(*KEY, "conv", "n", "chars", F.coalesce("n_children", zero).alias("n_children")),
        "prefix-counted",
    )
    above = nodes.select(*(F.col(c).alias(f"up_{c}") for c in KEY), F.col("conv").alias("parent"))
    parents = land(
        children.join(above, list(up)).select("conv", (F.col("up_depth") + 1).alias("depth"), "parent", "length"),
        "prefix-parents",
    )
    # Sums over subtrees: owners from below, then what passes through.
    saved = counted.select("conv", (-F.col("depth")).alias("rise"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    ranked = order_rows(saved, ["conv"], ["rise"], whole_turns)
    below = add_running_sum(ranked, F.col("saved"), "below").union().select("conv", (-F.col("rise")).alias("depth"), "below")
    owners = counted.groupBy("conv").agg(
        F.sum((F.col("n") - 1) * F.col("chars")).alias("total"),
        F.min("depth").alias("top"),
        F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"),
    )
    passing = (
        cut.filter("n_shared > 0")
        .select("conv", "depth", "length", "alone", *(F.slice(c, F.lit(1), F.col("n_shared")).alias(c) for c in "ab"))
        .join(owners, "conv", "left")
        .withColumn("leaf", F.when(F.col("alone") <= F.col("length"), 1).otherwise(F.coalesce("leaf", zero)).cast("bigint"))
        .withColumn("total", F.coalesce("total", zero))
        .filter("leaf > 0 OR total > 0")
        .select("leaf", "total", F.coalesce("top", F.col("length") + 1).alias("top"), F.col("depth").alias("first"), F.posexplode(F.arrays_zip("a", "b")))
        .select((F.col("first") + F.col("pos")).alias("depth"), "col.*", "leaf", "total", "top")
        .groupBy(*KEY)
        .agg(
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.when(F.col("depth") < F.col("top"), F.col("total")).otherwise(zero)).alias("through"),
        )
    )
    is_end = (F.col("alone") > F.col("length")) & (F.col("depth") + size - 1 == F.col("length"))
    ends = screened.filter(is_end).select(
        F.col("length").alias("depth"), *(F.element_at(c, -1).alias(c) for c in "ab"), "conv"
    )
    no_end = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own_parent = parents.filter("length IS NULL").select("conv", "depth", "parent")
    shared_nodes = (
        counted.join(passing, KEY, "left")
        .join(_end_hashes(ends), KEY, "left")
        .join(below, ["conv", "depth"])
        .join(own_parent, ["conv", "depth"], "left")
        .select(
            "conv",
            "depth",
            "parent",
            "n",
            "n_children",
            F.coalesce("n_leaves", zero),
            F.col("below") + F.coalesce("through", zero),
            F.coalesce("ends", no_end),
        )
    )
    one = F.lit(1).cast("bigint")
    alone = lambda parent: [
        "conv",
        "depth",
        parent.alias("parent"),
        one.alias("n"),
        (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved"),
        F.when(F.col("depth") < F.col("length"), no_end).otherwise(F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("ends"),
    ]
    last = F.col("depth") + size - 1
    lower = F.greatest(F.when(F.col("alone") > 0, F.col("alone") + 1).otherwise(zero), F.col("depth"))
    tails = (
        screened.select("conv", "length", lower.alias("from"), last.alias("to"))
        .filter(F.col("from") <= F.col("to"))
        .select("conv", "length", F.explode(F.sequence("from", "to")).alias("depth"))
    )
    tail_parent = F.when(F.col("depth") > 0, F.col("conv"))
    tail_tops = parents.filter("length IS NOT NULL")
    return (
        shared_nodes.union(tails.select(*alone(tail_parent)))
        .union(tail_tops.select(*alone(F.col("parent"))))
        .toDF(*columns)
    )


def op11_prefixes(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
