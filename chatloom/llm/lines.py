"""Line dedup by an index of compact arrays.

A line's key is the line without ASCII blanks at its ends, in lower-case ASCII.
Keys of at least ``LEAST`` code points found in two documents keep their lines
only in the smallest document id that holds them.

Keys are hashed to 128 bits; one aggregate with map-side combination gives the
smallest and largest document and the number of documents of each hash. Hashes
of two documents or more are dealt to shards. A shard is one row: a minimal
perfect hash (levels of bit arrays, the keys that collide go on to the next
level) numbers its keys, and the arrays of fingerprints (64 bits), keeping
documents and counts stand in that order, about 20 bytes a key.

Documents probe the arrays, no line is joined. Up to ``INDEX_KEYS`` keys the
arrays are broadcast, which bounds the broadcast at 20 bytes a key. Beyond that
the keys with the largest counts are broadcast (so many that there cannot be
more than ``INDEX_KEYS``), and all other lines are sent to their shard's arrays;
no key left is frequent then, so no shard is hot.

Defined results: a missing or empty text is one empty line; rows that share an
id count as one document, as do all rows without an id, which comes after every
id; repeated rows have equal results; short and blank lines always stay; an
empty table gives no rows; texts of any length are read line by line; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chatloom.llm.scan import as_bytes, combine, lists
from chatloom.session import land, ship_package

LEAST = 10
BLANKS = b" \t\n\v\f\r"
SHARD_KEYS = 1 << 17
# Keys of the broadcast arrays; 2^22 of them take about 85 MB.
INDEX_KEYS = 1 << 22
ROUTED_LINES = 1 << 20  # lines that one shard answers when lines are sent to it
ROWS_AT_ONCE = 256


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """Key of a line, None when it is too short to be judged."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


class LineBatch:
    """Lines of some documents with the hashes of those that have a key."""

    def __init__(self, texts: list[bytes], least: int) -> None:
        self.lines = [t.split(b"\n") for t in texts]
        doc, at, digests = [], [], []
        for i, own in enumerate(self.lines):
            for j, line in enumerate(own):
                key = line_key(line, least)
                if key is not None:
                    doc.append(i)
                    at.append(j)
                    digests.append(hashlib.md5(key).digest())
        self.doc = np.array(doc, dtype=np.int64)
        self.at = np.array(at, dtype=np.int64)
        both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        self.high, self.low = both[:, 0], both[:, 1]


def _parts(batch: pa.RecordBatch, least: int) -> Iterator[tuple[pa.RecordBatch, LineBatch]]:
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(first, ROWS_AT_ONCE)
        yield part, LineBatch(as_bytes(part.column("body")), least)


def _held(least: int):
    """One row (high, low, doc_id) for each document and distinct key."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lines in _parts(batch, least):
                order = np.lexsort((lines.low, lines.high, lines.doc))
                rows = np.stack([lines.doc, lines.high, lines.low], axis=1)[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
                rows = rows[new]
                ids = part.column("doc_id").take(pa.array(rows[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2]), ids], ["high", "low", "doc_id"])

    return apply


def _placed(high: np.ndarray, low: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Bit of each key in the bit array of a level."""
    h = combine(high.view(np.uint64), low.view(np.uint64), np.full(len(high), level, dtype=np.uint64))
    return (h % np.asarray(size, dtype=np.uint64)).astype(np.int64)


def perfect_hash(high: np.ndarray, low: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bits of each level, all levels as 64-bit words, and the number of every key.

    Keys must be distinct. A key alone at its bit of a level is numbered by the
    set bits before it, the others go on to a smaller level.
    """
    left = np.arange(len(high))
    sizes, words, number, done = [], [], np.empty(len(high), dtype=np.int64), 0
    while len(left):
        size = 64 * math.ceil(len(left) / 64)
        bit = _placed(high[left], low[left], len(sizes), size)
        single = np.bincount(bit, minlength=size) == 1
        alone = single[bit]
        number[left[alone]] = done + np.cumsum(single)[bit[alone]] - 1
        done += int(single.sum())
        sizes.append(size)
        words.append(np.packbits(single, bitorder="little").view(np.uint64))
        left = left[~alone]
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64), number


_SHARD = "shard long, sizes array<long>, words binary, fingerprints binary, keepers binary, counts binary"


def _build(rows: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    high, low, keeper, n = (rows.column(c).to_numpy() for c in ("high", "low", "keeper", "n"))
    sizes, words, number = perfect_hash(high, low)
    order = np.argsort(number)
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.Table.from_arrays(
        [
            rows.column("shard").slice(0, 1).combine_chunks(),
            pa.array([sizes], pa.list_(pa.int64())),
            *map(blob, (words, low[order], keeper[order], np.minimum(n[order], 2**32 - 1).astype(np.uint32))),
        ],
        ["shard", "sizes", "words", "fingerprints", "keepers", "counts"],
    )


class LineIndex:
    """Arrays of shards ``first, first + 1, ...`` side by side."""

    def __init__(self, shards: list[dict], n_shards: int, first: int = 0) -> None:
        by_shard = {s["shard"]: s for s in shards}
        parts = [by_shard.get(first + k) for k in range(max(len(by_shard), 1) if first else n_shards)]
        self.n_shards, self.first = n_shards, first
        depth = max([0, *(len(p["sizes"]) for p in parts if p)])
        self.sizes = np.zeros((len(parts), depth), dtype=np.int64)
        for k, p in enumerate(parts):
            if p:
                self.sizes[k, : len(p["sizes"])] = p["sizes"]
        self.starts = (np.cumsum(self.sizes.ravel()) - self.sizes.ravel()).reshape(self.sizes.shape)
        array = lambda name, kind: np.frombuffer(b"".join(bytes(p[name]) for p in parts if p), dtype=kind)
        self.words = array("words", np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.fingerprints, self.keepers = array("fingerprints", np.int64), array("keepers", np.int64)
        self.counts = array("counts", np.uint32)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of every key in the arrays, -1 for keys that are not in the index."""
        place = np.full(len(high), -1, dtype=np.int64)
        if not len(self.words):
            return place
        shard = np.mod(high, self.n_shards) - self.first
        left = np.arange(len(high))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            bit = self.starts[shard[left], level] + _placed(high[left], low[left], level, size)
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            is_set = (word >> inside) & np.uint64(1) == 1
            rank = self.before[bit >> 6] + np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1)))
            hit = is_set & (self.fingerprints[np.where(is_set, rank, 0)] == low[left])
            place[left[hit]] = rank[hit]
            left = left[~is_set]
        return place


def _shards(keys: DataFrame, n_shards: int) -> DataFrame:
    dealt = keys.withColumn("shard", F.pmod("high", F.lit(n_shards)))
    return dealt.groupBy("shard").applyInArrow(_build, _SHARD)


def _route(arrays, n_shards: int, least: int):
    """Lines that the broadcast arrays do not hold, with the shard that answers them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(*arrays.value)
        for batch in batches:
            for part, lines in _parts(batch, least):
                rest = index.find(lines.high, lines.low) < 0
                owner = part.select(["doc_id", "text_key"]).take(pa.array(lines.doc[rest]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.mod(lines.high[rest], n_shards)), pa.array(lines.high[rest]), pa.array(lines.low[rest]), *owner.columns],
                    ["shard", "high", "low", "doc_id", "text_key"],
                )

    return apply


def _answer(n_shards: int):
    def apply(lines: pa.Table, arrays: pa.Table) -> pa.Table:
        held = arrays.to_pylist()
        high, low = (lines.column(c).to_numpy() for c in ("high", "low"))
        place = np.full(len(high), -1)
        if held:
            index = LineIndex(held, n_shards, held[0]["shard"])
            place = index.find(high, low)
        found = np.flatnonzero(place >= 0)
        out = lines.select(["doc_id", "text_key", "low"]).take(pa.array(found))
        keepers, counts = (getattr(index, c)[place[found]] if held else [] for c in ("keepers", "counts"))
        return out.append_column("keeper", pa.array(keepers, pa.int64())).append_column("n", pa.array(counts, pa.int64()))

    return apply


def _clean(arrays, least: int):
    """Documents without the lines that an earlier document keeps."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex(*arrays.value)
        for batch in batches:
            for part, lines in _parts(batch, least):
                ids = part.column("doc_id").to_pylist()
                place = index.find(lines.high, lines.low)
                known = np.flatnonzero(place >= 0)
                dropped = [{} for _ in ids]
                for k in known.tolist():
                    i = lines.doc[k]
                    if index.keepers[place[k]] != ids[i]:
                        dropped[i][int(lines.at[k])] = int(index.counts[place[k]])
                if "answers" in part.schema.names:
                    answers = [{a["low"]: a for a in own or ()} for own in part.column("answers").to_pylist()]
                    for k in np.flatnonzero(place < 0).tolist():
                        i = lines.doc[k]
                        a = answers[i].get(int(lines.low[k]))
                        if a and a["keeper"] != ids[i]:
                            dropped[i][int(lines.at[k])] = a["n"]
                kept = [b"\n".join(x for j, x in enumerate(own) if j not in gone) for own, gone in zip(lines.lines, dropped)]
                gone = [sorted(d) for d in dropped]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in lines.lines], pa.int64()),
                        lists(np.array([len(x) for x in gone]), pa.array([j for x in gone for j in x], pa.int64())),
                        lists(np.array([len(x) for x in gone]), pa.array([d[j] for d, x in zip(dropped, gone) for j in x], pa.int64())),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_lines", "dropped_at", "dropped_counts", "kept_text"],
                )

    return apply


def distinct_lines(docs: DataFrame, least: int = LEAST, index_keys: int = INDEX_KEYS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, dropped_at, dropped_counts, kept_text``.

    ``dropped_at`` holds the numbers (from 0) of the dropped lines and
    ``dropped_counts`` how many documents hold each of them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("body"))
    seen = Observation()
    found = (
        picked.mapInArrow(_held(least), "high long, low long, doc_id long")
        .groupBy("high", "low")
        .agg(
            F.min("doc_id").alias("keeper"),
            F.max("doc_id").alias("last"),
            F.count("doc_id").alias("n_ids"),
            F.count(F.lit(1)).alias("n"),
        )
        .observe(seen, F.sum("n").alias("lines"))
        # Two ids, or one id and rows without any.
        .filter("keeper < last OR (n_ids > 0 AND n_ids < n)")
        .select("high", "low", "keeper", "n")
    )
    repeated = land(found, "line-keys")
    size = repeated.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("lines")).first()
    near, far = repeated, None
    if size.keys > index_keys:
        # At most lines / bound = index_keys keys are held that often.
        bound = math.ceil(size.lines / index_keys)
        near, far = repeated.filter(F.col("n") >= bound), repeated.filter(F.col("n") < bound)
    n_shards = max(1, math.ceil(min(size.keys, index_keys) / SHARD_KEYS))
    arrays = spark.sparkContext.broadcast(([r.asDict() for r in _shards(near, n_shards).collect()], n_shards))
    if far is not None:
        picked = _with_answers(picked, far, arrays, math.ceil(seen.get["lines"] / ROUTED_LINES), least)
    schema = "doc_id long, n_lines long, dropped_at array<long>, dropped_counts array<long>, kept_text string"
    return picked.mapInArrow(_clean(arrays, least), schema)


def _with_answers(picked: DataFrame, far: DataFrame, arrays, n_shards: int, least: int) -> DataFrame:
    """Documents with what the shards say of the lines outside the broadcast arrays."""
    keyed = picked.withColumn("text_key", F.unhex(F.md5(F.coalesce("body", F.lit("")))))
    # Equal rows ask once.
    sent = keyed.dropDuplicates(["doc_id", "text_key"]).mapInArrow(
        _route(arrays, n_shards, least), "shard long, high long, low long, doc_id long, text_key binary"
    )
    shards = land(_shards(far, n_shards), "line-shards")
    answers = (
        sent.groupBy("shard")
        .cogroup(shards.groupBy("shard"))
        .applyInArrow(_answer(n_shards), "doc_id long, text_key binary, low long, keeper long, n long")
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
        .agg(F.collect_set(F.struct("low", "keeper", "n")).alias("answers"))
    )
    answers = land(answers, "line-answers")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    return keyed.join(answers, same, "left").select("doc_id", "body", "answers")


def op12_lines(spark, sf_dir: str) -> DataFrame:
    found = distinct_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("dropped_at").cast("bigint").alias("n_dropped"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )
