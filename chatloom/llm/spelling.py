"""Spelling variants: one-edit neighbours found by a frontier in a trie of words.

Words are the letter runs of the texts that are long and frequent enough. Two
tries, of the words and of the reversed words, are tables of edges
``(node, letter, child)``. One edit leaves the first or the second half of a
word as it is, so the walk starts without branching: the node of a prefix of
half the word or more is known from its letters. An edit in the second half is
sought in the first trie, one in the first half in the other trie.

The frontier holds states with one edit. It starts with the words' own prefixes,
where a letter is replaced by that of another edge of the node (a larger one;
the pair is found from its other word otherwise) or left out (inserted letters
are the left out ones of the other word). Level by level the frontier is joined
with the edge table on node and next letter; states without letters left that
stand at the end of a word are pairs. After ``LEVELS`` levels the few states of
very long words jump to the node that their remaining letters lead to.

A node is the exclusive-or of one 64-bit value per position and letter, so that
nodes are computed where the words are. Chance collisions can only add states;
every pair is checked by its two words in the end.

Defined results: a missing text has no words; a missing id is written as an
empty one; repeated rows count as often as they occur; ties between forms go to
the smallest word; words may have any length; an empty table gives no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.scan import as_bytes, combine
from chatloom.session import land, scratch_scope, ship_package

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS = 5
LEAST_COUNT = 3
ONE_IN = 97
LEVELS = 16
HELD_WORDS = 1 << 17


def spoken(doc_id, text: bytes) -> Counter:
    """Words of a text with their counts, some of them with a letter left out."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # Lower-casing bytes touches ASCII letters only.
    for run, n in Counter(RUN.findall(text.lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def _count(least: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("body"))):
                    for word, n in spoken(doc_id, text).items():
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    return apply


def frequent_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of all texts."""
    ship_package(docs.sparkSession)
    picked = docs.select("doc_id", F.col("text").alias("body"))
    counted = picked.mapInArrow(_count(least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class _Letters:
    """Letters of a batch of words, in one of two directions, and the nodes of their prefixes."""

    def __init__(self, words: list[str], backward: bool) -> None:
        self.words = [w[::-1] for w in words] if backward else words
        letters = np.frombuffer("".join(self.words).encode("utf-32-le"), dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.at = np.arange(len(letters)) - self.start[self.word]
        self.letter = letters.astype(np.int64)
        self.side = np.uint64(backward)

    def value(self, at: np.ndarray) -> np.ndarray:
        """Value of every letter as if it stood at position ``at``."""
        return combine(at.astype(np.uint64), self.letter.astype(np.uint64), np.full(len(at), self.side))

    def before(self, value: np.ndarray) -> np.ndarray:
        """Exclusive-or of the values of the letters before each letter of its word."""
        total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(value)]) if len(value) else np.zeros(1, np.uint64)
        return total[:-1] ^ total[self.start[self.word]]


_ROW = "kind int, node long, letter int, child long, word long, ahead string, rest long"
EDGE, OWN, LEFT_OUT, END = range(4)


def _tries(levels: int):
    """Edges, own prefixes, prefixes before a left out letter, and ends of all words."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            ids = None
            for backward in (False, True):
                x = _Letters(words, backward)
                value = x.value(x.at)
                node = x.before(value)
                whole = np.bitwise_xor.reduceat(value, x.start)
                ids = whole if ids is None else ids
                child = node ^ value
                shifted = x.value(np.maximum(x.at - 1, 0))
                pulled = np.bitwise_xor.reduceat(shifted, x.start)[x.word] ^ x.before(shifted) ^ shifted
                half = x.length // 2
                edge = np.flatnonzero(x.at >= half[x.word])
                # The two tries share the positions of a word.
                own = np.flatnonzero(x.at >= (x.length - half if backward else half)[x.word])
                ahead = [x.words[w][p + 1 : p + 1 + levels] for w, p in zip(x.word[own].tolist(), x.at[own].tolist())]
                n_own, n_words = len(own), len(words)
                none = lambda n: pa.nulls(n, pa.int64())
                long = lambda a: pa.array(a.view(np.int64))
                parts = {
                    EDGE: (long(node[edge]), pa.array(x.letter[edge], pa.int32()), long(child[edge]), none(len(edge)), pa.nulls(len(edge), pa.string()), none(len(edge))),
                    OWN: (long(node[own]), pa.array(x.letter[own], pa.int32()), none(n_own), long(ids[x.word[own]]), pa.array(ahead, pa.string()), long((whole[x.word] ^ child)[own])),
                    LEFT_OUT: (long(node[own]), pa.nulls(n_own, pa.int32()), none(n_own), long(ids[x.word[own]]), pa.array(ahead, pa.string()), long(pulled[own])),
                    END: (long(whole), pa.nulls(n_words, pa.int32()), none(n_words), long(ids), pa.nulls(n_words, pa.string()), none(n_words)),
                }
                for kind, columns in parts.items():
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *columns], [f.split()[0] for f in _ROW.split(", ")])

    return apply


def neighbours(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Landed pairs ``word, other`` of the words that differ by one edit, in both directions."""
    spark = words.sparkSession
    ship_package(spark)
    with scratch_scope(spark):
        rows = land(words.select("word").mapInArrow(_tries(levels), _ROW), "trie-rows")
        edges = land(
            rows.filter(F.col("kind") == EDGE).select("node", "letter", "child").distinct(),
            "trie-edges",
        )
        state = ["node", "word", "ahead", "rest"]
        from_edge = edges.select("node", F.col("letter").alias("met"), "child")
        replaced = (
            rows.filter(F.col("kind") == OWN)
            .select(*state, "letter")
            .join(from_edge, "node")
            .filter("met > letter")
            .select(F.col("child").alias("node"), "word", "ahead", "rest")
        )
        left_out = rows.filter(F.col("kind") == LEFT_OUT).select(*state)
        frontier = land(replaced.union(left_out), "trie-frontier")
        arrived = []
        for level in range(levels + 1):
            arrived.append(frontier.filter("ahead = ''").select(F.col("node").bitwiseXOR(F.col("rest")).alias("goal"), "word"))
            moving = frontier.filter("ahead <> ''").withColumn("met", F.ascii(F.substring("ahead", 1, 1)))
            if level == levels or moving.isEmpty():
                break
            # What stays of the rest is what lies beyond the letters ahead.
            step = moving.join(edges.select("node", F.col("letter").alias("met"), "child"), ["node", "met"])
            passed = F.col("rest").bitwiseXOR(F.col("node")).bitwiseXOR(F.col("child"))
            frontier = land(
                step.select(F.col("child").alias("node"), "word", F.expr("substring(ahead, 2)").alias("ahead"), passed.alias("rest")),
                "trie-frontier",
            )
        goals = arrived[0]
        for more in arrived[1:]:
            goals = goals.union(more)
        ends = rows.filter(F.col("kind") == END).select(F.col("node").alias("goal"), F.col("word").alias("other"))
        pairs = land(goals.join(ends, "goal").select("word", "other").distinct(), "trie-pairs")
        ids = rows.filter(F.col("kind") == END)
        named = land(words.select("word").mapInArrow(_identified, "id long, text string"), "trie-words")
        checked = (
            pairs.join(named.select(F.col("id").alias("word"), F.col("text").alias("a")), "word")
            .join(named.select(F.col("id").alias("other"), F.col("text").alias("b")), "other")
            .filter(F.levenshtein("a", "b", 1) == 1)
            .select("a", "b")
        )
        both = checked.union(checked.select("b", "a")).distinct().toDF("word", "other")
        return land(both, "near-words", outer=True)


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        if words:
            x = _Letters(words, False)
            ids = np.bitwise_xor.reduceat(x.value(x.at), x.start)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), batch.column("word")], ["id", "text"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word of ``forms`` (``word, form``): the last form of its chain.

    Counts at least double along a chain, so it has no circle; each round
    doubles the part of the chains that is followed.
    """
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        found = land(found, "spelling-roots")
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("last"))
        if found.join(onward, "root", "left_semi").isEmpty():
            return found
        found = found.join(onward, "root", "left").select("word", F.coalesce("last", "root").alias("root"))


def spelling_groups(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, levels: int = LEVELS
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word."""
    words = land(frequent_words(docs, least_letters, least_count), "spelling-words")
    near = neighbours(words, levels)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # The largest count first, then the smallest word.
    best = (
        near.join(other, "other")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    )
    best = land(best, "spelling-best")
    ruled = land(
        words.join(best, "word", "left").select(
            "word",
            F.expr("CASE WHEN -best.rank >= 2 * n THEN best.other END").alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.expr("CASE WHEN -best.rank >= 2 * n THEN -best.rank END").alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(ruled.filter("form IS NOT NULL"))
    return ruled.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
