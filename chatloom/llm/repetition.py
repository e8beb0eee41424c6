"""Quality rules on repetition inside a text.

Base rules count words, symbols, repeated lines and words of repeated 3-word
windows. The method looks at longer structure: the suffix array of the text's
words with its longest-common-prefix (LCP) array gives the LCP intervals, whose
left-maximal members are the maximal repeated substrings. The union of their
spans must not cover too much of the text, and the longest of them must not be
too long.

Only suffixes whose first three words repeat inside their text take part in the
sort: any repeat of at least ``MIN_REPEAT`` words starts at such a suffix. A
slice of many documents is sorted at once; a document separator ends a suffix.

Defined results: a missing or empty text has no words and fails the base rule;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.scan import Rolling, Slice, combine, mix, slices
from chatloom.session import ship_package

MIN_WORDS = 50
MAX_REPEAT_WORD_PERCENT = 50
WINDOW = 3
MIN_REPEAT = 8
MAX_COVERED = 0.4
MAX_LONGEST_SHARE = 0.25

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def window_ranks(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the 3-word window at every word, and whether it occurs again in its text.

    Equal windows of one text share the rank, which is the first place of their
    group in the order of all windows. The last two words of a text start no
    window; they get ranks of their own.
    """
    n = len(ids)
    at = np.flatnonzero(doc[: max(n - WINDOW + 1, 0)] == doc[WINDOW - 1 :][: max(n - WINDOW + 1, 0)])
    key = mix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 50))
    key[at] = combine(doc[at].astype(np.uint64), *[ids[at + k] for k in range(WINDOW)])
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    single = new & np.append(new[1:], True) if n else new
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    repeated = np.zeros(n, dtype=bool)
    repeated[order] = ~single
    return rank, repeated


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Positions below ``n`` inside any of the spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def suffix_order(rank: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``tied`` in order, with the LCP in words to the one before.

    Windows are the letters. Prefix doubling sorts by 1, 2, 4, ... letters and
    only goes on with suffixes that are still tied; a text ends with letters of
    its own, so that no comparison leaves it. ``rank`` of level k is equal
    exactly where 2^k letters are, which then gives the LCP from the levels.
    """
    first, levels, span = tied, [rank], 1
    while len(tied):
        a, b = rank[tied], rank[tied + span]
        order = np.lexsort((b, a))
        tied, a, b = tied[order], a[order], b[order]
        index = np.arange(len(tied))
        group = np.append(True, a[1:] != a[:-1])
        part = group | np.append(True, b[1:] != b[:-1])
        start = np.maximum.accumulate(np.where(group, index, 0))
        rank = rank.copy()
        rank[tied] = a + np.maximum.accumulate(np.where(part, index, 0)) - start
        levels.append(rank)
        tied = tied[~(part & np.append(part[1:], True))]
        span *= 2
    suffix = first[np.argsort(rank[first])]
    lcp = np.zeros(len(suffix), dtype=np.int64)
    if len(suffix) > 1:
        a, b = suffix[:-1].copy(), suffix[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(levels))):
            equal = (levels[k][a] == levels[k][b]) << k
            a, b, common = a + equal, b + equal, common + equal
        lcp[1:] = np.where(common > 0, common + WINDOW - 1, 0)
    return suffix, lcp


def maximal_repeats(rank: np.ndarray, tied: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and words of repeats of at least ``least`` words.

    A suffix repeats for the larger of the LCPs to its neighbours. The longest
    repeat at each suffix covers all LCP intervals that it belongs to, and the
    longest of all is maximal.
    """
    suffix, lcp = suffix_order(rank, tied)
    longest = lcp.copy()
    longest[:-1] = np.maximum(longest[:-1], lcp[1:])
    keep = longest >= least
    return suffix[keep], longest[keep]


def measure(piece: Slice) -> dict[str, np.ndarray]:
    """Counts of every document of a slice."""
    n_docs, data = len(piece), piece.data
    starts, ends, doc = piece.words()
    ids = Rolling(data).spans(starts, ends)
    n_words = np.bincount(doc, minlength=n_docs)

    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(doc, weights=lead[ends] - lead[starts], minlength=n_docs)
    symbols = np.bincount(piece.owner(np.flatnonzero(_SYMBOL[data])), minlength=n_docs)

    rank, repeated = window_ranks(ids, doc)
    at = np.flatnonzero(repeated)
    in_windows = covered(at, np.full(len(at), WINDOW), len(ids))
    repeat_words = np.bincount(doc[in_windows], minlength=n_docs)

    spans, lengths = maximal_repeats(rank, at, MIN_REPEAT)
    in_repeats = covered(spans, lengths, len(ids))
    covered_words = np.bincount(doc[in_repeats], minlength=n_docs)
    longest = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(longest, doc[spans], lengths)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": duplicate_lines(piece, starts),
        "n_repeat_words": repeat_words,
        "n_covered_words": covered_words,
        "longest_repeat": longest,
    }


def duplicate_lines(piece: Slice, word_starts: np.ndarray) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(piece.data == 0x0A)  # the separators are among them
    starts = np.concatenate([[0], breaks[:-1] + 1])
    first = np.searchsorted(word_starts, starts)
    has_word = (first < len(word_starts)) & (
        word_starts[np.minimum(first, len(word_starts) - 1)] < breaks if len(word_starts) else False
    )
    starts, ends = starts[has_word], breaks[has_word]
    doc = piece.owner(starts)
    key = combine(doc.astype(np.uint64), Rolling(piece.data).spans(starts, ends))
    _, first_of = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[first_of] = False
    return np.bincount(doc[again], minlength=len(piece))


COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_covered_words",
    "longest_repeat",
)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [f.name for f in batch.schema if f.name != "body"]
        for piece in slices(batch.column("body")):
            counts = measure(piece)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).slice(piece.first, len(piece)) for n in names]
                + [pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                [*names, *COUNTS],
            )


def repetition_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every document with the counts of both rules."""
    ship_package(docs.sparkSession)
    picked = docs.select(
        *[F.col(c).alias(f"key_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("body")
    )
    schema = T.StructType(
        [*picked.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in COUNTS]]
    )
    counted = picked.mapInArrow(_apply, schema)
    return counted.select(*[F.col(f"key_{i}").alias(c) for i, c in enumerate(keep)], *COUNTS)


def quality_report(
    docs: DataFrame,
    max_covered: float = MAX_COVERED,
    max_longest_share: float = MAX_LONGEST_SHARE,
) -> DataFrame:
    """Counts and verdict of every document.

    A text that passes the base rule is dropped when maximal repeats cover more
    than ``max_covered`` of its words, or when the longest has more than
    ``max_longest_share`` of them.
    """
    counts = repetition_counts(docs, ["doc_id"])
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_WORD_PERCENT * F.col("n_words")
    )
    repetitive = (F.col("n_covered_words") > max_covered * F.col("n_words")) | (
        F.col("longest_repeat") > max_longest_share * F.col("n_words")
    )
    return counts.withColumn("base_failed", failed).select(
        "doc_id",
        *COUNTS[:5],
        "base_failed",
        (~F.col("base_failed") & ~repetitive).alias("kept"),
        *COUNTS[5:],
    )


def op7_repetition(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
