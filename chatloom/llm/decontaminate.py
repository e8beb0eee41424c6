"""Benchmark decontamination with a BM25 index and block-max pruning.

The test items form an inverted index whose postings are grouped in blocks of
items, each with the largest impact of its term. Every passage of every
document (``PASSAGE`` words, half overlapping, to the end of the text) is a
query. A passage-item score is the BM25 sum over their common words, divided by
the item's own threshold (``RETRIEVE`` times the score of the item itself, less for
items longer than a passage), so that one bound, 1, holds for all.

Pruning is exact: a passage whose sum of largest impacts is below 1 meets
nothing; of the others, a block is a candidate when the passage holds a word
without which one of its items cannot reach 1, and only blocks whose summed
block maxima reach 1 are scored. All items at or above 1 are retrieved, and each is verified: enough of
the item's question and of its answer must stand in the words around the
passage.

The index is sent to the tasks in parts of at most ``INDEX_ITEMS`` items and
``INDEX_WORDS`` words, so that what is broadcast has a fixed bound; a larger
benchmark takes several scans.

Defined results: items without words and texts without words match nothing;
repeated items and repeated documents give their rows each; missing ids stay
missing; an empty benchmark gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.scan import Rolling, Slice, combine, runs, slices
from chatloom.session import ship_package

PASSAGE = 64
RETRIEVE = 0.4
K1, B = 1.2, 0.75
BLOCK = 16
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.6
GRAM = 3
TABLE_CELLS = 1 << 22
INDEX_ITEMS, INDEX_WORDS = 20_000, 2_000_000

# Words are runs of letters and digits in lower case (ASCII); bytes of other
# characters count as letters.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item.

    The answer is what follows the last question mark, else the last sentence
    or line, else the last quarter of the words.
    """
    at = text.rfind("?")
    if at >= 0 and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    parts = [p for p in _SENTENCE_END.split(text) if p.strip()]
    if len(parts) > 1:
        return "\n".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 4))
    return " ".join(words[:cut]), " ".join(words[cut:])


def folded_words(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every folded word."""
    data = _FOLD[piece.data]
    starts, ends = runs(data != 0x20)
    return piece.owner(starts), Rolling(data).spans(starts, ends)


def _hashes(text: str) -> np.ndarray:
    return folded_words(Slice(0, [text.encode()]))[1]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    n = max(1, min(n, len(ids)))
    if not len(ids):
        return ids
    return combine(*[ids[k : len(ids) - n + 1 + k] for k in range(n)])


@dataclass
class Index:
    """Inverted index of some items; postings by term, then item."""

    items: list
    words: list  # word count of each item
    questions: list  # (gram size, set of gram hashes)
    answers: list
    terms: np.ndarray  # sorted word hashes
    term_max: np.ndarray  # largest impact of each term
    item: np.ndarray  # postings
    impact: np.ndarray
    strong_first: np.ndarray  # of term i: strong_block[strong_first[i] : strong_first[i + 1]]
    strong_block: np.ndarray  # blocks with an item for which the term is a strong one
    block_key: np.ndarray  # term * width + block of each entry, ascending
    block_max: np.ndarray
    block_posting: np.ndarray  # first posting of each entry, plus the end
    width: int
    table: np.ndarray | None = None  # entry of every key, where that table is small

    def find_entries(self, key: np.ndarray) -> np.ndarray:
        """Block entry of each (term, block) key, -1 where there is none."""
        if self.table is not None:
            return self.table[key]
        entry = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        return np.where(self.block_key[entry] == key, entry, -1)


def build_index(items: list[tuple[object, str | None]], retrieve: float = RETRIEVE) -> Index | None:
    kept, hashes = [], []
    for key, text in items:
        ids = _hashes(text or "")
        if len(ids):
            kept.append((key, text))
            hashes.append(ids)
    if not kept:
        return None
    lengths = np.array([len(h) for h in hashes], dtype=np.float64)
    item = np.repeat(np.arange(len(kept)), lengths.astype(np.int64))
    pairs, count = np.unique(
        np.stack([np.concatenate(hashes), item.astype(np.uint64)], axis=1), axis=0, return_counts=True
    )
    terms, first = np.unique(pairs[:, 0], return_index=True)
    first = np.append(first, len(pairs))
    frequency = np.diff(first)
    owner = pairs[:, 1].astype(np.int64)
    idf = np.log(1 + (len(kept) - frequency + 0.5) / (frequency + 0.5))
    norm = K1 * (1 - B + B * lengths / lengths.mean())
    impact = np.repeat(idf, frequency) * count * (K1 + 1) / (count + norm[owner])
    itself = np.bincount(owner, weights=impact, minlength=len(kept))
    reachable = np.minimum(1.0, PASSAGE / lengths)
    impact = impact / (retrieve * itself * reachable)[owner]
    term_max = np.maximum.reduceat(impact, first[:-1])
    term_of = np.repeat(np.arange(len(terms)), frequency)
    width = len(kept) // BLOCK + 1
    entry = term_of * width + owner // BLOCK
    starts = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
    # The weakest words of an item that cannot reach 1 together name no
    # candidates: a match holds at least one of the item's other words.
    order = np.lexsort((impact, owner))
    sums = np.cumsum(impact[order])
    before = np.append(0.0, sums)[np.searchsorted(owner[order], owner[order])]
    strong = order[sums - before >= 1 - 1e-9]
    strong_key = np.unique(entry[strong])
    split = [split_item(t) for _, t in kept]

    def part(text: str):
        ids = _hashes(text)
        return min(GRAM, max(1, len(ids))), frozenset(grams(ids, GRAM).tolist())

    table = None
    if len(terms) * width <= TABLE_CELLS:
        table = np.full(len(terms) * width, -1, dtype=np.int32)
        table[entry[starts]] = np.arange(len(starts))
    return Index(
        [k for k, _ in kept],
        [len(h) for h in hashes],
        [part(q) for q, _ in split],
        [part(a) for _, a in split],
        terms,
        term_max,
        owner,
        impact,
        np.searchsorted(strong_key, np.arange(len(terms) + 1) * width),
        strong_key % width,
        entry[starts],
        np.maximum.reduceat(impact, starts),
        np.append(starts, len(owner)),
        width,
        table,
    )


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of ``first[i], first[i] + 1, ...`` (``count[i]`` values each)."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def retrieve_items(index: Index, term: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(passage, item, score) of all pairs that score at least 1.

    ``term`` has the term of every word, -1 for words outside the index.
    """
    bound = np.append(0.0, np.cumsum(np.where(term >= 0, index.term_max[term], 0.0)))
    able = np.flatnonzero(bound[ends] - bound[starts] >= 1 - 1e-9)
    row, at = _spread(starts[able], (ends - starts)[able])
    known = term[at] >= 0
    n_terms = len(index.terms)
    query = distinct(row[known] * n_terms + term[at[known]])
    passage, word = query // n_terms, query % n_terms
    tighter = np.bincount(passage, weights=index.term_max[word], minlength=len(able)) >= 1 - 1e-9
    passage, word = passage[tighter[passage]], word[tighter[passage]]

    if not len(passage):
        return able[:0], able[:0], np.zeros(0)
    n_strong = np.diff(index.strong_first)[word]
    q, at = _spread(index.strong_first[word], n_strong)
    cell = distinct(passage[q] * index.width + index.strong_block[at])
    # Block bounds and scores take all terms of the passage.
    begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    first_query = np.zeros(len(able), dtype=np.int64)
    n_query = np.zeros(len(able), dtype=np.int64)
    first_query[passage[begin]] = begin
    n_query[passage[begin]] = np.diff(np.append(begin, len(passage)))
    c, q = _spread(first_query[cell // index.width], n_query[cell // index.width])
    key = word[q] * index.width + cell[c] % index.width
    entry = index.find_entries(key)
    there = entry >= 0
    c, q, entry = c[there], q[there], entry[there]
    bounds = np.bincount(c, weights=index.block_max[entry], minlength=len(cell))
    live = bounds[c] >= 1 - 1e-9
    q, entry = q[live], entry[live]

    sizes = np.diff(index.block_posting)
    p, posting = _spread(index.block_posting[entry], sizes[entry])
    pair = passage[q[p]] * len(index.items) + index.item[posting]
    found, inverse = np.unique(pair, return_inverse=True)
    score = np.bincount(inverse, weights=index.impact[posting], minlength=len(found))
    good = score >= 1 - 1e-9
    return able[found[good] // len(index.items)], found[good] % len(index.items), score[good]


def overlap(gram: tuple[int, frozenset], ids: np.ndarray) -> float:
    """Share of the wanted grams that occur among ``ids``."""
    n, wanted = gram
    if not wanted:
        return 1.0  # an item without an answer is judged by its question
    return len(wanted.intersection(grams(ids, n).tolist())) / len(wanted) if len(ids) >= n else 0.0


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def passages(doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of half overlapping passages that cover every text."""
    step = size // 2
    n = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
    owner, start = _spread(np.zeros(n_docs, dtype=np.int64), count)
    start = begin[owner] + start * step
    return owner, start, np.minimum(start + size, (begin + n)[owner])


def matches(index: Index, piece: Slice, size: int) -> list[tuple]:
    """(document, item, score, question overlap, answer overlap, first word) of verified pairs."""
    doc, ids = folded_words(piece)
    slot = np.minimum(np.searchsorted(index.terms, ids), len(index.terms) - 1)
    term = np.where(index.terms[slot] == ids, slot, -1)
    owner, starts, ends = passages(doc, len(piece), size)
    n = np.bincount(doc, minlength=len(piece))
    begin = np.cumsum(n) - n
    best: dict[tuple[int, int], tuple] = {}
    for p, i, score in zip(*retrieve_items(index, term, starts, ends)):
        d = int(owner[p])
        around = ids[
            max(begin[d], starts[p] - index.words[i]) : min(begin[d] + n[d], ends[p] + index.words[i])
        ]
        q, a = overlap(index.questions[i], around), overlap(index.answers[i], around)
        if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
            row = (d, int(i), float(score), q, a, int(starts[p] - begin[d]))
            old = best.get((d, int(i)))
            if old is None or (q + a, score) > (old[3] + old[4], old[2]):
                best[d, int(i)] = row
    return list(best.values())


_FOUND = (
    T.StructType()
    .add("score", T.DoubleType())
    .add("question_overlap", T.DoubleType())
    .add("answer_overlap", T.DoubleType())
    .add("first_word", T.LongType())
)


def index_parts(benchmark: DataFrame) -> list[list[tuple[object, str | None]]]:
    """Items in lists of bounded size; the number of lists follows the benchmark."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint")
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(words).alias("w")).first()
    n_parts = max(1, math.ceil(2 * size.n / INDEX_ITEMS), math.ceil(2 * (size.w or 0) / INDEX_WORDS))
    if n_parts == 1:
        return [sorted(map(tuple, benchmark.collect()), key=repr)]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    return [sorted(map(tuple, benchmark.filter(part == i).collect()), key=repr) for i in range(n_parts)]


def contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Verified pairs: ``doc_id, item_id`` and the evidence."""
    ship_package(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    picked = docs.select("doc_id", F.col("text").alias("body"))
    schema = T.StructType(
        [picked.schema["doc_id"], items.schema["item_id"], *_FOUND.fields]
    )
    out = None
    for part in index_parts(items):
        index = docs.sparkSession.sparkContext.broadcast(build_index(part))
        found = picked.mapInArrow(_matcher(index, passage), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _matcher(shared, passage: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if index is None:
                continue
            for piece in slices(batch.column("body")):
                rows = matches(index, piece, passage)
                if not rows:
                    continue
                doc, item, *rest = zip(*rows)
                ids = batch.column("doc_id").slice(piece.first, len(piece)).take(pa.array(doc))
                kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([index.items[i] for i in item])]
                    + [pa.array(c, k) for c, k in zip(rest, kinds)],
                    ["doc_id", "item_id", *_FOUND.fieldNames()],
                )

    return apply


def clean_documents(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Documents without a verified item, in their own columns.

    The verdict is passed through the scan as an empty or kept row, so that no
    join is needed and documents without an id are judged each for itself.
    """
    ship_package(docs.sparkSession)
    names = [f"column_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    kept = docs.toDF(*names)
    schema = kept.schema
    for part in index_parts(benchmark.select("item_id", "text")):
        index = docs.sparkSession.sparkContext.broadcast(build_index(part))
        kept = kept.mapInArrow(_cleaner(index, passage, text), schema)
    return kept.toDF(*docs.columns)


def _cleaner(shared, passage: int, text: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            if index is not None:
                for piece in slices(batch.column(text)):
                    for row in matches(index, piece, passage):
                        keep[piece.first + row[0]] = False
            yield batch.filter(pa.array(keep))

    return apply


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contaminated(read("documents"), read("benchmark"))
