"""Toxicity by a support vector machine with a subsequence string kernel.

Strings are windows of ``WINDOW`` symbols (letters, and one boundary symbol for
any run of other characters). The kernel of two windows is the inner product of
their gapped subsequences: every choice of ``LENGTH`` symbols that spans at most
``SPAN`` symbols counts ``DECAY ** span``, so that insults with dropped,
inserted or spaced characters stay close to the plain ones.

Training (bounded, on the driver): at most ``PER_LABEL`` labelled texts of each
label with at most ``TRAIN_CHARS`` characters, those with the smallest hashes.
Labels hold for texts, so the window that speaks most for a toxic text is found
in rounds: first by the log-odds of its subsequences, then by the machine
itself; the strongest windows of clean texts are the hard negatives. Landmark
windows give the Nyström map K(x, L) K(L, L)^(-1/2), in which a linear machine
with squared hinge loss is fitted.

The kernel expansion over the landmarks is a weighted sum of subsequences, so
it is folded into one weight per subsequence before scoring. All windows of the
whole text are scored and the largest value, put through a logistic curve, is
the score of the text.

Defined results: a missing or empty text scores as a window of value 0;
repeated rows get equal scores; labels of one id are combined by their maximum,
labels without an id or value are ignored; without both labels every score is
the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.scan import Slice, slices
from chatloom.session import ship_package

LENGTH, SPAN, DECAY = 3, 5, 0.7
WINDOW = 10
STARTS = WINDOW - SPAN + 1  # subsequence starts summed for a window
BUCKETS = 1 << 20
PER_LABEL, TRAIN_CHARS = 1000, 6_000
LANDMARKS = 512
ROUNDS = 4
NEGATIVES_PER_TEXT = 4
REGULARISATION = 1e-4

# Symbol choices relative to the first, with their weight.
GAPS = tuple(
    (c, DECAY ** (c[-1] + 1)) for c in combinations(range(1, SPAN), LENGTH - 1)
)

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[0x80:0xC0] = 27 + np.arange(64)
N_SYMBOLS = 91


@dataclass
class Symbols:
    code: np.ndarray
    first: np.ndarray  # first symbol of each document
    end: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.end - self.first)


def symbols(texts: list[bytes]) -> Symbols:
    """Letters and boundaries of every text, which starts and ends with a boundary."""
    piece = Slice(0, [b"\n" + t for t in texts])
    data = piece.data
    code = _CLASS[data]
    # Capitals of the Latin-1 letters differ from small ones by one bit.
    after = np.append(False, data[:-1] == 0xC3)
    code = np.where(after & (data >= 0x80) & (data < 0x9F) & (data != 0x97), code + 32, code)
    keep = data < 0xC0  # lead bytes carry no letter of their own
    keep[1:] &= ~((code[1:] == 0) & (code[:-1] == 0) & (data[:-1] < 0xC0))
    keep[piece.starts] = True
    count = np.append(0, np.cumsum(keep))
    return Symbols(code[keep], count[piece.starts], count[piece.ends + 1])


def subsequences(s: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Bucket and validity of the subsequence at every symbol, per choice of gaps."""
    code = s.code
    n = len(code)
    left = np.repeat(s.end, s.end - s.first) - np.arange(n)  # symbols left in the text
    padded = np.append(code, np.zeros(SPAN, dtype=code.dtype))
    for gaps, weight in GAPS:
        key = code
        for g in gaps:
            key = key * N_SYMBOLS + padded[g : g + n]
        key = (key * 0x9E3779B1 ^ (key >> 15)) % BUCKETS
        yield key, left > gaps[-1], weight


def window_values(s: Symbols, weights: np.ndarray) -> np.ndarray:
    """Value of the window at every symbol; windows end with their text."""
    at = np.zeros(len(s.code))
    for key, valid, weight in subsequences(s):
        at += np.where(valid, weights[key], 0.0) * weight
    sums = np.append(0.0, np.cumsum(at))
    index = np.arange(len(at))
    end = np.minimum(index + STARTS, np.repeat(s.end, s.end - s.first))
    return sums[end] - sums[index]


def features(s: Symbols, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the subsequences of the windows ``at``."""
    end = s.end[s.owner()[at]]
    rows, keys, values = [], [], []
    for key, valid, weight in subsequences(s):
        for k in range(STARTS):
            place = at + k
            inside = np.flatnonzero(place < end)
            good = inside[valid[place[inside]]]
            rows.append(good)
            keys.append(key[place[good]])
            values.append(np.full(len(good), weight))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(values)


@dataclass
class Model:
    weights: np.ndarray  # per bucket
    slope: float
    offset: float
    constant: float | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        s = symbols(texts)
        best = np.maximum.reduceat(window_values(s, self.weights), s.first)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * best + self.offset, -60, 60)))


def first_weights(s: Symbols, toxic: np.ndarray) -> np.ndarray:
    """Log-odds of each subsequence to occur in toxic texts, where that is well supported."""
    owner = s.owner()
    n = (toxic == 1).sum(), (toxic == 0).sum()
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for gaps, (key, valid, _) in zip(GAPS, subsequences(s)):
        pairs = np.unique(owner[valid] * BUCKETS + key[valid])
        label = toxic[pairs // BUCKETS]
        for side in (0, 1):
            counts[side] += np.bincount(pairs[label == side] % BUCKETS, minlength=BUCKETS)
    odds = np.log((counts[1] + 0.5) / (n[0] + 1)) - np.log((counts[0] + 0.5) / (n[1] + 1))
    # Shrink by the support, so that rare subsequences do not lead.
    return (odds * np.sqrt(counts[1] / (counts[1] + 10.0))).astype(np.float32)


def strongest(values: np.ndarray, s: Symbols, doc: int, n: int) -> list[int]:
    """The ``n`` best windows of a text that do not overlap."""
    own = values[s.first[doc] : s.end[doc]].copy()
    out = []
    for _ in range(n):
        i = int(own.argmax())
        if not np.isfinite(own[i]):
            break
        out.append(i + int(s.first[doc]))
        own[max(0, i - WINDOW) : i + WINDOW] = -np.inf
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear machine by Newton steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], REGULARISATION * weight.sum())
    ridge[-1] = 1e-9
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ya, wa = x[active], y[active], weight[active]
        hessian = (xa * wa[:, None]).T @ xa + np.diag(ridge)
        fresh = np.linalg.solve(hessian, (xa * (wa * ya)[:, None]).sum(axis=0))
        if np.abs(fresh - w).max() < 1e-9:
            break
        w = fresh
    return w


def train(texts: list[bytes], labels: list[int]) -> Model:
    toxic = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(1), 0.0, 0.0, float(labels[0]) if labels else 0.0)
    s = symbols(texts)
    weights = first_weights(s, toxic)
    negatives: set[int] = set()  # hard windows of clean texts, of all rounds
    for _ in range(ROUNDS):
        values = window_values(s, weights)
        positives = [strongest(values, s, d, 1)[0] for d in np.flatnonzero(toxic == 1)]
        for d in np.flatnonzero(toxic == 0):
            negatives.update(strongest(values, s, d, NEGATIVES_PER_TEXT))
        chosen = np.array(positives + sorted(negatives))
        y = np.where(np.arange(len(chosen)) < len(positives), 1.0, -1.0)
        # Landmarks: the strongest distinct windows, half of them from toxic texts.
        landmarks = []
        for side in (1.0, -1.0):
            seen: dict[bytes, int] = {}
            for i in sorted(np.flatnonzero(y == side), key=lambda i: (-values[chosen[i]], i)):
                seen.setdefault(s.code[chosen[i] : chosen[i] + WINDOW].tobytes(), int(i))
            ranked = list(seen.values())
            landmarks += ranked[:: max(1, len(ranked) // (LANDMARKS // 2))][: LANDMARKS // 2]
        weights = _machine(s, chosen, y, np.array(landmarks))
    best = np.maximum.reduceat(window_values(s, weights), s.first)
    return Model(weights, *_logistic(best, toxic))


def _machine(s: Symbols, at: np.ndarray, y: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Weights per bucket of the machine in the Nyström space of the landmarks."""
    row, key, value = features(s, at)
    of_landmark = np.full(len(at), -1)
    of_landmark[landmarks] = np.arange(len(landmarks))
    mine = of_landmark[row] >= 0
    names = np.unique(key[mine])
    basis = np.zeros((len(names), len(landmarks)))
    np.add.at(basis, (np.searchsorted(names, key[mine]), of_landmark[row[mine]]), value[mine])
    slot = np.minimum(np.searchsorted(names, key), len(names) - 1)
    known = names[slot] == key
    kernel = np.zeros((len(at), len(landmarks)))
    order = np.argsort(row[known], kind="stable")
    r, k, v = row[known][order], slot[known][order], value[known][order]
    for low in range(0, len(at), 64):  # few windows at a time bound the memory
        part = slice(*np.searchsorted(r, (low, low + 64)))
        if part.start < part.stop:
            rows = r[part]
            head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            kernel[rows[head]] = np.add.reduceat(basis[k[part]] * v[part][:, None], head, axis=0)
    scale = np.sqrt((basis * basis).sum(axis=0)).mean()
    kernel, basis = kernel / scale**2, basis / scale
    values, vectors = np.linalg.eigh(basis.T @ basis)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.column_stack([kernel @ root, np.ones(len(at))])
    balance = np.where(y > 0, 1.0 / (y > 0).sum(), 1.0 / (y < 0).sum()) * len(y)
    w = squared_hinge(x, y, balance)
    out = np.zeros(BUCKETS, dtype=np.float32)
    out[names] = basis @ (root @ w[:-1]) / scale
    return out


def _logistic(best: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of a toxic label, from the largest value."""
    centre, spread = best.mean(), best.std() + 1e-9
    x = np.column_stack([(best - centre) / spread, np.ones(len(best))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-3])
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - np.array([0.05, 1e-3]) * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[list[bytes], list[int]]:
    """Labelled texts, at most ``per_label`` ids of each label, by the hash of the id."""
    found = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    pick = lambda x: found.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    ids = F.broadcast(pick(0).union(pick(1)))  # at most 2 * per_label rows
    rows = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= TRAIN_CHARS)
        .join(ids, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(2 * per_label)  # repeated rows must not widen the sample
        .select("text", "toxic")
        .collect()
    )
    return [r["text"].encode() for r in rows], [int(r["toxic"] > 0) for r in rows]


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document with ``score``, from its whole text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = [f.name for f in batch.schema if f.name != "body"]
            for piece in slices(batch.column("body")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(piece.first, len(piece)) for n in names]
                    + [pa.array(model.scores(piece.texts))],
                    [*names, "score"],
                )

    picked = docs.select(
        *[F.col(c).alias(f"key_{i}") for i, c in enumerate(keep)], F.col("text").alias("body")
    )
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    scored = picked.mapInArrow(apply, schema)
    return scored.select(*[F.col(f"key_{i}").alias(c) for i, c in enumerate(keep)], "score")


def held_out():
    token = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(token) % 5 == 0


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    texts, marks = training_sample(docs, labels.filter(~held_out()))
    scored = score_documents(docs, train(texts, marks), ["doc_id"])
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return toxicity_report(read("documents"), read("labels"))
