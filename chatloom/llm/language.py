"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed letter trigrams, of length one. Every
language has several centroids (spherical k-means over its training texts); the
nearest one by cosine names the language. A text farther from it than training
texts of its length are is rejected. Lengths with few training texts are judged
by parts of that length cut from longer ones, or else as the nearest length.

Training uses a bounded sample: at most ``PER_LANGUAGE`` texts of a language,
those with the smallest hashes of their ids, ties by hash of the text, repeated
rows once; and at most ``MAX_LANGUAGES`` languages, those with most sampled texts,
ties by name. Every text is predicted from all of its bytes.

Defined results: a missing text, or one without any letter, is ``und`` with
score 0 and rejected; without any training text every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.scan import Slice, lists, slices
from chatloom.session import ship_package

UNKNOWN = "und"
PER_LANGUAGE = 400
MAX_LANGUAGES = 400
CENTROIDS = 4
ROUNDS = 12
DIMENSIONS = 4096
# A text is rejected below this share of the cosine that nearly all training
# texts of its length reach.
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.5
# A length class has a bound of its own from so many texts on.
LEAST_TEXTS = 20
# Lengths in bytes of the parts that stand for short texts.
PARTS = tuple(3 << k for k in range(12))
SHARPNESS = 20.0
SLICE_BYTES = 1 << 20

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
# Letters as small classes: 0 is anything else, bytes of longer characters keep
# their low bits.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128) & 63)


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def trigram_counts(piece: Slice) -> np.ndarray:
    """Documents times dimensions: counts of letter trigrams."""
    c = _CLASS[piece.data]
    c = np.concatenate([[0], c, [0]])
    code = (c[:-2] * 91 + c[1:-1]) * 91 + c[2:]
    at = np.flatnonzero((c[1:-1] > 0) & ((c[:-2] > 0) | (c[2:] > 0)))
    slot = (code[at] * 2654435761 >> 7) % DIMENSIONS
    doc = piece.owner(at)
    counts = np.bincount(doc * DIMENSIONS + slot, minlength=len(piece) * DIMENSIONS)
    return counts.reshape(len(piece), DIMENSIONS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(12, np.log2(counts.sum(axis=1) + 1).astype(np.int64))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # lowest accepted cosine per length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and rejection of each row."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.full((len(counts), len(self.languages)), -1.0, dtype=np.float32)
        for i in range(len(self.languages)):
            best[:, i] = cosine[:, self.owner == i].max(axis=1)
        winner = best.argmax(axis=1)
        top = best[np.arange(len(best)), winner]
        weight = np.exp(SHARPNESS * (best - top[:, None]).astype(np.float64)).sum(axis=1)
        return winner, 1.0 / weight, top < self.least[length_class(counts)]


def text_parts(text: bytes) -> list[bytes]:
    """A part of each length in ``PARTS`` below that of the text, from a word start."""
    start = text.find(b" ", len(text) // 3) + 1
    return [text[start : start + n] for n in PARTS if start + n < len(text)]


def least_cosines(reached: np.ndarray, classes: np.ndarray, part_reached: np.ndarray, part_classes: np.ndarray) -> np.ndarray:
    """Lowest accepted cosine of each length class, from texts or from parts of texts."""
    least = np.full(13, np.nan)
    for c in range(1, 13):
        own = reached[classes == c]
        if len(own) < LEAST_TEXTS:
            own = np.concatenate([own, part_reached[part_classes == c]])
        if len(own) >= LEAST_TEXTS:
            least[c] = REJECT_SHARE * np.quantile(own, REJECT_QUANTILE)
    filled = np.flatnonzero(~np.isnan(least))
    if not len(filled):  # a handful of training texts: the lowest of all
        everything = np.concatenate([reached, part_reached])
        return np.full(13, REJECT_SHARE * everything.min(), dtype=np.float32)
    # The nearest filled class, of two the shorter.
    return np.array([least[filled[np.abs(filled - c).argmin()]] for c in range(13)], dtype=np.float32)


def fit_centroids(counts: np.ndarray, labels: list[str], parts: Iterable[np.ndarray] = ()) -> Model:
    """Cluster the rows of every language; no randomness.

    ``parts`` are blocks of counts of parts of the texts, for the bounds only.
    """
    languages = sorted(set(labels))
    label = np.array([languages.index(x) for x in labels])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(languages, idf, np.zeros((0, DIMENSIONS)), np.zeros(0), np.zeros(13))
    x = model.vectors(counts)
    centroids, owner = [], []
    for i in range(len(languages)):
        rows = x[label == i]
        start = [0]
        while len(start) < min(CENTROIDS, len(rows)):  # farthest rows first
            start.append(int((rows @ rows[start].T).max(axis=1).argmin()))
        centre = rows[start]
        for _ in range(ROUNDS):
            nearest = (rows @ centre.T).argmax(axis=1)
            sums = np.stack(
                [rows[nearest == j].sum(axis=0) if (nearest == j).any() else centre[j] for j in range(len(centre))]
            )
            centre = _unit(sums)
        centroids.append(centre)
        owner += [i] * len(centre)
    model.centroids, model.owner = np.concatenate(centroids), np.array(owner)
    reached = (x @ model.centroids.T).max(axis=1)
    # (nearest cosine, length class) of every part
    seen = [((model.vectors(p) @ model.centroids.T).max(axis=1), length_class(p)) for p in parts]
    part_reached, part_classes = (np.concatenate([s[k] for s in seen] or [[]]) for k in (0, 1))
    model.least = least_cosines(reached, length_class(counts), part_reached, part_classes)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every text and, as rows without a language, of its parts."""

    def rows(piece, lang):
        counts = trigram_counts(piece)
        row, slot = np.nonzero(counts)
        per = np.bincount(row, minlength=len(piece))
        return pa.RecordBatch.from_arrays(
            [lang, lists(per, pa.array(slot.astype(np.int32))), lists(per, pa.array(counts[row, slot]))],
            ["lang", "slots", "counts"],
        )

    for batch in batches:
        for piece in slices(batch.column("text"), SLICE_BYTES):
            yield rows(piece, batch.column("lang").slice(piece.first, len(piece)))
            parts = [p for text in piece.texts for p in text_parts(text)]
            for first in range(0, len(parts), 512):
                some = Slice(0, parts[first : first + 512])
                yield rows(some, pa.nulls(len(some), pa.string()))


def train(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES
) -> Model | None:
    """Model from rows of ``key`` (any hash), ``lang`` and ``text``, or None without rows."""
    ship_package(labelled.sparkSession)
    labelled = labelled.withColumn("text_hash", F.xxhash64("text"))
    ranks = Window.partitionBy("lang").orderBy("key", "text_hash")
    # Repeated rows count once, so that equal keys cannot widen the sample. Ranking
    # below a constant drops the rest of a language before the second shuffle.
    lowest = (
        labelled.select("lang", "key", "text_hash")
        .distinct()
        .withColumn("rank", F.row_number().over(ranks))
        .filter(F.col("rank") <= per_language)
        .groupBy("lang")
        .agg(F.max(F.struct("key", "text_hash")).alias("cut"), F.count(F.lit(1)).alias("n"))
    )
    largest = lowest.orderBy(F.desc("n"), "lang").limit(max_languages)
    cuts = {r["lang"]: r["cut"] for r in largest.collect()}
    if not cuts:
        return None
    chosen = F.lit(False)
    for lang, cut in cuts.items():
        below = (F.col("key") < cut.key) | (
            (F.col("key") == cut.key) & (F.col("text_hash") <= cut.text_hash)
        )
        chosen = chosen | ((F.col("lang") == lang) & below)
    rows = (
        labelled.filter(chosen)
        .dropDuplicates(["lang", "key", "text_hash"])
        .select("lang", "text")
        .mapInArrow(_features, "lang string, slots array<int>, counts array<float>")
        .toArrow()
    )
    return fit_centroids(*sampled_counts(rows))


def sampled_counts(rows: pa.Table) -> tuple[np.ndarray, list[str], Iterator[np.ndarray]]:
    """Counts and languages of the texts of a sample in a fixed order, and blocks of counts of their parts."""
    # Numbers stay in arrays; as Python objects they would take nine times the memory.
    slots, counts = (rows[c].combine_chunks() for c in ("slots", "counts"))
    bounds = np.append(0, np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False)))
    slots, counts = (v.flatten().to_numpy(zero_copy_only=False) for v in (slots, counts))
    langs = rows["lang"].to_pylist()

    def order(i):
        at = slice(bounds[i], bounds[i + 1])
        return langs[i], slots[at].astype(">i4").tobytes(), counts[at].astype(">f4").tobytes()

    def dense(some):
        out = np.zeros((len(some), DIMENSIONS), dtype=np.float32)
        for k, i in enumerate(some):
            out[k, slots[bounds[i] : bounds[i + 1]]] = counts[bounds[i] : bounds[i + 1]]
        return out

    # The order of rows depends on scheduling; sorting makes the fit repeatable.
    plain = sorted((i for i, lang in enumerate(langs) if lang is not None), key=order)
    parts = [i for i, lang in enumerate(langs) if lang is None]
    blocks = (dense(parts[i : i + 1024]) for i in range(0, len(parts), 1024))
    return dense(plain), [langs[i] for i in plain], blocks


_ANSWER = (
    T.StructType()
    .add("lang_pred", T.StringType())
    .add("score", T.DoubleType())
    .add("rejected", T.BooleanType())
)


def _answered(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns as ``key_0, key_1, ...`` with the answer's columns.

    The model (centroids times dimensions) travels with the task.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = [f.name for f in batch.schema if f.name != "body"]
            for piece in slices(batch.column("body"), SLICE_BYTES):
                answers = [(UNKNOWN, 0.0, True)] * len(piece)
                if model is not None:
                    found = zip(*model.predict(trigram_counts(piece)))
                    answers = [
                        (model.languages[w], float(s), bool(r)) if has_letter(t) else (UNKNOWN, 0.0, True)
                        for t, (w, s, r) in zip(piece.texts, found)
                    ]
                columns = zip(*answers)
                kinds = (pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(piece.first, len(piece)) for n in names]
                    + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    [*names, *_ANSWER.fieldNames()],
                )

    picked = docs.select(
        *[F.col(c).alias(f"key_{i}") for i, c in enumerate(keep)], F.col("text").alias("body")
    )
    schema = T.StructType([*picked.schema.fields[:-1], *_ANSWER.fields])
    return picked.mapInArrow(apply, schema)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    return _answered(docs, model, keep).toDF(*keep, *_ANSWER.fieldNames())


def id_remainder(modulus: int):
    """crc32 of the id as text, modulo; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled texts outside the held-out fold."""
    return docs.filter(
        (id_remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select(F.xxhash64("doc_id").alias("key"), F.col("lang").cast("string").alias("lang"), "text")


def language_report(docs: DataFrame) -> DataFrame:
    model = train(training_rows(docs))
    return predict(docs, model, ["doc_id"]).select(
        "doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


def accepted_documents(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised, in their own columns."""
    model = train(training_rows(docs))
    accepted = _answered(docs, model, docs.columns).filter(~F.col("rejected"))
    return accepted.drop(*_ANSWER.fieldNames()).toDF(*docs.columns)


def op8_language(spark, sf_dir: str) -> DataFrame:
    return language_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
