"""Find secrets by pattern and by a battery of randomness tests.

Patterns give the base spans. The method adds tokens that look random: every
run of 20 or more key characters gets an inferred encoding (the smallest known
alphabet that holds it) and three tests under uniform symbols of that alphabet:
chi-squared uniformity, runs above and below the middle, and serial
correlation. Fisher's sum of the three p-values is the score.

Strings of one case have no digits or cases to tell them from words, so they are
judged by a letter model instead: the mean log-likelihood of their letter pairs
against uniform letters, if the battery does not refute uniform symbols.

False discoveries are controlled per length and group of encodings. The null is
made of the corpus itself, of all documents and at any size: the words of a
document below 20 letters are joined and cut into strings of each length class,
which are scored like tokens, as letters, as letters with digits, with a capital
at each word and with hyphens between words. The share of null strings that look
at least as random is the p-value of a token (with a log-linear tail), and the
Benjamini-Hochberg step over all tokens of a group sets its cut. Scores are
counted in bins, so what reaches the driver is a table of length classes times
bins and one of letter pairs, whatever the number of documents.

Defined results: missing and empty texts have no spans; repeated rows are
scanned alike; other columns are ignored, whatever their names; a text of any
length is scanned whole; equal scores are accepted or rejected together; an empty
table gives no rows. Digits alone are no tokens, since numbers follow the same law.
A length class without null strings takes over the shorter ones; without any null
string the p-value is 1 and nothing is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.scan import Slice, runs, slices
from chatloom.session import land, ship_package

KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 20
RATE = 0.01
# Scores are -10 * log10(p), cut at the last bin.
BINS = 120
# Lengths are classed by the first bound they do not exceed.
LENGTHS = np.array([20, 21, 23, 26, 31, 39, 63, 127, 1 << 40])
# Null strings have the least length of each class.
NULL_LENGTHS = np.array([20, *(LENGTHS[:-1] + 1)])
# Groups of encodings: one case, one case with digits, both cases or signs.
ONE_CASE, WITH_DIGITS, MIXED = range(3)
GROUPS = 3
# Uniform letters are refuted below this p-value of the battery.
REFUTED = 1e-4
# Letter-pair scores from -4 to 2 natural units fill the bins.
PAIR_FLOOR, PAIR_STEPS = -4.0, BINS / 6.0

ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# Encodings from the smallest alphabet to the largest.
ALPHABETS = (
    DIGITS,
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    LOWER,
    UPPER,
    UPPER + "234567",
    DIGITS + LOWER,
    DIGITS + UPPER,
    "".join(c for c in DIGITS + UPPER + LOWER if c not in "0OIl"),
    DIGITS + UPPER + LOWER,
    UPPER + LOWER + DIGITS + "+/=",
    UPPER + LOWER + DIGITS + "-_=",
    UPPER + LOWER + DIGITS + "+/=-_",
)
_SIZE = np.array([len(a) for a in ALPHABETS])
_CODE = np.full((len(ALPHABETS), 256), -1, dtype=np.int16)
for _row, _letters in enumerate(ALPHABETS):
    _CODE[_row, [ord(c) for c in _letters]] = np.arange(len(_letters))
_IN = np.array(
    [sum(1 << e for e in range(len(ALPHABETS)) if _CODE[e, b] >= 0) for b in range(256)],
    dtype=np.int64,
)
_TOKEN = _CODE[-1] >= 0
_HEX = _CODE[1] >= 0
_LOWER_AT, _UPPER_AT = ALPHABETS.index(LOWER), ALPHABETS.index(UPPER)
_LOWER_DIGITS_AT = ALPHABETS.index(DIGITS + LOWER)
_GROUP = np.where(_SIZE > 36, MIXED, WITH_DIGITS)
_GROUP[[_LOWER_AT, _UPPER_AT]] = ONE_CASE
_LETTER = np.isin(np.arange(256), [ord(c) for c in LOWER + UPPER])


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (rational approximation, 1e-7)."""
    x = np.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    series = t * (
        0.319381530
        + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    tail = np.exp(-0.5 * x * x) * 0.3989422804014327 * series
    return np.where(z >= 0, tail, 1.0 - tail)


def battery(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encoding: int | None = None
) -> tuple:
    """Encoding and combined p-value, under uniform random symbols, of each token.

    The encoding is inferred unless one is given that holds all tokens.
    """
    n = (ends - starts).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - first[owner] + starts[owner]
    chars = data[at]
    common = np.bitwise_and.reduceat(_IN[chars], first)
    if encoding is None:
        encoding = np.argmax((common[:, None] >> np.arange(len(ALPHABETS))) & 1, axis=1)
    else:
        encoding = np.full(len(n), encoding)
    code = _CODE[encoding[owner], chars].astype(np.int64)
    size = _SIZE[encoding].astype(np.float64)

    width = int(_SIZE.max())
    counts = np.bincount(owner * width + code, minlength=len(n) * width).reshape(len(n), width)
    chi = (counts * counts).sum(axis=1) * size / n - n
    deviation = np.sqrt(2.0 * (size - 1) * (n - 1) / n)
    # Wilson-Hilferty on a chi-squared law with the mean and variance of the statistic.
    freedom = 2.0 * (size - 1) ** 2 / deviation**2
    ratio = np.maximum(chi / (size - 1), 1e-9)
    z = (np.cbrt(ratio) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    p_uniform = _normal_tail(z)

    high = code >= (size / 2)[owner]
    n_high = np.add.reduceat(high.astype(np.int64), first)
    n_low = n - n_high
    same = owner[1:] == owner[:-1]
    turns = np.bincount(owner[1:], weights=(high[1:] != high[:-1]) & same, minlength=len(n)) + 1
    product = 2.0 * n_high * n_low
    mean = product / n + 1
    spread = np.sqrt(np.maximum(product * (product - n) / (n * n * np.maximum(n - 1.0, 1)), 1e-9))
    p_runs = np.where(
        (n_high == 0) | (n_low == 0), 0.0, 2 * _normal_tail(np.abs(turns - mean) / spread)
    )

    centred = code - (np.add.reduceat(code, first) / n)[owner]
    squares = np.add.reduceat(centred * centred, first)
    products = np.bincount(
        owner[1:], weights=np.where(same, centred[1:] * centred[:-1], 0.0), minlength=len(n)
    )
    r = products / np.maximum(squares, 1e-9)
    p_serial = np.where(squares <= 0, 0.0, 2 * _normal_tail(np.abs(r + 1 / n) * np.sqrt(n)))

    tests = np.clip(np.stack([p_uniform, p_runs, p_serial]), 1e-300, 1.0)
    half = -np.log(tests).sum(axis=0)  # half of Fisher's statistic, 6 degrees of freedom
    return encoding, np.exp(-half) * (1 + half + half * half / 2)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n, side="left")


def score_bin(p: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, (-10 * np.log10(np.clip(p, 1e-300, 1))).astype(np.int64))


def pair_score(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray
) -> np.ndarray:
    """Mean log-likelihood of the letter pairs of each token, against uniform letters."""
    letters = (data | 32).astype(np.int64) - 97
    valid = (letters[:-1] >= 0) & (letters[:-1] < 26) & (letters[1:] >= 0) & (letters[1:] < 26)
    gain = np.where(valid, pairs[np.where(valid, letters[:-1] * 26 + letters[1:], 0)], 0.0)
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    return (sums[ends - 1] - sums[starts]) / (ends - starts - 1)


def pair_model(counts: dict[int, int]) -> np.ndarray:
    """log(P(second letter | first letter) * 26) of the 676 letter pairs."""
    table = np.full(26 * 26, 0.5)
    for pair, n in counts.items():
        table[pair] += n
    table = table.reshape(26, 26)
    return np.log(26 * table / table.sum(axis=1, keepdims=True)).ravel()


def _one_case_bin(p: np.ndarray, score: np.ndarray) -> np.ndarray:
    bins = np.clip((score - PAIR_FLOOR) * PAIR_STEPS, 0, BINS - 1).astype(np.int64)
    return np.where(p < REFUTED, BINS - 1, bins)


def _code(group, starts: np.ndarray, ends: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return (group * len(LENGTHS) + length_class(ends - starts)) * BINS + bins


def token_codes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray
) -> np.ndarray:
    """(group, length class, bin) of each token as one number; -1 for digits alone."""
    encoding, p = battery(data, starts, ends)
    group = _GROUP[encoding]
    bins = score_bin(p)
    one_case = group == ONE_CASE
    if one_case.any():
        score = pair_score(data, starts[one_case], ends[one_case], pairs)
        bins[one_case] = _one_case_bin(p[one_case], score)
    return np.where(encoding == 0, -1, _code(group, starts, ends, bins))


class Words:
    """The short words of each document of a slice, joined without spaces."""

    def __init__(self, piece: Slice) -> None:
        starts, ends = runs(_TOKEN[piece.data])
        others = np.concatenate([[0], np.cumsum(~_LETTER[piece.data])])
        n = ends - starts
        keep = (n >= 2) & (n < MIN_TOKEN) & (others[ends] == others[starts])
        self.starts, self.n = starts[keep], n[keep]
        self.doc = piece.owner(self.starts)
        self.data, self.n_docs = piece.data, len(piece)

    def joined(self, sign: int | None = None, capitals: bool = False) -> tuple:
        """Bytes of all documents and the end of each; ``sign`` follows every word."""
        n = self.n + (sign is not None)
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first, n)
        inside = at < np.repeat(self.n, n)
        source = np.repeat(self.starts, n) + np.where(inside, at, 0)
        out = self.data[source] | 32
        if sign is not None:
            out = np.where(inside, out, sign).astype(np.uint8)
        if capitals:
            out[first] -= 32
        return out, np.cumsum(np.bincount(self.doc, weights=n, minlength=self.n_docs)).astype(np.int64)

    def strings(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the null strings of each document; their lengths take turns."""
        turn, bounds = int(NULL_LENGTHS.sum()), np.cumsum(NULL_LENGTHS)
        sizes = np.diff(ends, prepend=0)
        n = sizes // turn * len(bounds) + np.searchsorted(bounds, sizes % turn, side="right")
        doc = np.repeat(np.arange(len(sizes)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        stop = (ends - sizes)[doc] + at // len(bounds) * turn + bounds[at % len(bounds)]
        return stop - NULL_LENGTHS[at % len(bounds)], stop


def null_codes(piece: Slice, pairs: np.ndarray) -> np.ndarray:
    """Codes of the null strings of a slice."""
    words = Words(piece)
    codes = [np.zeros(0, dtype=np.int64)]
    if not len(words.n):
        return codes[0]
    data, bounds = words.joined()
    starts, ends = words.strings(bounds)
    if len(starts):
        _, p = battery(data, starts, ends, _LOWER_AT)
        codes.append(_code(ONE_CASE, starts, ends, _one_case_bin(p, pair_score(data, starts, ends, pairs))))
        _, p = battery(data, starts, ends, _LOWER_DIGITS_AT)
        codes.append(_code(WITH_DIGITS, starts, ends, score_bin(p)))
    for style in ({"capitals": True}, {"sign": ord("-")}):
        data, bounds = words.joined(**style)
        starts, ends = words.strings(bounds)
        if len(starts):
            encoding, p = battery(data, starts, ends)
            # A string inside one word has no capital or sign.
            mixed = _GROUP[encoding] == MIXED
            codes.append(_code(MIXED, starts, ends, score_bin(p))[mixed])
    return np.concatenate(codes)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each letter pair occurs in the short words of each slice."""
    for batch in batches:
        for piece in slices(batch.column("text")):
            words = Words(piece)
            if not len(words.n):
                continue
            data, ends = words.joined()
            letters = data.astype(np.int64) - 97
            same = np.ones(len(letters) - 1, dtype=bool)
            same[ends[(ends > 0) & (ends < len(letters))] - 1] = False
            counts = np.bincount((letters[:-1] * 26 + letters[1:])[same], minlength=26 * 26)
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["pair", "n"]
            )


def _base_spans(piece: Slice) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) in bytes of each document, by pattern."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in piece.texts]
    for d, text in enumerate(piece.texts):
        if b"=" in text or b":" in text:
            for m in ASSIGN.finditer(text):
                if m.end(1) - m.start(1) >= 6:
                    found[d].append((m.start(), m.end(), 0))
        if b"AKIA" in text:
            for m in ACCESS.finditer(text):
                if m.end() - m.start() >= 20:
                    found[d].append((m.start(), m.end(), 1))
    starts, ends = runs(_HEX[piece.data])
    keep = ends - starts >= 24
    owners = piece.owner(starts[keep])
    for s, e, d in zip(starts[keep], ends[keep], owners):
        begin = piece.starts[d]
        found[d].append((int(s - begin), int(e - begin), 2))
    for spans in found:
        spans.sort(key=lambda x: (x[0], x[2]))
    return found


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans."""
    if not spans or text.isascii():
        return spans
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    return [(int(at[s]), int(at[e]), k) for s, e, k in spans]


_SPAN = T.StructType().add("start", "long").add("end", "long").add("kind", "integer").add("bin", "integer")
_SCHEMA = (
    T.StructType()
    .add("base_sha256", T.StringType())
    .add("spans", T.ArrayType(_SPAN))
    .add("nulls", T.ArrayType(T.StructType().add("code", "integer").add("n", "long")))
)


def _scan(batches: Iterator[pa.RecordBatch], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    span_type = pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("bin", pa.int32())]
    )
    null_type = pa.struct([("code", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        texts = batch.column("text")
        for piece in slices(texts):
            base = _base_spans(piece)
            starts, ends = runs(_TOKEN[piece.data])
            keep = ends - starts >= MIN_TOKEN
            starts, ends = starts[keep], ends[keep]
            extra: list[list] = [[] for _ in piece.texts]
            if len(starts):
                codes = token_codes(piece.data, starts, ends, pairs)
                owners = piece.owner(starts)
                for s, e, c, d in zip(starts, ends, codes, owners):
                    s, e = int(s - piece.starts[d]), int(e - piece.starts[d])
                    if c >= 0 and not any(x[0] < e and s < x[1] for x in base[d]):
                        extra[d].append((s, e, int(c)))
            null = null_codes(piece, pairs)
            # Distinct codes of the slice with their counts, at its first document.
            seen, times = np.unique(null, return_counts=True)
            words = [{"code": int(c), "n": int(n)} for c, n in zip(seen, times)]
            hashes, all_spans = [], []
            for d, text in enumerate(piece.texts):
                spans = _points(text, base[d])
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                rows = [{"start": s, "end": e, "kind": k, "bin": None} for s, e, k in spans]
                rows += [
                    {"start": s, "end": e, "kind": 3, "bin": c}
                    for s, e, c in _points(text, extra[d])
                ]
                all_spans.append(rows)
            others = [
                batch.column(i).slice(piece.first, len(piece))
                for i, f in enumerate(batch.schema)
                if f.name != "text"
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *others,
                    pa.array(hashes, pa.string()),
                    pa.array(all_spans, pa.list_(span_type)),
                    pa.array([words] + [[]] * (len(piece) - 1), pa.list_(null_type)),
                ],
                [*[f.name for f in batch.schema if f.name != "text"], *_SCHEMA.fieldNames()],
            )


def null_shares(counts: np.ndarray) -> np.ndarray:
    """p-value of each bin: the share of null strings in bins up to it.

    Where fewer than ten null strings lie, the line through the logarithms of the
    tenth string's share and of a share of one in ten is continued. Scores of null
    strings fall off faster than that, so the line errs to the safe side, and the
    resolution does not depend on the size of the corpus.
    """
    total, below = counts.sum(), np.cumsum(counts)
    if not total:
        return np.ones(len(counts))
    share = (below + 1) / (total + 1)
    low, high = (int(np.argmax(below >= n)) for n in (10, max(10, 0.1 * total)))
    if total < 100 or low == high:
        return share
    slope = np.log(below[high] / below[low]) / (high - low)
    line = below[low] / total * np.exp(-slope * (low - np.arange(len(counts))))
    return np.where(below < 10, np.maximum(line, below / total), share)


def discovery_cuts(nulls: dict[int, int], candidates: dict[int, int], rate: float) -> list[int]:
    """Largest accepted bin of each class (-1: none), by Benjamini-Hochberg in each group.

    Keys are ``class * BINS + bin``, where classes are lengths within groups of
    encodings; small bins look random. The p-value of a bin is the share of null
    strings of the class that score at least as random.
    """
    n_classes = GROUPS * len(LENGTHS)
    word = np.zeros((n_classes, BINS))
    found = np.zeros((n_classes, BINS))
    for table, counts in ((word, nulls), (found, candidates)):
        for code, n in counts.items():
            table[code // BINS, code % BINS] = n
    p = np.stack([null_shares(row) for row in word])
    # The tests only gain power with length: a length with few null strings
    # takes over the share of shorter ones.
    p = np.minimum.accumulate(p.reshape(GROUPS, len(LENGTHS), BINS), axis=1).reshape(p.shape)
    cuts: list[int] = []
    for shares, n in zip(np.split(p, GROUPS), np.split(found, GROUPS)):
        order = np.argsort(shares, axis=None, kind="stable")
        accepted = np.cumsum(n.ravel()[order])
        ranked = shares.ravel()[order]
        passing = np.flatnonzero((ranked <= rate * accepted / max(n.sum(), 1)) & (accepted > 0))
        cut = ranked[passing[-1]] if len(passing) else -1.0
        cuts += [int((row <= cut).sum()) - 1 for row in shares]
    return cuts


def find_secrets(
    docs: DataFrame, rate: float = RATE, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep`` columns of every document with ``base_sha256`` and ``found`` spans.

    ``found`` is an array of ``start, kind, end`` (code points, end exclusive)
    by start, then kind.
    """
    return _found(docs, rate, keep, text_col).toDF(*keep, "base_sha256", "found")


def _found(docs: DataFrame, rate: float, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """As ``find_secrets``, with the kept columns as ``key_0, key_1, ...``."""
    spark = docs.sparkSession
    ship_package(spark)
    picked = docs.select(
        *[F.col(c).alias(f"key_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text")
    )
    fields = [f for f in picked.schema.fields if f.name != "text"]
    pairs = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(_count_pairs, "pair int, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )
    model = pair_model({r["pair"]: r["n"] for r in pairs.collect()})
    scanned = land(
        picked.mapInArrow(lambda rows: _scan(rows, model), T.StructType([*fields, *_SCHEMA.fields])),
        "secrets",
    )

    def histogram(codes):
        counts = codes.groupBy("code").agg(F.sum("n").alias("n"))
        return {r["code"]: r["n"] for r in counts.collect()}

    bins = scanned.select(F.explode("spans.bin").alias("code"), F.lit(1).alias("n"))
    cuts = discovery_cuts(
        histogram(scanned.select(F.inline("nulls"))), histogram(bins.filter("code is not null")), rate
    )
    limit = F.array(*[F.lit(c) for c in cuts])
    passes = lambda x: x["bin"].isNull() | (
        x["bin"] % BINS <= F.get(limit, F.floor(x["bin"] / BINS).cast("int"))
    )
    kept = F.array_sort(
        F.transform(
            F.filter("spans", passes),
            lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
        )
    )
    keys = [f"key_{i}" for i in range(len(keep))]
    return scanned.select(*keys, "base_sha256", kept.alias("found"))


def joined_spans(found: str):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            found,
            lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"]),
        ),
        ",",
    )


def secret_report(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Counts, digest and spans of every document."""
    found = find_secrets(docs, rate)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        "base_sha256",
        joined_spans("found").alias("spans"),
        count(3).alias("n_random"),
    )


def redact_secrets(docs: DataFrame, rate: float = RATE, mask: str = "[secret]") -> DataFrame:
    """The documents, in their own columns, with every secret replaced by ``mask``.

    Overlapping spans are replaced once. Texts without secrets stay as they are.
    """
    keep = tuple(docs.columns)
    # The text goes through the scan as one more kept column.
    found = _found(docs, rate, keep, "text")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))
    text = F.col(f"key_{keep.index('text')}")
    piece = lambda start, end: F.substr(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        done = F.when(
            fresh, F.concat(acc["done"], piece(acc["at"], x["start"]), F.lit(mask))
        ).otherwise(acc["done"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), done.alias("done"))

    whole = F.aggregate(
        "found",
        state,
        step,
        lambda acc: F.concat(acc["done"], piece(acc["at"], F.length(text).cast("bigint"))),
    )
    changed = F.when(F.size("found") > 0, whole).otherwise(text)
    return found.select(
        *[changed.alias(c) if c == "text" else F.col(f"key_{i}").alias(c) for i, c in enumerate(keep)]
    )


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
