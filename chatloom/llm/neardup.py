"""Near duplicates by BagMinHash.

A text is the multiset of its 5-word shingles (lower-case ASCII). Each shingle
owns Poisson processes over its weight, one per dyadic layer of the integer
weights: layer 0 covers (0, 1], layer k covers (2^(k-1), 2^k]. A point has a
time, a signature component and a weight position; it counts when the position
is below the shingle's count. The first point of every component is the
signature, so that components of two texts agree with the probability of their
weighted Jaccard similarity. Points are generated in time order and only up to
the time that fills all components, about ``COMPONENTS * log`` per text.

Signatures are banded. Inside a bucket every text is paired with two leaders
(first by key and first by hash of the key, orders that are the same in all
bands, so that the buckets of a large class agree on few leaders). Pairs whose
signatures agree enough are verified by the exact multiset overlap of the whole
texts, and verified links are joined to components.

Then all others meet, but for pairs of one component. In buckets of at most
``SMALL`` texts they become rows like those of the leaders. Larger buckets are cut
into blocks of about ``BLOCK`` texts (fewer, if they are long), those of the
bucket's largest component apart from the rest, and every pair of blocks that may
hold a link is one group: it takes the pairs of different components whose
signatures agree and whose first common band is this bucket, computes their exact
overlaps as a matrix product, and returns a spanning forest of the links. So no
join has a row per pair of a large bucket, a group holds two blocks, and no pair
of a bucket is left out. The comparisons inside a family of many texts just below
the threshold still grow with its square.

Equal texts are one node from the start. Defined results: texts without words
are classes of their own text (all empty and missing texts are equal); texts of
fewer than five words are one shingle; repeated rows are members of one class;
a missing id is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.components import connected_components
from chatloom.llm.scan import Rolling, Slice, combine, mix, slices, uniform
from chatloom.session import land, ship_package

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
COMPONENTS = BANDS * ROWS
# Pairs below this agreement are dropped: at similarity 0.8 it lies more than
# four standard deviations below the mean.
LEAST_AGREEMENT = 0.6
SMALL = 16  # texts of a bucket that may all meet
BLOCK = 256  # texts of a block of a larger bucket
BLOCK_WORDS = 1 << 18
COLUMNS = 1 << 12  # shingles that a matrix product takes at once
SENT_KEYS = 200_000  # text keys that are broadcast, of about 30 bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(piece: Slice, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of every distinct shingle, sorted by document."""
    starts, ends, doc = piece.words()
    ids = Rolling(_LOWER[piece.data]).spans(starts, ends)
    n_words = np.bincount(doc, minlength=len(piece))
    # Texts shorter than a shingle are padded with a zero word.
    width = max(len(ids) - n + 1, 0)
    at = np.flatnonzero(doc[:width] == doc[n - 1 :][:width])
    hashes = combine(*[ids[at + k] for k in range(n)])
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    first = np.searchsorted(doc, short)
    padded = [np.where(k < n_words[short], ids[np.minimum(first + k, len(ids) - 1)], np.uint64(0)) for k in range(n)] if len(short) else []
    docs = np.concatenate([doc[at], short])
    hashes = np.concatenate([hashes, combine(*padded)]) if len(short) else hashes
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return docs[first], hashes[first], np.diff(np.append(first, len(docs)))


def bag_signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signature (n_docs x m, 64-bit) of weighted sets; documents without items get zeros."""
    # One unit for every layer that reaches below the weight.
    layers = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    unit = np.repeat(np.arange(len(item)), layers)
    first = np.cumsum(layers) - layers
    layer = np.arange(len(unit)) - first[unit]
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    width = np.where(layer == 0, 1.0, low)
    seed = combine(item[unit], layer.astype(np.uint64))
    unit_doc, limit = doc[unit], weight[unit].astype(np.float64)

    total = np.bincount(doc, weights=weight, minlength=n_docs)
    best = np.full(n_docs * m, np.inf)
    winner = np.zeros(n_docs * m, dtype=np.uint64)
    horizon = (np.log(m) + 3.0) / np.maximum(total, 1)
    open_docs = total > 0
    while open_docs.any():
        active = np.flatnonzero(open_docs[unit_doc])
        time = np.zeros(len(active))
        step = 0
        while len(active):
            h = mix(seed[active] + np.uint64(step * 4 + 1))
            time = time - np.log(uniform(h)) / (width[active] * m)
            ahead = time <= horizon[unit_doc[active]]
            active, time, h = active[ahead], time[ahead], h[ahead]
            component = (mix(h + np.uint64(2)) >> np.uint64(33)) % np.uint64(m)
            inside = low[active] + uniform(mix(h + np.uint64(3))) * width[active] < limit[active]
            slot = unit_doc[active] * m + component.astype(np.int64)
            slot, when, tag = slot[inside], time[inside], h[inside]
            np.minimum.at(best, slot, when)
            won = best[slot] == when
            winner[slot[won]] = tag[won]
            step += 1
        open_docs &= np.isinf(best.reshape(n_docs, m)).any(axis=1)
        horizon = np.where(open_docs, horizon * 2, horizon)
    return winner.reshape(n_docs, m)


_SIGNED = (
    T.StructType()
    .add("weight", T.LongType())
    .add("signature", T.BinaryType())
    .add("bands", T.ArrayType(T.LongType()))
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [f.name for f in batch.schema if f.name != "body"]
        for piece in slices(batch.column("body")):
            n = len(piece)
            doc, item, weight = shingles(piece)
            signature = bag_signatures(doc, item, weight, n)
            rows = signature.reshape(n, BANDS, ROWS)
            band = combine(
                np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)),
                *[rows[:, :, r] for r in range(ROWS)],
            )
            total = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
            small = np.ascontiguousarray((signature >> np.uint64(32)).astype(np.uint32))
            offsets = pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(piece.first, n) for c in names]
                + [
                    pa.array(total),
                    pa.array([small[i].tobytes() for i in range(n)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(band.ravel().view(np.int64))),
                ],
                [*names, *_SIGNED.fieldNames()],
            )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, COMPONENTS)
            for c in ("signature_a", "signature_b")
        )
        keep = (left == right).mean(axis=1) >= LEAST_AGREEMENT
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _bag(piece: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    doc, item, weight = shingles(piece)
    bounds = np.searchsorted(doc, np.arange(len(piece) + 1))
    return [(item[s:e], weight[s:e]) for s, e in zip(bounds, bounds[1:])]


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - shared
    return shared / union if union else 0.0


PAIRS_AT_ONCE = 64


def _verify(threshold: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(first, PAIRS_AT_ONCE)
                keys = [part.column(c).to_pylist() for c in ("a", "b")]
                texts = dict(zip(keys[0], part.column("text_a").to_pylist()))
                texts.update(zip(keys[1], part.column("text_b").to_pylist()))
                bags = {}
                names = list(texts)
                column = pa.array([texts[k] for k in names], pa.large_string())
                for piece in slices(column):
                    bags.update(zip(names[piece.first :], _bag(piece)))
                similar = np.array([bag_similarity(bags[a], bags[b]) for a, b in zip(*keys)])
                keep = np.flatnonzero(similar >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [*part.select(["a", "b"]).take(pa.array(keep)).columns, pa.array(similar[keep])],
                    ["a", "b", "similarity"],
                )

    return apply


def _overlaps(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed minima of the weights of all multisets ``left`` (rows) and ``right``, given by their
    distinct numbers; a number on both sides has no overlap with itself."""
    n = max(left.max(), right.max()) + 1
    shared = np.zeros((len(left), len(right)))
    _, column, times = np.unique(item, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    doc, column, weight = doc[keep], number[column[keep]], weight[keep]
    order = np.argsort(column, kind="stable")
    doc, column, weight = doc[order], column[order], weight[order]
    for first in range(0, int(often.sum()), COLUMNS):
        s, e = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((n, COLUMNS), dtype=np.float32)
        held[doc[s:e], column[s:e] - first] = 1
        shared += held[left] @ held[right].T
    # What repeated shingles add to one each.
    at = [np.full(n, -1), np.full(n, -1)]
    for place, side in zip(at, (left, right)):
        place[side] = np.arange(len(side))
    more = np.flatnonzero(weight > 1)
    bounds = np.flatnonzero(np.append(True, column[more][1:] != column[more][:-1])) if len(more) else []
    for s, e in zip(bounds, np.append(bounds[1:], len(more))):
        own, extra = doc[more[s:e]], weight[more[s:e]] - 1
        rows, columns = (place[own] >= 0 for place in at)
        shared[np.ix_(at[0][own[rows]], at[1][own[columns]])] += np.minimum.outer(extra[rows], extra[columns])
    return shared


def _forest(pairs: list[tuple[int, int]]) -> list[int]:
    """Positions of the pairs that join two trees, in their order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for k, (x, y) in enumerate(pairs):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


_LINK = "a binary, b binary, similarity double"


def _meet_blocks(threshold: float):
    """Links of one pair of blocks of a bucket: a spanning forest over the components."""

    def apply(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, block = group["node"].to_pylist(), group["block"].to_numpy()
        names = {x: k for k, x in enumerate(dict.fromkeys(group["label"].to_pylist()))}
        label = np.array([names[x] for x in group["label"].to_pylist()])
        signature = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=np.uint32).reshape(-1, COMPONENTS)
        band = np.array(group["bands"].to_pylist(), dtype=np.int64).reshape(-1, BANDS)
        key, i, j = (group[c][0].as_py() for c in ("key", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        agreement = np.zeros((len(left), len(right)), dtype=np.uint8)
        for k in range(COMPONENTS):
            agreement += signature[left, k][:, None] == signature[right, k]
        open_pairs = (agreement >= LEAST_AGREEMENT * COMPONENTS) & (label[left][:, None] != label[right])
        for k in range(int(np.argmax(band[0] == key))):  # pairs that an earlier bucket holds
            open_pairs &= band[left, k][:, None] != band[right, k]
        if i == j:
            open_pairs = np.triu(open_pairs)
        a, b = np.nonzero(open_pairs)
        links = []
        if len(a):
            rows, columns = np.unique(a), np.unique(b)
            left, right, open_pairs = left[rows], right[columns], open_pairs[np.ix_(rows, columns)]
            used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
            parts = [
                (doc + piece.first, item, weight)
                for piece in slices(group["text"].take(pa.array(used)).combine_chunks().cast(pa.large_string()))
                for doc, item, weight in [shingles(piece)]
            ]
            doc, item, weight = (np.concatenate(x) for x in zip(*parts))
            total = np.bincount(doc, weights=weight, minlength=len(used))
            x, y = place[: len(left)], place[len(left) :]
            shared = _overlaps(doc, item, weight, x, y)
            similarity = shared / (total[x][:, None] + total[y] - shared)
            a, b = np.nonzero(open_pairs & (similarity >= threshold))
            found = similarity[a, b]
            order = np.argsort(-found, kind="stable")
            a, b, found = left[a[order]], right[b[order]], found[order]
            kept = _forest(list(zip(label[a].tolist(), label[b].tolist())))
            links = [(*sorted((nodes[a[k]], nodes[b[k]])), found[k]) for k in kept]
        one, other, found = zip(*links) if links else ((), (), ())
        return pa.table([pa.array(one, pa.binary()), pa.array(other, pa.binary()), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return apply


def node_key(text: str = "text"):
    """128-bit key of a text; a missing text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _links(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Landed rows (``doc_id, node``) and verified links between different texts."""
    ship_package(docs.sparkSession)
    picked = docs.select("doc_id", node_key().alias("node"), F.col("text").alias("body"))
    schema = T.StructType([*picked.schema.fields[:-1], *_SIGNED.fields])
    rows = land(picked.mapInArrow(_sign, schema), "bag-rows")
    nodes = land(
        rows.filter("weight > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("weight").alias("weight"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ),
        "bag-nodes",
    )
    members = _members(nodes)
    led = members.select("node", F.explode("leaders").alias("leader")).filter("node <> leader")
    links = _verified(docs, nodes, led.select(*_ordered("node", "leader")), threshold)
    inside = members.filter((F.col("n") > 2) & (F.col("n") <= SMALL) & ~F.array_contains("leaders", F.col("node")))
    small = _all_meet(_labelled(inside.select("key", "node"), connected_components(links)))
    links = links.union(_verified(docs, nodes, small, threshold))
    large = members.filter(F.col("n") > SMALL).select("key", "node")
    if not large.isEmpty():
        links = links.union(_block_links(docs, nodes, large, connected_components(links), threshold))
    return rows.select("doc_id", "node"), links


def _members(nodes: DataFrame) -> DataFrame:
    """Landed members ``key, node, n, leaders`` of the buckets that several nodes have."""
    keys = nodes.select(F.explode("bands").alias("key"), "node")
    leaders = (
        keys.groupBy("key")
        .agg(
            F.min("node").alias("first"),
            F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("other"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .select("key", F.array_distinct(F.array("first", "other.node")).alias("leaders"), "n")
    )
    # Landed, so that the join has plain sides and a hot bucket is split.
    return land(keys.join(land(leaders, "bag-leaders"), "key"), "bag-members")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (``key, node``) with ``label``, of the buckets that hold several components."""
    found = land(rows.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "bag-labelled")
    split = found.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
    return found.join(land(split.select("key"), "bag-split"), "key", "left_semi")


def _block_links(docs: DataFrame, nodes: DataFrame, large: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Landed links between the components (``labels``) of each bucket of ``large`` (``key, node``)."""
    weighed = large.join(nodes.select("node", "weight"), "node").join(labels, "node", "left")
    found = land(weighed.select("key", "node", "weight", F.coalesce("label", "node").alias("label")), "bag-labelled")
    parts = found.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    shape = parts.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_WORDS)).cast("int")
    shape = shape.filter("n > main.n").select(
        "key",
        F.col("main.label").alias("main"),
        blocks(F.col("main.n"), F.col("main.w")).alias("mains"),
        blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("rests"),
    )
    # The largest component comes first and does not meet itself.
    in_main = F.col("label") == F.col("main")
    dealt = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    last = F.col("mains") + F.col("rests") - 1
    block = F.when(in_main, dealt(F.col("mains"))).otherwise(F.col("mains") + dealt(F.col("rests")))
    others = F.sequence(F.when(in_main, F.col("mains")).otherwise(0), last)
    placed = found.join(land(shape, "bag-shapes"), "key").select("key", "node", "label", block.alias("block"), others.alias("others"))
    placed = land(placed, "bag-placed")
    texts = _texts(docs, nodes, placed.select("node").distinct())
    # A member is joined once and then sent to every block that it meets.
    whole = placed.join(nodes.select("node", "signature", "bands"), "node").join(texts, "node")
    sent = whole.withColumn("other", F.explode("others")).drop("others")
    sent = sent.select("*", *_ordered("block", "other", "i", "j")).drop("other")
    return land(sent.groupBy("key", "i", "j").applyInArrow(_meet_blocks(threshold), _LINK), "bag-links")


def _all_meet(apart: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most ``SMALL`` texts."""
    met = apart.groupBy("key").agg(F.collect_list(F.struct("node", "label")).alias("own"))
    each = met.select("own", F.posexplode("own").alias("pos", "left"))
    both = each.select("left", F.explode(F.slice("own", F.col("pos") + 2, F.lit(SMALL))).alias("right"))
    return both.filter("left.label <> right.label").select(*_ordered("left.node", "right.node"))


def _ordered(x: str, y: str, a: str = "a", b: str = "b") -> list:
    return [F.least(x, y).alias(a), F.greatest(x, y).alias(b)]


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Landed links among ``pairs`` (``a, b``) of nodes, by the exact overlap of the texts."""
    signature = lambda side: nodes.select(F.col("node").alias(side), F.col("signature").alias(f"signature_{side}"))
    key = "a binary, b binary"
    signed = pairs.distinct().join(signature("a"), "a").join(signature("b"), "b")
    likely = land(signed.mapInArrow(_agreeing, key), "bag-pairs")
    wanted = likely.select("a").union(likely.select("b")).distinct().toDF("node")
    texts = _texts(docs, nodes, wanted)
    text = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    checked = likely.join(text("b"), "b").join(text("a"), "a")
    return land(checked.mapInArrow(_verify(threshold), _LINK), "bag-links")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Landed ``node, text`` of the nodes ``wanted``."""
    one_each = land(nodes.join(wanted, "node", "left_semi").select(F.col("node").alias("n"), F.col("doc_id").alias("d")), "bag-wanted")
    if one_each.count() <= SENT_KEYS:
        one_each = F.broadcast(one_each)
    body = F.coalesce(F.col("text"), F.lit("")).alias("text")
    whole = docs.select("doc_id", node_key().alias("node"), body)
    return land(
        whole.join(one_each, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        .select("node", "text")
        .dropDuplicates(["node"]),
        "bag-texts",
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, n_links`` and its text's ``node``.

    ``class_id`` is the smallest id of the class; ``n_links`` counts verified
    links of the document's text to other texts.
    """
    rows, links = _links(docs, threshold)
    labels = connected_components(links)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    )
    # Sizes and ids are summed per text first, so that no join sees all copies.
    per_node = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = land(
        per_node.join(labels, "node", "left")
        .join(degree, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "bag-named",
    )
    classes = named.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = named.join(classes, "label").select(
        "node", "label", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return rows.join(of_node, "node")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return found.select("doc_id", "class_id", "class_size", "n_links", kept.alias("kept"))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, in its own columns: the one with the smallest id.

    Only where several rows share that id (or have none), one of them is taken.
    """
    found = near_duplicates(docs, threshold).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = land(found.select(F.col("node").alias("keep_node"), F.col("doc_id").alias("keep_id"), F.col("label").alias("keep_label")), "bag-kept")
    chosen = keep.groupBy("keep_label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("keep_node", "keep_id")).alias("one"))
    repeated = chosen.filter("n > 1").select("keep_label")
    names = [f"column_{i}" for i in range(len(docs.columns))]
    text, at = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    rows = docs.toDF(*names).withColumn("key", node_key(text))
    match = (F.col("key") == F.col("keep_node")) & F.col(at).eqNullSafe(F.col("keep_id"))
    if repeated.isEmpty():
        met = rows.join(keep.drop("keep_label"), match, "left_semi")
    else:
        one = chosen.select("one.keep_node", "one.keep_id")
        met = rows.join(one, match, "left_semi").dropDuplicates(["key"])
    return met.drop("key").toDF(*docs.columns)


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
