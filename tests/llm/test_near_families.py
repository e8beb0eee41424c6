"""Near duplicates in families that share many buckets."""

import random

import numpy as np
import pyarrow as pa

from chatloom.llm import neardup
from chatloom.llm.scan import slices


def test_families_keep_their_links(spark):
    """Copies of one original link through it; pairs around the threshold mostly stay."""
    rng = random.Random(5)

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"x{rng.random()}"
        return words

    original, other = ([f"{c}{i}" for i in range(200)] for c in "ab")
    rows = [original, *(edited(original, 2) for _ in range(80))]
    family = [edited(other, 3) for _ in range(80)]
    rows += family + [edited(t, 3) for t in family[:20]]
    texts = [" ".join(r) for r in rows]
    bags = [b for piece in slices(pa.array(texts, pa.large_string())) for b in neardup._bag(piece)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.bag_similarity(bags[i], bags[j]) >= 0.8]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicate_report(frame).collect()}
    together = sum(found[i] == found[j] for i, j in links)
    assert len({found[i] for i in range(81)}) == 1
    assert together >= 0.9 * len(links) and len(links) > 100
    apart = neardup.near_duplicate_report(frame.filter("doc_id IN (0, 100)")).collect()
    assert len({r.class_id for r in apart}) == 2


def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch):
    """A family of texts just below the threshold hides a few links; classes equal brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 24)  # several blocks in a bucket
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    template = [word() for _ in range(8)] * 3 + [word() for _ in range(276)]
    texts = []
    for k in range(150):
        own = template[:264] + [word() for _ in range(36)]
        texts.append(own)
        if k % 6 == 0:
            cut = rng.randrange(20, 30)
            texts.append(own[:-cut] + [word() for _ in range(cut)])
    texts = [" ".join(t) for t in texts]
    bags = [b for piece in slices(pa.array(texts, pa.large_string())) for b in neardup._bag(piece)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.bag_similarity(bags[i], bags[j]) >= 0.8]
    assert 10 < len(links) < len(texts)
    class_of = list(range(len(texts)))
    for i, j in links:
        low, high = sorted((class_of[i], class_of[j]))
        class_of = [low if c == high else c for c in class_of]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicate_report(frame).collect()}
    assert found == dict(enumerate(class_of))


def test_overlaps_of_blocks_equal_those_of_pairs():
    """Overlaps of a block equal those of single pairs, with repeated shingles."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(1, 60))) for _ in range(40)]
    doc, item, weight, bags = [], [], [], []
    for piece in slices(pa.array(texts, pa.large_string())):
        d, i, w = neardup.shingles(piece)
        doc, item, weight = [*doc, *(d + piece.first)], [*item, *i], [*weight, *w]
        bags += neardup._bag(piece)
    left, right = np.arange(0, 40, 2), np.arange(1, 40, 3)
    shared = neardup._overlaps(np.array(doc), np.array(item), np.array(weight), left, right)
    for x, a in enumerate(left):
        for y, b in enumerate(right):
            total = bags[a][1].sum() + bags[b][1].sum()
            assert a == b or abs(shared[x, y] / (total - shared[x, y]) - neardup.bag_similarity(bags[a], bags[b])) < 1e-12


def test_members_are_joined_once_whatever_the_blocks(spark, monkeypatch):
    """Rows of a large bucket that are joined with their texts do not grow with its blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    template = [word() for _ in range(264)]
    rows = [(k, " ".join(template + [word() for _ in range(36)])) for k in range(100)]
    landed, plain = {}, neardup.land

    def counted(frame, purpose):
        found = plain(frame, purpose)
        landed.setdefault(purpose, []).append(found)
        return found

    monkeypatch.setattr(neardup, "land", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicate_report(frame).collect()
    assert all(r.class_id == r.doc_id for r in found)
    placed = next(x[0] for name, x in landed.items() if name in ("bag-placed", "bag-sent"))
    n = placed.count()
    assert n == placed.select("key", "node").distinct().count() > 100
