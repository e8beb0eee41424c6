"""Line dedup, spelling variants and the prefix trie against sequential models."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatloom.llm import lines, prefixes, queries, spelling
from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_prefixes", "op12_lines", "op13_spelling"])
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], duck(FOLDER)) is None


# Lines


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    high[:50] = 7  # keys that agree in one half
    sizes, words, number = lines.perfect_hash(high, low)
    assert sorted(number.tolist()) == list(range(5000))
    assert sum(sizes) == 64 * len(words) < 4 * 5000


def kept_lines(rows, least=lines.LEAST):
    blank = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blank).translate(lower)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = []
        for line in own:
            ids = holders[key(line)]
            known = [i for i in ids if i is not None]
            if len(key(line)) < least or len(ids) < 2 or doc_id == min(known):
                kept.append(line)
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINE_ROWS = [
    (3, "A common line here\nonly in three\n\n\n"),
    (1, "  a COMMON line here\t\nshort\nshort"),
    (1, "  a COMMON line here\t\nshort\nshort"),  # a repeated row
    (2, "short\nécole du soir\nécole du soir\na common line here\r"),
    (4, "ÉCOLE DU SOIR\nécole DU soir"),
    (None, "a common line here\nno id has this line"),
    (None, "no id has this line"),
    (5, None),
    (6, ""),
    (7, "ééééééééé\nééééééééé\nlong " * 2000 + "\nélevé à dix"),
    (8, "ééééééééé\nlong ééééééééé\nélevé à dix"),
]


@pytest.mark.parametrize("index_keys", [lines.INDEX_KEYS, 2])
def test_lines_against_a_model(spark, index_keys):
    schema = "doc_id long, text string, keeper string, n_lines string"
    frame = spark.createDataFrame([(*r, "x", "y") for r in LINE_ROWS], schema)
    found = lines.distinct_lines(frame, index_keys=index_keys).collect()
    got = sorted([(r.doc_id, r.n_lines, len(r.dropped_at), r.kept_text) for r in found], key=str)
    assert got == kept_lines(LINE_ROWS)
    assert lines.distinct_lines(frame.limit(0), index_keys=index_keys).count() == 0


def test_lines_sent_to_their_shards_give_the_same(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = ["doc_id", "n_lines", "dropped_at", "dropped_counts", "kept_text"]
    near, far = (sorted(map(tuple, lines.distinct_lines(docs, index_keys=n).select(columns).collect())) for n in (lines.INDEX_KEYS, 5))
    assert near == far and any(r[2] for r in near)


# Spelling


def grouped_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        if len(a) == len(b):
            return a != b and a[p + 1 :] == b[p + 1 :]
        return len(b) == len(a) + 1 and a[p:] == b[p + 1 :]

    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [spelling.LEVELS, 2])
def test_spelling_against_all_pairs(spark, levels):
    rng = random.Random(4)
    base = ["colour", "theatre", "aaaaaaa", "élève", "straße", "ÀÉtage", "banana", "w" * 40 + "xyz" * 30]
    words = []
    for w in base:
        variants = [w]
        for _ in range(12):
            v = list(rng.choice(variants))
            at = rng.randrange(len(v))
            kind = rng.randrange(3)
            v[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("aeé÷z")]
            variants.append("".join(v))
        words += [v for v in variants for _ in range(rng.choice([1, 3, 4, 9, 30]))]
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]).replace("a", "A", i)) for i in range(40)]
    rows += [(7, rows[7][1]), (None, "theatre, banana; theatre"), (41, None), (42, ""), (43, "1 2 3 ab")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = sorted([tuple(r) for r in spelling.spelling_groups(frame, levels=levels).collect()], key=str)
    want = grouped_words(rows)
    assert got == want and sum(r[1] is not None for r in want) > 10
    assert spelling.spelling_groups(frame.limit(0)).count() == 0


# Prefixes


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, ms in members.items():
        below = [m for m in members if m[: len(k)] == k]
        out.append(
            (
                min(ms),
                len(k),
                min(members[k[:-1]]) if k else None,
                len(ms),
                children[k],
                sum(not children[m] for m in below),
                sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
                SHA(",".join(map(str, sorted(c for c in ms if len(rebuilt[c]) == len(k))))),
            )
        )
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(0, 12), *range(100, 130), *range(-105, -96), 250, 251, 400]:
        n = rng.choice([1, 2, 4, 7, 9, 14])
        for t in range(n):
            rows.append((conv, rng.choice([t, t, t, None, 3]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "é!", None, ""])))
    rows += rows[:9]  # repeated turns
    rows += [(None, 1, "user", "of nobody"), (300, None, None, None)]
    return rows


@pytest.mark.parametrize("whole_turns", [prefixes.WHOLE_TURNS, 3])
def test_trie_against_a_model(spark, whole_turns):
    schema = "conv_id long, turn long, role string, text string, depth string, a string"
    rows = conversations(whole_turns)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = sorted([tuple(r) for r in prefixes.prefix_trie(frame, whole_turns).collect()], key=str)
    assert got == trie(rows)
    assert prefixes.prefix_trie(frame.limit(0), whole_turns).count() == 0


def test_one_conversation_is_one_tail(spark):
    rows = [(100, t, "user", f"t{t}") for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted([tuple(r) for r in prefixes.prefix_trie(frame).collect()], key=str) == trie(rows)


def test_a_full_sketch_gives_the_same(spark, monkeypatch):
    rows = [(c, t, "user", f"{c % 7 if t < 3 else c}:{t}") for c in range(900) for t in range(9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted([tuple(r) for r in prefixes.prefix_trie(frame).collect()], key=str)
    monkeypatch.setattr(prefixes, "MAX_WIDTH", prefixes.MIN_WIDTH)  # one block a row
    assert sorted([tuple(r) for r in prefixes.prefix_trie(frame).collect()], key=str) == whole
