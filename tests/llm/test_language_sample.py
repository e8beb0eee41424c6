"""The sample of the language model as it reaches the driver."""

import tracemalloc

import numpy as np
import pyarrow as pa

from chatloom.llm import language


def test_sample_is_sorted_and_stays_in_arrays():
    """Order and counts equal those of sorted tuples, in a fraction of the memory of lists."""
    rng = np.random.default_rng(3)
    langs, slots, counts = [], [], []
    for k in range(1200):
        n = int(rng.integers(0, 900))
        langs.append([None, "en", "de"][k % 3] if k % 4 else None)
        slots.append(np.sort(rng.choice(min(language.DIMENSIONS, 1000), min(n, 1000), replace=False)).astype(np.int32))
        counts.append(rng.integers(1, 9, len(slots[-1])).astype(np.float32))
    langs += ["en", "en", "de"]
    slots += [slots[1], slots[1][:3], np.zeros(0, dtype=np.int32)]
    counts += [counts[1] + 1, counts[1][:3], np.zeros(0, dtype=np.float32)]
    kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()))
    halves = [
        pa.table([pa.array(c[s], k) for c, k in zip((langs, slots, counts), kinds)], ["lang", "slots", "counts"])
        for s in (slice(0, 500), slice(500, None))
    ]
    rows = pa.concat_tables(halves)
    tracemalloc.start()
    dense, found, blocks = language.sampled_counts(rows)
    peak = tracemalloc.get_traced_memory()[1] - dense.nbytes
    parts = np.concatenate(list(blocks))
    tracemalloc.stop()
    assert peak <= 3 * rows.nbytes
    want = sorted((a, b.tolist(), c.tolist()) for a, b, c in zip(langs, slots, counts) if a is not None)
    assert found == [w[0] for w in want]
    for row, (_, at, values) in zip(dense, want):
        assert np.flatnonzero(row).tolist() == at and row[at].tolist() == values
    loose = [(b, c) for a, b, c in zip(langs, slots, counts) if a is None]
    assert len(parts) == len(loose)
    assert all(row[b].tolist() == c.tolist() and np.count_nonzero(row) == len(b) for row, (b, c) in zip(parts, loose))
