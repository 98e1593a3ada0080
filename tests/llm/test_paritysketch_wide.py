import numpy as np
import pandas as pd

from eventloom.llm import paritysketch as P


def drawn(rng, sizes):
    """Sets of some sizes, each with two copies that differ in 4 and 30 of 100 shingles; every copy a component of its own."""
    sets = []
    for size in sizes:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        sets.append(a)
        for share in (0.04, 0.3):
            n = int(size * share)
            sets.append(np.unique(np.concatenate([a[n:], rng.integers(0, 1 << 63, n, dtype=np.uint64)])))
    return sets


def test_sketches_tell_long_texts_apart():
    rng = np.random.default_rng(5)
    sets = drawn(rng, [700, 2040, 2060, 4090, 4110, 6000, 8190, 8200, 9000, 60_000])
    rows = pd.DataFrame({"class": np.arange(len(sets)), "component": np.arange(len(sets)), "n_shingles": [len(s) for s in sets], "sketch": [P.sketch(s) for s in sets]})
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if P.linked(sets[i], sets[j], 80)}
    assert len(linked) == 10
    once = P._compared(80, False)(rows.assign(asks=True, stays=True))
    pairs = [tuple(sorted((u, v))) for u, near in zip(once["u"], once["near"], strict=True) for v in near]
    assert len(pairs) == len(set(pairs)) and set(pairs) == linked  # of 435 pairs those of 5,000 shingles and more could not be told apart
    two = P._compared(80, False)(pd.concat([rows.assign(asks=True, stays=False), rows.assign(asks=False, stays=True)], ignore_index=True))
    assert {(u, v) for u, near in zip(two["u"], two["near"], strict=True) for v in near} == linked | {(v, u) for u, v in linked}
    best = P._compared(80, True)(rows.assign(asks=True, stays=True))
    assert {(u, near[0]) for u, near in zip(best["u"], best["near"], strict=True)} == linked | {(v, u) for u, v in linked}


def test_a_sketch_folds_to_that_of_fewer_bits():
    s = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 5000, dtype=np.uint64))
    wide = np.frombuffer(P.sketch(s), np.uint64).reshape(1, -1)
    narrow = np.packbits((np.bincount((s & np.uint64(2047)).astype(np.int64), minlength=2048) & 1).astype(np.uint8)).tobytes()
    assert wide.shape[1] == 128 and P.folded(wide, 32)[0].tobytes() == narrow
