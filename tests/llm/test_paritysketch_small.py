import random

import numpy as np

from eventloom.llm import paritysketch as P
from tests.llm.test_paritysketch import brute


def at_threshold(percent):
    """(size, left out, put in) of every nested or swapped pair of 4 to 30 shingles at the threshold or the last step above it."""
    for n in range(4, 31):
        out = max(x for x in range(n) if 100 * (n - x) >= percent * n)
        swaps = max(x for x in range(n) if 100 * (n - x) >= percent * (n + x))
        yield from {(n, out, 0), (n, swaps, swaps)} - {(n, 0, 0)}


def test_small_linked_sets_share_the_smaller_need():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for n, out, put in at_threshold(percent):
            for _ in range(60):
                drawn = rng.integers(0, 1 << 63, n + put, dtype=np.uint64)
                a, b = np.unique(drawn[:n]), np.unique(drawn[out:])
                assert P.linked(a, b, percent)
                x, y = ({band: (key, need) for band, key, need in P.banded_keys(s, percent)} for s in (a, b))
                assert x.keys() & y.keys()
                for band in x.keys() & y.keys():
                    assert len(np.intersect1d(x[band][0], y[band][0])) >= min(x[band][1], y[band][1])


def test_small_pairs_match_brute_force(spark):
    rng = random.Random(4)
    for k, percent in ((4, 85), (5, 80)):
        rows = []
        for n, out, put in list(at_threshold(percent)) * 10:
            base = [f"w{rng.randrange(10**9)}" for _ in range(n + k - 1)]
            new = [f"w{rng.randrange(10**9)}" for _ in range(put)]
            rows += [" ".join(base), " ".join(base[out:] + new)]
        rows = list(enumerate(rows))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {tuple(r) for r in P.jaccard_components(df, k, percent).collect()} == brute(rows, k, percent)
