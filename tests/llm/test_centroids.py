import hashlib

import numpy as np
import pytest

from eventloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int"


def brute(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, own, strict=True) if c == n] for n in range(len(means))]
        means = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, means, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted(
        ((i, c, d, sum(x for _, e, x in found if e == c), total, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, c, d in found), key=str
    )


def test_equal_to_brute_force_with_ties_and_unfit_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 64).astype("f").tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(40)]  # copies: ties of hashes' vectors, equal distances
    rows += [(7, rows[7][1]), (None, rows[3][1]), (2000, None), (2001, [0.5] * 63), (2002, [0.5] * 63 + [None]), (2003, [0.5] * 63 + [float("nan")]), (2004, [float("inf")] * 64), (2005, [0.0] * 64), (2006, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=str) == brute(rows)


def test_fewer_vectors_than_centroids_empty_tables_and_large_components(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()), key=str) == brute(rows)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64, 1)], SCHEMA)).collect()


@pytest.mark.parametrize("size", [40, 1 << 20, 1 << 26])
def test_the_interval_never_loses_the_nearest(size):
    rng = np.random.default_rng(size)
    means = rng.integers(-size, size, (16, 64))
    means[5] = means[2]
    means[9] = means[3]
    means[9, 0] += 1
    near = means[rng.integers(0, 16, 500)] + rng.integers(-2, 3, (500, 64))
    middle = (means[rng.integers(0, 16, 500)] + means[rng.integers(0, 16, 500)]) // 2  # two centroids about as far
    vectors = np.concatenate([near, middle, rng.integers(-size, size, (500, 64))])
    exact = ((vectors[:, None] - means) ** 2).sum(2)
    found, distance, compared = centroids.screened(vectors, means)
    assert (found == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert 0 < compared < len(vectors)
