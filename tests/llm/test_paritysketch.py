import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from eventloom.llm import paritysketch as P


def brute(rows, k, percent):
    sets, parent = {}, {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "two words", "three little words", "four words stand here", "a\x0bb c\x0cd", "x" * 5000]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 40, 150, 600]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.01, 0.02, 0.04]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    for k, percent in ((4, 85), (5, 80)):
        got = {tuple(r) for r in P.jaccard_components(df, k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.jaccard_components(df).collect()) == [(2, 2, 2), (5, 2, 2), (5, 2, 2)]
    assert P.jaccard_components(df.limit(0)).count() == 0


def test_linked_sets_share_the_pieces_they_need():
    rng = np.random.default_rng(1)
    for size in (7, 20, 64, 300):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for swaps in range(1 + size // 12):
            b = np.unique(np.concatenate([a[swaps:], rng.integers(0, 1 << 63, swaps, dtype=np.uint64)]))
            if P.linked(a, b, 85) and swaps:
                (ka, na), (kb, nb) = P.piece_keys(a, 85), P.piece_keys(b, 85)
                assert len(np.intersect1d(ka, kb)) >= max(na.max(), nb.max())


def test_shingles_do_not_depend_on_the_batch():
    texts = [t for _, t in corpus()]
    whole = [s.tolist() for _, s in P.shingle_sets(pa.array(texts, pa.string()), 4)]
    alone = [next(P.shingle_sets(pa.array([t], pa.string()), 4))[1].tolist() for t in texts]
    assert whole == alone
    groups = defaultdict(set)
    for t, s in zip(texts, whole, strict=True):
        groups[P.class_of(np.array(s, np.uint64))].add(tuple(s))
    assert all(len(g) == 1 for g in groups.values())


def test_null_and_shared_ids(spark):
    """No doc_id: linked with nothing; a shared doc_id: each row by its own text."""
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y"
    rows = [(None, near), (None, near + " z"), (9, near), (9, "quite another text of some eight words here"), (4, near + " z"), (7, "quite another text of some eight words here"), (8, None), (None, None)]
    got = P.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(None, 22, None), (None, 23, None), (9, 22, 4), (9, 5, 7), (4, 23, 4), (7, 5, 7), (8, 0, 8), (None, 0, None)]))


def test_very_long_and_many_equal_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), *[(10 + i, "the same few words in every row") for i in range(300)]]
    got = {r["doc_id"]: r["component_id"] for r in P.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got[2] == 1 and all(got[10 + i] == 10 for i in range(300))
