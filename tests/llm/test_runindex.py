import hashlib
import random

import numpy as np

from eventloom.llm import runindex as X


def brute(rows, length=50):
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, letters="abcdefghij é": "".join(rng.choice(letters) for _ in range(n))
    parts = [say(rng.choice([30, 49, 50, 51, 52, 60, 90, 200, 700])) for _ in range(12)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 500, "ab" * 100, "aab" * 90, parts[-1], parts[-1], say(3000) + parts[3]]
    for _ in range(60):
        texts.append("".join(rng.choice(parts)[rng.choice([0, 0, 3]) :] if rng.random() < 0.6 else say(rng.choice([1, 7, 40])) for _ in range(rng.randrange(1, 6))))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = [*corpus(1), (None, "x" * 200), (500, "x" * 70), (500, "x" * 70), (500, "y" * 80)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    assert sorted((tuple(r) for r in X.remove_repeats(df).collect()), key=str) == brute(rows)


def test_large_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "GROUP", 3)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in X.remove_repeats(df).collect()), key=str) == brute(rows)


def test_kept_text(spark):
    rows = [(1, "unique words only " * 1), (2, "a" * 60), (3, "b" + "a" * 60 + "c")]
    got = {r["doc_id"]: r["kept"] for r in X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert got == {1: rows[0][1], 2: "a" * 60, 3: "bc"}


def test_run_index_finds_all_matches():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 84))).encode() for _ in range(80)] + [b"ab" * 40, b"ba" * 40, b"\x00" * 60, b"\x00" * 84]
    owners = np.array([rng.randrange(40) for _ in strings])
    for length in (10, 30, 50):
        s, p = X.RunIndex(strings, owners, length).matched(owners)
        first = {}
        for o, t in zip(owners.tolist(), strings, strict=True):
            for i in range(len(t) - length + 1):
                first[t[i : i + length]] = min(o, first.get(t[i : i + length], o))
        want = {(k, i) for k, t in enumerate(strings) for i in range(len(t) - length + 1) if first[t[i : i + length]] < owners[k]}
        assert set(zip(s.tolist(), p.tolist(), strict=True)) == want


def test_empty(spark):
    assert X.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
