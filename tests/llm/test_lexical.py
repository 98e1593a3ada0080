import math
import re
from collections import Counter

import numpy as np

from eventloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, most=10):
    found = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c in found:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def test_equal_to_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["naïve", "Ünder", "日本語", "x_y", "I.B.M", "İx"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=(p := 1 / np.arange(1, 67)) / p.sum()))
    docs = [(i, text(int(rng.integers(1, 40)))) for i in range(300)]
    docs += [(i + 500, docs[3][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, " \t--"), (903, text(5000))]
    items = [(i, text(12)) for i in range(20)] + [(50, None), (51, "zzz unknown"), (None, "w1 w2 w2 NAÏVE"), (3, "w3"), (3, "w3 日本語 x"), (60, docs[3][1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    expected = brute(docs, items)
    assert sorted(map(tuple, lexical.search(lexical.index(df), asked).collect()), key=str) == expected
    monkeypatch.setattr(lexical, "BROADCAST", 0)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    assert sorted(map(tuple, lexical.search(lexical.index(df), asked).collect()), key=str) == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.index(docs), items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search(lexical.index(docs), items.limit(0)).collect() == []
    assert lexical.search(lexical.index(docs), items).collect() == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (1000000000 // (1000 + 800)))]


def test_numbers_packed_and_back():
    values = np.array([0, 1, 127, 128, 300, 1 << 14, (1 << 14) - 1, 1 << 40, (1 << 62) + 5], np.int64)
    data, ends = lexical.packed(values)
    assert (lexical.unpacked(data.tobytes()) == values).all() and ends[-1] == len(data)
    assert len(lexical.packed(np.zeros(0, np.int64))[0]) == 0 and len(lexical.unpacked(b"")) == 0


def test_merge_over_many_shards_equals_a_plain_sum():
    rng = np.random.default_rng(3)
    for most in (1, 3, 10):
        best, plain = lexical.Best(most), Counter()
        for shard in range(6):
            docs = sorted(rng.choice(10_000, 200, False).tolist())
            lists = []
            for _ in range(8):
                places = sorted(rng.choice(200, int(rng.integers(1, 120)), False).tolist())
                gains = rng.integers(0, 30 if rng.random() < 0.5 else 4, len(places)).tolist()
                times = int(rng.integers(1, 3))
                lists.append((max(gains), times, places, gains))
                for p, g in zip(places, gains, strict=True):
                    plain[docs[p], shard] += times * g
            lexical.merge(sorted(lists, key=lambda x: x[0] * x[1]), docs, best)
        expected = sorted(((s, -d) for (d, _), s in plain.items() if s > 0), reverse=True)[:most]
        assert sorted(best.heap, reverse=True) == expected
