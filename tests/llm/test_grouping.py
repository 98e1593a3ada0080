import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from eventloom.llm import grouping
from eventloom.llm.subwords import VOCABULARY

PATH = str(public_tokenizers.path(VOCABULARY))


def plain_best_fit(lengths, room=4096):
    """Sequences that best fit with falling lengths needs, piece by piece."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(room - n)
    return len(free)


def check(pieces, docs, capacity=4096):
    t = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            expected[doc, p, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == expected
    upto = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert upto.get(p["sequence_id"], 0) == p["offset"]
        upto[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(upto.values()) <= capacity
    return len(upto)


def test_every_piece_once_and_few_sequences(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "word " * 9000, "hello " * 4095, "hello " * 4096, "It's 12,5 % İstanbuĺ <|endoftext|>"]
    texts += [" ".join(["word"] * int(n)) for n in np.clip(rng.lognormal(6.3, 1.1, 700), 1, 9000)]
    docs = [*enumerate(texts), (5, texts[5]), (None, "a b")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, offset int, piece int").repartition(3)
    pieces = grouping.pack(df, PATH).collect()
    used = check(pieces, docs)
    lengths = [p["length"] for p in pieces]
    assert used <= plain_best_fit(lengths) + 2 and used <= -(-sum(lengths) // 4096) * 1.01 + 2


def test_large_pieces_alone(spark):
    """Without small ones the few sizes decide: never far behind best fit."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(900, 2200, 500))]
    pieces = grouping.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, groups=20).collect()
    assert check(pieces, docs) <= plain_best_fit([p["length"] for p in pieces]) * 1.02 + 1


def test_empty_table(spark):
    assert grouping.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_configurations_cover_no_more_than_is_needed_and_are_near_the_bound():
    rng = np.random.default_rng(6)
    sizes = np.unique(rng.integers(513, 4096, 90))[::-1]
    need = rng.integers(50, 400, len(sizes))
    plan = grouping.configurations(sizes, need, 4096)
    assert all((c * sizes).sum() <= 4096 for _, c in plan)
    used = sum(t * c for t, c in plan)
    assert (used <= need).all() and (need - used).sum() <= 8 * len(sizes)


def test_best_fit_on_counts_equals_piece_by_piece():
    rng = np.random.default_rng(7)
    for _ in range(20):
        rest = np.zeros(65, np.int64)
        rest[rng.integers(1, 40, 30)] = rng.integers(0, 30, 30)
        rooms = {int(r): int(n) for r, n in zip(rng.integers(0, 64, 10), rng.integers(1, 9, 10), strict=True)}
        plan, new = grouping.best_fit(rest, rooms, 64)
        free = [r for r, n in rooms.items() for _ in range(n)]
        old = len(free)
        for length in range(63, 0, -1):
            for _ in range(rest[length]):
                fits = [i for i, f in enumerate(free) if f >= length]
                if fits:
                    free[min(fits, key=free.__getitem__)] -= length
                else:
                    free.append(64 - length)
        assert new == len(free) - old
        placed = Counter()
        for length, rows in plan.items():
            ends = [*rows[1:, 0].tolist(), int(rest[length])]
            for (first, _, start, rank, _), end in zip(rows.tolist(), ends, strict=True):
                for k in range(first, end):
                    placed[start, rank + (k - first) // rows[rows[:, 0] == first][0, 1]] += length
        assert sorted(start - placed[start, rank] for start, n in [*rooms.items(), (64, new)] for rank in range(n)) == sorted(free)
