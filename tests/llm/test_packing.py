import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from eventloom.llm import packing
from eventloom.llm.subwords import VOCABULARY, WordIds

PATH = str(public_tokenizers.path(VOCABULARY))
TEXTS = [None, "", "Hello, World.", "It's 12,5 % İstanbuĺ <|endoftext|> x y\tz\r\nend.", "word " * 9000, "naïve café ÉÉ. ça, α. Ω, ...", "é áb,", "hello " * 4095, "\x00   tab"]


def test_ids_equal_the_library(spark):
    t = Tokenizer.from_file(PATH)
    for text, got in zip(TEXTS, WordIds(PATH).texts(TEXTS), strict=True):
        assert got.tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    pieces = packing.pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, _ in rows}
    for i, whole in ids.items():
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(whole)
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(whole)
            assert p["ids_crc32"] == zlib.crc32(np.array(whole[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert sequences.get(p["sequence_id"], 0) == p["offset"]
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(sequences.values()) <= 4096 and sorted(sequences) == list(range(len(sequences)))


def test_patterns_use_the_histogram_up():
    rng = np.random.default_rng(0)
    histogram = {int(c): int(n) for c, n in zip(range(1, 257), rng.integers(0, 400, 256), strict=True)}
    plan = packing.patterns(histogram)
    used = {}
    for times, pattern in plan:
        assert sum(c * n for c, n in pattern.items()) <= 256
        for c, n in pattern.items():
            used[c] = used.get(c, 0) + n * times
    assert used == {c: n for c, n in histogram.items() if n}
    least = sum(c * n for c, n in histogram.items()) / 256
    assert sum(t for t, _ in plan) <= 1.03 * least + 60
    assert packing.patterns({}) == []


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
