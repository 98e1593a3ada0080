"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds) the
vectors of all its n-grams, and a language's prototype those of all its training texts.
A text has the language whose prototype has the largest cosine with it.

Letters are folded to lower case; a run of anything else is one word boundary. Letters
beyond the first ``LETTERS`` - 1 code slots share slots by a hash of the code point, so
any script of any plane works. Bundling is linear: prototypes need only n-gram counts per language,
which every task adds up before the shuffle, so that no group is ever gathered.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to
the smaller language name; rows without a language teach nothing; without any training
row every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import only

LETTERS = 64  # slots of letters; slot 0 is the word boundary
DIMENSIONS = 1024
GRAM = 3
GRAMS = LETTERS**GRAM


def _slot(c: str) -> int:
    """The slot of a character: 0 if it is not a letter."""
    low = c.lower()[0]
    if not c.isalpha():
        return 0
    return ord(low) - 96 if "a" <= low <= "z" else 27 + zlib.crc32(low.encode("utf-8", "surrogatepass")) % (LETTERS - 27)


def _slots() -> np.ndarray:
    """A slot for every code point of the basic plane; letters of other planes are looked up as they come."""
    return np.array([_slot(chr(c)) for c in range(1 << 16)], np.uint8)


_cache: dict[str, np.ndarray] = {}


def slots() -> np.ndarray:
    if "slots" not in _cache:
        _cache["slots"] = _slots()
    return _cache["slots"]


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-gram codes: the letters' vectors, rolled by their place and multiplied."""
    if "letters" not in _cache:
        drawn = np.random.default_rng(20240607).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
        _cache["letters"] = np.stack([np.roll(drawn, GRAM - 1 - place, axis=1) for place in range(GRAM)])
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(GRAM):
        out *= _cache["letters"][place][codes // LETTERS ** (GRAM - 1 - place) % LETTERS]
    return out.astype(np.float32)


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, with boundaries around words; empty without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = slots()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        found, at = np.unique(points[high], return_inverse=True)
        code[high] = np.array([_slot(chr(c)) for c in found.tolist()], np.uint8)[at]
    if not code.any():
        return np.zeros(0, np.int32)
    code = np.concatenate([[0], code, [0]]).astype(np.int32)
    code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])]
    if len(code) < GRAM:
        return np.zeros(0, np.int32)
    out = code[: len(code) - GRAM + 1].copy()
    for j in range(1, GRAM):
        out = out * LETTERS + code[j : len(code) - GRAM + 1 + j]
    return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(GRAMS, np.int64)
            g = grams(text)
            np.add.at(counts[lang], g, 1)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], ["lang", "gram", "n"])


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all rows of (text, lang) that have a language.

    What reaches the driver is bounded by languages x GRAMS counts.
    """
    sums = only(training.where("lang is not null"), "text", "lang").mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((len(langs), GRAMS), np.float32)
    if langs:
        counts[np.searchsorted(np.array(langs), np.array(sums.column("lang").to_pylist())), sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    used = np.flatnonzero(counts.any(0))
    out = np.zeros((len(langs), DIMENSIONS), np.float32)
    for i in range(0, len(used), 4096):
        out += counts[:, used[i : i + 4096]] @ gram_vectors(used[i : i + 4096])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.where(norm > 0, norm, 1)


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray, block: int = 128, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred and score of every row of docs; score: the cosine with the prototype, 0 if negative."""
    protos = protos.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            texts = batch.column("text")
            for i in range(0, len(texts), block):
                found = [grams(t) for t in texts.slice(i, block).to_pylist()]
                seen, inverse = np.unique(np.concatenate(found), return_inverse=True)
                owner = np.repeat(np.arange(len(found)), [len(g) for g in found])
                counts = np.bincount(owner * len(seen) + inverse, minlength=len(found) * len(seen)).reshape(len(found), len(seen)).astype(np.float32)
                vectors = counts @ gram_vectors(seen)
                norm = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ protos.T / np.where(norm > 0, norm, 1)[:, None] if len(langs) else np.zeros((len(found), 1))
                best = cosine.argmax(1) if len(found) else []
                for j, g in enumerate(found):
                    known = len(g) > 0 and len(langs) > 0
                    names.append(langs[best[j]] if known else "und")
                    scores.append(float(min(1.0, max(0.0, cosine[j, best[j]]))) if known else 0.0)
            kept = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*carry, "lang_pred", "score"])

    rows = only(docs, *carry, *({"text"} - set(carry)))
    schema = T.StructType([*(rows.schema[c] for c in carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))
