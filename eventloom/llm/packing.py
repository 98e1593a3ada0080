"""Packing of documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. The remainders' lengths,
rounded up to ``capacity // UNITS`` ids, form a histogram of at most ``UNITS`` classes; a
linear program over packing patterns covers it, whose columns a knapsack dynamic program
prices. Rounded patterns get numbers of sequences, and the pieces of each class, ranked
by task and place, take their slots by arithmetic. The driver sees the histogram alone.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each;
a null doc_id is kept as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import only, written
from eventloom.llm.subwords import WordIds

UNITS = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, place long"


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    unit = capacity // UNITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, counts = WordIds.shared(path), TaskContext.get().partitionId(), np.zeros(UNITS + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc, found in zip(ids, encoder.texts(batch.column("text").to_pylist()), strict=True):
                whole = found.tobytes() + end
                n = len(whole) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    c = -(-length // unit)
                    out.append((doc, start, length, zlib.crc32(whole[start * 4 : (start + length) * 4]), n, c, task, int(counts[c])))
                    counts[c] += 1
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    return run


def _price(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = int(np.searchsorted(sizes, w, "right"))
        best[w] = best[w - 1]
        if fits:
            gain = best[w - sizes[:fits]] + values[:fits]
            i = int(gain.argmax())
            if gain[i] > best[w] + 1e-12:
                best[w], took[w] = gain[i], i
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= sizes[took[w]]
    return float(best[room]), pattern


def _first_fit(sizes: np.ndarray, need: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: patterns that take the largest class that fits, each repeated until a class is used up."""
    columns, x, left = np.diag(room // sizes).astype(np.float64), np.zeros(len(sizes)), need.copy()
    while left.any():
        free, pattern = room, np.zeros(len(sizes))
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], free // sizes[i])
            free -= int(pattern[i] * sizes[i])
        used = np.flatnonzero(pattern)
        times = np.floor(left[used] / pattern[used]).min()
        # the class that ends the repetition stands for this column: it is in no later one
        ends = used[np.flatnonzero(np.floor(left[used] / pattern[used]) == times)[0]]
        left -= times * pattern
        left[ends] = 0  # fewer than one pattern's: packed after rounding
        columns[:, ends], x[ends] = pattern, times
    return columns, x


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with pivoting, row by row: small, and without threads of a linear-algebra library on the driver."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        j = i + int(np.abs(both[i:, i]).argmax())
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        rest = both[:, i].copy()
        rest[i] = 0
        both -= rest[:, None] * both[i]
    return both[:, n:]


def patterns(histogram: dict[int, int], room: int = UNITS, rounds: int = 2000) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: pieces}) that use up the histogram exactly, in few sequences.

    A revised simplex on the covering program with priced columns; its solution is
    rounded down, and what is left (a number of pieces that the classes bound) is packed
    by first fit of the largest class.
    """
    sizes = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([histogram[int(c)] for c in sizes], np.float64)
    columns, x = _first_fit(sizes, need, room)
    inverse = _inverse(columns)
    for _ in range(rounds):
        worth, column = _price(sizes, inverse.sum(0), room)
        if worth <= 1 + 1e-6:
            break
        d = (inverse * column).sum(1)
        able = d > 1e-9
        if not able.any():
            break
        ratio = np.full(len(d), np.inf)
        ratio[able] = x[able] / d[able]
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        columns[:, out] = column
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
    times = np.floor(x + 1e-9).astype(np.int64)
    left = need.astype(np.int64) - (columns.astype(np.int64) @ times)
    while (left < 0).any():  # rounding of x upwards by an error of floats
        times[int(np.flatnonzero((columns[int(np.argmin(left))] > 0) & (times > 0))[0])] -= 1
        left = need.astype(np.int64) - (columns.astype(np.int64) @ times)
    out_patterns = [(int(t), {int(sizes[i]): int(columns[i, p]) for i in np.flatnonzero(columns[:, p])}) for p, t in enumerate(times) if t]
    while left.any():
        free, pattern = room, {}
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(left[i]), free // int(sizes[i]))
            if n:
                pattern[int(sizes[i])] = n
                free -= n * int(sizes[i])
                left[i] -= n
        out_patterns.append((1, pattern))
    return out_patterns


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per class, rows of (first rank, pieces a sequence, first sequence, first slot)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        slot = 0
        for c, n in sorted(pattern.items(), reverse=True):
            rows.setdefault(c, []).append((used.get(c, 0), n, sequence, slot))
            used[c] = used.get(c, 0) + n * times
            slot += n
        sequence += times
    return {c: np.array(r, np.int64) for c, r in rows.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """A row per piece of every row of (doc_id, text): where its ids lie in which sequence."""
    pieces = written(only(docs, "doc_id", "text").mapInArrow(_cut(vocabulary, capacity, end_id), PIECE))
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("task")) - F.col("n")).drop("n")
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    slots = _slots(patterns(histogram))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                at = np.flatnonzero(c == k)
                t = slots[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                slot[at] = row[:, 3] + nth % row[:, 1]
            kept = [batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    ranked = pieces.join(before, ["class", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("before") + F.col("place")).alias("rank"))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.withColumn("offset", ahead).drop("slot")
