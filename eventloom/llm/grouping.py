"""Packing by linear grouping: few sizes first, then the documents themselves, then best fit.

Pieces longer than an eighth of a sequence are large. Ranked by falling length, they form
``GROUPS`` groups of equal cardinality, each rounded up to its largest. A linear program
over configurations of these few sizes (priced by a knapsack) says how often each is
used; its whole part takes the largest pieces of each group, by arithmetic on their ranks.
With the actual lengths in their places the sequences have more room; large pieces that
rounding left over and all small ones go there by best fit, longest first, and into new
sequences when no room is left. Best fit depends on lengths and rooms alone, so the driver
plans it on two histograms of at most ``capacity`` rows; pieces and sequences are ranked in
their classes by Spark and meet by equality of (room, rank). A whole-length piece is a
sequence of its own.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each;
a null doc_id is kept as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import only, written
from eventloom.llm.subwords import WordIds

GROUPS = 128
#: A piece is large beyond this part of a sequence.
LARGE = 8
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, place long"
DEALT = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, slot int, item long"
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _cut(path: str, capacity: int, end_id: int):
    """Pieces with their place among those of the same length in the task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, counts = WordIds.shared(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text").to_pylist()), strict=True):
                whole = found.tobytes() + end
                for start in range(0, len(whole) // 4, capacity):
                    ids = whole[start * 4 : (start + capacity) * 4]
                    length = len(ids) // 4
                    out.append((doc, start // capacity, start, length, zlib.crc32(ids), task, int(counts[length])))
                    counts[length] += 1
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(PIECE))

    return run


def _ranked(df: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """``df`` (key, task, place) with ``rank`` among rows of the same key, and the histogram of keys."""
    counts = df.groupBy(key, "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("task")) - F.col("n")).drop("n")
    histogram = {r[key]: r["n"] for r in df.groupBy(key).agg(F.count("*").alias("n")).collect()}
    return df.join(before, [key, "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "task"), histogram


def _price(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: an unbounded knapsack, one size at a time over all rooms."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for i in np.argsort(-worth / sizes):
        size = int(sizes[i])
        if worth[i] <= 1e-12:
            break
        for start in range(size, room + 1, size):  # after each block, one more piece of this size may follow
            end = min(start + size, room + 1)
            gain = best[start - size : end - size] + worth[i]
            better = gain > best[start:end] + 1e-12
            best[start:end][better] = gain[better]
            last[start:end][better] = i
    pattern, w = np.zeros(len(sizes), np.int64), int(best.argmax())
    value = float(best[w])
    while w > 0 and last[w] >= 0:
        pattern[last[w]] += 1
        w -= int(sizes[last[w]])
    return value, pattern


def configurations(sizes: np.ndarray, need: np.ndarray, room: int, rounds: int = 5000) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each size) of an optimal fractional covering, rounded down, never more than is needed.

    A revised simplex over configurations that starts with those of one size each.
    """
    if not len(sizes):
        return []
    need = need.astype(np.float64)
    per = room // sizes
    columns, inverse, x = np.diag(per).astype(np.float64), np.diag(1.0 / per), need / per
    for _ in range(rounds):
        value, column = _price(sizes, inverse.sum(0), room)
        if value <= 1 + 1e-7:
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
    plan, left = [], need.astype(np.int64)
    for p in np.argsort(-x, kind="stable"):
        own = columns[:, p].astype(np.int64)
        used = own > 0
        times = min(int(x[p] + 1e-6), int((left[used] // own[used]).min()))
        if times > 0:
            plan.append((times, own))
            left -= times * own
    return plan


class Grouped:
    """Groups of large pieces by rank (0 is the longest), the slots of their configurations, and what is left over."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int) -> None:
        n = np.zeros(capacity + 1, np.int64)
        for length, count in histogram.items():
            n[length] = count
        self.n, large = n, n.copy()
        large[: capacity // LARGE + 1] = 0
        large[capacity] = 0
        #: Rank of the first piece of each length among large ones.
        self.base = large.sum() - np.cumsum(large)
        total = int(large.sum())
        each = max(1, -(-total // groups))
        firsts = np.arange(0, total, each)
        falling = np.flatnonzero(large)[::-1]
        sizes = falling[np.searchsorted(np.cumsum(large[falling]), firsts, "right")]
        self.sizes, start = np.unique(-sizes, return_index=True)
        self.sizes = -self.sizes  # falling, groups of one size joined
        self.first = firsts[start]
        self.count = np.diff(np.append(self.first, total))
        self.plan = configurations(self.sizes, self.count, capacity)
        self.used = sum((t * c for t, c in self.plan), np.zeros(len(self.sizes), np.int64))
        self.sequences = sum(t for t, _ in self.plan)
        self.left_before = np.append(0, np.cumsum(self.count - self.used))
        rows, used, number = [[] for _ in self.sizes], np.zeros(len(self.sizes), np.int64), 0
        for times, pieces in self.plan:
            slot = 0
            for g in np.flatnonzero(pieces):
                rows[g].append((used[g], pieces[g], number, slot))
                used[g] += times * pieces[g]
                slot += pieces[g]
            number += times
        self.slots = [np.array(r, np.int64).reshape(-1, 4) for r in rows]
        #: Pieces of each length for best fit: small ones, and large ones left over.
        self.rest = n.copy()
        self.rest[capacity] = 0
        for length in np.flatnonzero(large):
            self.rest[length] = self.left(self.base[length] + large[length]) - self.left(self.base[length])
        self.large = large > 0
        self.capacity = capacity

    def left(self, rank: np.ndarray | int) -> np.ndarray | int:
        """How many pieces of smaller rank no configuration took."""
        if not len(self.first):
            return np.zeros_like(rank)
        g = np.searchsorted(self.first, rank, "right") - 1
        return self.left_before[g] + np.clip(rank - self.first[g] - self.used[g], 0, self.count[g] - self.used[g])

    def deal(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence or -1, slot, number among its length's pieces for best fit) by length and rank in the length."""
        sequence, slot, item = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int32), rank.copy()
        whole = length == self.capacity
        sequence[whole] = -2 - rank[whole]
        big = np.flatnonzero(self.large[length])
        at = self.base[length[big]] + rank[big]
        g = np.searchsorted(self.first, at, "right") - 1
        item[big] = self.left(at) - self.left(self.base[length[big]])
        for k in np.unique(g):
            own = np.flatnonzero((g == k) & (at - self.first[g] < self.used[g]))
            t = self.slots[k]
            if len(own):
                place = at[own] - self.first[k]
                row = t[np.searchsorted(t[:, 0], place, "right") - 1]
                nth = place - row[:, 0]
                sequence[big[own]] = row[:, 2] + nth // row[:, 1]
                slot[big[own]] = row[:, 3] + nth % row[:, 1]
        return sequence, slot, item


def best_fit(rest: np.ndarray, rooms: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """Best fit, longest first, on counts: rows (first item, items a sequence, room at the start, first rank, room then) per length.

    The second result is the number of new sequences; these have ``capacity`` as room at the start.
    """
    state: dict[int, deque] = defaultdict(deque)
    for room, count in rooms.items():
        if count:
            state[room].append((room, 0, count))
    order = sorted(state)
    new, plan = 0, {}

    def put(room: int, part: tuple[int, int, int]) -> None:
        if room:
            if not state[room]:
                insort(order, room)
            state[room].append(part)

    for length in range(capacity - 1, 0, -1):
        left, first, rows = int(rest[length]), 0, []
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                opened = -(-left // (capacity // length))
                put(capacity, (capacity, new, opened))
                new += opened
                continue
            room = order[i]
            start, rank, count = state[room].popleft()
            per = min(room // length, left)
            take = min(count, left // per)
            rows.append((first, per, start, rank, room))
            first, left = first + take * per, left - take * per
            if take < count:
                state[room].appendleft((start, rank + take, count - take))
            if not state[room]:
                order.pop(i)
            put(room - per * length, (start, rank, take))
        if rows:
            plan[length] = np.array(rows, np.int64)
    return plan, new


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, groups: int = GROUPS) -> DataFrame:
    """A row per piece of every row of (doc_id, text): where its ids lie in which sequence."""
    pieces = written(only(docs, "doc_id", "text").mapInArrow(_cut(vocabulary, capacity, end_id), PIECE))
    ranked, histogram = _ranked(pieces, "length")
    grouped = Grouped(histogram, capacity, groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = grouped.deal(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in FIELDS), *map(pa.array, found)], _names(DEALT))

    dealt = written(ranked.select(*FIELDS, "rank").mapInArrow(deal, DEALT))
    whole = dealt.where("sequence_id < -1").select(*FIELDS, "sequence_id", F.lit(0).cast("long").alias("offset"))
    own = Window.partitionBy("sequence_id")
    placed = dealt.where("sequence_id >= 0").select(
        *FIELDS, "sequence_id", "slot", (F.sum("length").over(own.orderBy("slot")) - F.col("length")).alias("offset"), (F.lit(capacity) - F.sum("length").over(own)).cast("int").alias("room")
    )
    placed = written(placed)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, counts = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            room = batch.column("room").to_numpy()
            order = np.argsort(room, kind="stable")
            place = np.zeros(len(room), np.int64)
            first = np.searchsorted(room[order], room[order], "left")
            place[order] = np.arange(len(room)) - first + counts[room[order]]
            counts += np.bincount(room, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("room"), pa.array(np.full(len(room), task, np.int32)), pa.array(place)], ["sequence_id", "room", "task", "place"])

    bins = written(placed.where("slot = 0").select("sequence_id", "room").mapInArrow(numbered, "sequence_id long, room int, task int, place long"))
    bins, rooms = _ranked(bins, "room")
    plan, _ = best_fit(grouped.rest, rooms, capacity)
    first_new = grouped.sequences

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, item = batch.column("length").to_numpy(), batch.column("item").to_numpy()
            room, rank, offset = (np.zeros(len(length), np.int64) for _ in range(3))
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                row = plan[int(k)][np.searchsorted(plan[int(k)][:, 0], item[at], "right") - 1]
                nth = item[at] - row[:, 0]
                room[at], rank[at] = row[:, 2], row[:, 3] + nth // row[:, 1]
                offset[at] = capacity - row[:, 4] + nth % row[:, 1] * k
            columns = [*(batch.column(x) for x in FIELDS), pa.array(room.astype(np.int32)), pa.array(rank), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*FIELDS, "room", "rank", "offset"])

    kinds = "doc_id long, piece int, start long, length int, ids_crc32 long, room int, rank long, offset long"
    fitted = dealt.where("sequence_id = -1").select(*FIELDS, "item").mapInArrow(fit, kinds)
    opened = fitted.where(F.col("room") == capacity).select(*FIELDS, (F.col("rank") + first_new).alias("sequence_id"), "offset")
    into = fitted.where(F.col("room") < capacity).join(bins, ["room", "rank"]).select(*FIELDS, "sequence_id", "offset")
    found = whole.unionByName(placed.select(*FIELDS, "sequence_id", "offset")).unionByName(opened).unionByName(into)
    return found.withColumn("length", F.col("length").cast("long"))
