"""Ranked lexical search: document-at-a-time merges over compressed postings of shards.

Tasks cut the documents they read into shards of about ``SHARD`` bytes of text. A shard's
index has a row per term (postings in doc_id order: gaps of places and term counts as
variable-length bytes) and a row with its documents (ids and lengths). Document
frequencies, N and L are sums over the index. The terms of a block of items meet the
postings by equality of the term; per shard and block, a heap merges the postings of an
item's terms document by document, and a bounded heap keeps the best, keyed by score and
then doc_id. Terms whose largest gains together stay below the heap's least score leave
the merge and are looked up only for documents that others found, which loses nothing.
The best of each task meet in one ranking per item.

Defined cases: a null or empty text has no term and is not counted in N; each row is a
document, so repeated rows are ranked each; documents of a null doc_id come last among
equal scores; rows of one item_id (null, too) are one item whose terms add up; an item
without known terms has no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: Bytes of text of a shard and items of a block: they bound a task's memory, not the result.
SHARD, BLOCK = 16 << 20, 256
#: Rows of the table of items' terms up to which it is broadcast; beyond, it is joined by term and ``SALTS`` parts of the shards.
BROADCAST, SALTS = 50_000, 32
_LETTERS = set((string.ascii_letters + string.digits).encode())
_TABLE = bytes(ord(chr(c).lower()) if c in _LETTERS else c if c >= 0x80 else 0x20 for c in range(256))
INDEX = "shard long, term string, df long, postings binary, doc_ids array<long>, n_docs long, n_terms long"
_LAST = 1 << 63  # a null doc_id comes after all others


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, the lowest first, and the end of each."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= (1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts, left = ends - size, values.astype(np.int64)
    rows = np.arange(len(values))
    for place in range(9):
        if not len(rows):
            break
        more = size[rows] > place + 1
        out[starts[rows] + place] = (left[rows] & 0x7F) | (more.astype(np.int64) << 7)
        left[rows] >>= 7
        rows = rows[more]
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out, size = np.zeros(len(ends), np.int64), ends - starts
    for place in range(int(size.max()) + 1 if len(size) else 0):
        has = np.flatnonzero(size >= place)
        out[has] |= (raw[starts[has] + place].astype(np.int64) & 0x7F) << (7 * place)
    return out


def _shard(number: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    numbers = _Numbers()
    rows = [np.fromiter(map(numbers.__getitem__, terms(text)), np.int64) for _, text in docs]
    docs = [d for d, r in zip(docs, rows, strict=True) if len(r)]
    rows = [r for r in rows if len(r)]
    lengths = np.array([len(r) for r in rows], np.int64)
    key = np.concatenate(rows) * len(rows) + np.repeat(np.arange(len(rows)), lengths) if rows else np.zeros(0, np.int64)
    key, tf = np.unique(key, return_counts=True)
    term, place = np.divmod(key, max(1, len(rows)))
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    gap = np.diff(place, prepend=0)
    gap[begins] = place[begins]
    both = np.empty(2 * len(key), np.int64)
    both[0::2], both[1::2] = gap, tf
    data, ends = packed(both)
    upto = np.append(begins[1:], len(key)) if len(key) else begins
    offsets = np.append(0, ends[2 * upto - 1]).astype(np.int32)
    df = np.diff(np.append(begins, len(key)))
    n = len(df)
    docs_n, _ = packed(lengths)
    postings = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    names = pa.array(list(numbers), pa.binary()).cast(pa.string())
    own = pa.array([None], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number, np.int64)),
            pa.concat_arrays([own, names]),
            pa.concat_arrays([pa.array([None], pa.int64()), pa.array(df)]),
            pa.concat_arrays([pa.array([docs_n.tobytes()], pa.binary()), postings]),
            pa.array([[d for d, _ in docs], *[None] * n], pa.list_(pa.int64())),
            pa.array([len(rows), *[None] * n], pa.int64()),
            pa.array([int(lengths.sum()), *[None] * n], pa.int64()),
        ],
        [x.split()[0] for x in INDEX.split(", ")],
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, made, held, size = TaskContext.get().partitionId() << 33, 0, [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                held.append((doc, text))
                size += len(text)
            if size >= SHARD:
                yield _shard(first + made, held)
                made, held, size = made + 1, [], 0
    if held:
        yield _shard(first + made, held)


def index(docs: DataFrame) -> DataFrame:
    """The index of all rows (doc_id, text), written: rows of terms, and one of documents per shard (null term)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(_index, INDEX))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(x) for x in batch.column("text").to_pylist()]
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        names = pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(item)), names], ["item_id", "term"])


class Best:
    """The ``most`` largest (score, -doc_id) of an item so far."""

    def __init__(self, most: int) -> None:
        self.most, self.heap = most, []

    @property
    def least(self) -> int:
        """No document below this score can enter."""
        return self.heap[0][0] if len(self.heap) == self.most else 1

    def offer(self, score: int, doc: int) -> None:
        if len(self.heap) < self.most:
            if score > 0:
                heapq.heappush(self.heap, (score, -doc))
        elif (score, -doc) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc))


def merge(lists: list[tuple[int, int, list[int], list[int]]], docs: list[int], best: Best) -> None:
    """Offers every document that can enter: lists of (largest gain, times, places, gains), ascending by largest gain.

    The heap holds the next place of each list that can lift a document into ``best`` by
    itself or together with the smaller ones; ``below[i]`` is what lists 0..i-1 can add.
    """
    below = [0]
    for upper, times, _, _ in lists:
        below.append(below[-1] + upper * times)
    split = 0
    while split < len(lists) and below[split + 1] < best.least:
        split += 1
    at = [0] * len(lists)
    heap = [(lists[i][2][0], i) for i in range(split, len(lists))]
    heapq.heapify(heap)
    while heap:
        place, score = heap[0][0], 0
        while heap and heap[0][0] == place:
            i = heap[0][1]
            _, times, places, gains = lists[i]
            score += times * gains[at[i]]
            at[i] += 1
            if at[i] < len(places):
                heapq.heapreplace(heap, (places[at[i]], i))
            else:
                heapq.heappop(heap)
        for i in range(split - 1, -1, -1):
            if score + below[i + 1] < best.least:
                break
            _, times, places, gains = lists[i]
            at[i] = bisect_left(places, place, at[i])
            if at[i] < len(places) and places[at[i]] == place:
                score += times * gains[at[i]]
        else:
            best.offer(score, docs[place])
        before = split
        while split < len(lists) and below[split + 1] < best.least:
            split += 1
        if split != before:
            heap = [x for x in heap if x[1] >= split]
            heapq.heapify(heap)


def _search(n: int, total: int, most: int, id_type: pa.DataType):
    """Rows in the order of block and shard, each shard's documents before its terms."""

    def answer(rows: list[dict], found: dict) -> None:
        head, items = rows[0], {}
        docs = [_LAST if d is None else d for d in head["doc_ids"]]
        m = np.array([25 + 75 * x * n // total for x in unpacked(head["postings"]).tolist()], np.int64)
        for r in rows[1:]:
            both = unpacked(r["postings"])
            place, tf = np.cumsum(both[0::2]), both[1::2]
            gain = r["w"] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
            own = (int(gain.max()), place.tolist(), gain.tolist())
            for x in r["items"]:
                items.setdefault(x["item_id"], []).append((own[0], x["times"], own[1], own[2]))
        for item, lists in items.items():
            merge(sorted(lists, key=lambda x: x[0] * x[1]), docs, found.setdefault(item, Best(most)))

    def out(found: dict) -> pa.RecordBatch:
        rows = [(item, -d, s) for item, b in found.items() for s, d in b.heap]
        item, doc, score = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(item, id_type), pa.array([None if d == _LAST else d for d in doc], pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], {}
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["block"], r["shard"])
                if now != key:
                    if rows:
                        answer(rows, found)
                    if key and key[0] != now[0]:
                        yield out(found)
                        found = {}
                    key, rows = now, []
                rows.append(r)
        if rows:
            answer(rows, found)
        yield out(found)

    return run


def search(indexed: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of ``index(docs)`` for every row group of (item_id, text)."""
    id_type = items.schema["item_id"].dataType
    own = items.select("item_id", F.col("text").cast("binary").alias("text"))
    asked = own.mapInArrow(_counted, f"item_id {id_type.simpleString()}, term string").groupBy("item_id", "term").agg(F.count("*").cast("int").alias("times"))
    asked = written(asked)
    n_items, n_rows = asked.agg(F.count_distinct(F.struct("item_id")), F.count("*")).first()
    blocks = max(1, -(-n_items // BLOCK))
    small = n_rows <= BROADCAST
    head, body = indexed.where("term is null"), indexed.where("term is not null")
    n, total = head.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def hinted(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    names = asked.select("term").distinct()
    df = body.select("term", "df").join(hinted(names), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(blocks)).cast("int")
    lists = asked.withColumn("block", block).groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "times")).alias("items"))
    lists = written(lists.join(df.withColumn("w", weight), "term").select("block", "term", "w", "items"))
    if small:
        hits = body.join(F.broadcast(lists), "term")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = body.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    empty = F.array().cast(lists.schema["items"].dataType)
    tops = head.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("later"), "postings", "doc_ids", F.lit(0).cast("long").alias("w"), empty.alias("items"))
    rows = tops.unionByName(hits.select("shard", "block", F.lit(True).alias("later"), "postings", "doc_ids", "w", "items"))
    from pyspark.sql.pandas.types import to_arrow_type

    found = rows.repartition("block", "shard").sortWithinPartitions("block", "shard", "later").mapInArrow(_search(n, total, most, to_arrow_type(id_type)), f"item_id {id_type.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
