"""Removal of long repeats by run-length indexes over the passages that may repeat.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a
smaller id. Every such string belongs to the least hash of its ``K``-byte substrings (its
anchor), so equal strings have equal anchors and are dealt together; consecutive strings
of one anchor travel as one context. Three steps, each exact:

1. Tasks hash contexts; of equal ones within a task all but the least document's are
   settled at once, the rest is dealt by anchor, and equal contexts are settled there.
2. Contexts whose anchor has other contexts, too, fetch their bytes and are dealt by a
   ``CORE``-byte extension of the anchor that any string of theirs contains.
3. There a run-compressed Burrows-Wheeler transform is built over each group's contexts,
   with the first document of every interval of ``LENGTH``-byte matches sampled; every
   context is streamed through it by run-wise LF steps, and long matches are marked.
   A group of more than ``GROUP`` contexts is too much for one task: its strings are
   reduced to hashes, their least documents found by a partial aggregate, and joined back.

Defined cases: a null or empty text, or one below ``LENGTH`` bytes, loses nothing; a row
without doc_id neither loses nor repeats anything; repeated rows are each judged against
smaller ids only, as are rows that share an id but not the text. Other columns are
ignored; an empty table gives no rows. Equality of contexts rests on 64-bit hashes; rows
that share an id are told apart by 15 bits of their texts' checksums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U, buffers, chunks, dropped, mix, only, powers, written

LENGTH, K = 50, 16
CORE = 17  # bytes beside the anchor on one of its sides: half of what a string has besides
#: Bytes of contexts that an index is built over at once, beyond which the next group opens another.
CHUNK = 1 << 19
#: Contexts of one extension that one task indexes at most.
GROUP = 20_000


def pack(tag: np.ndarray, lo: np.ndarray, left: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Where a context lies: 19 bits of the text's checksum, its first byte, the anchor's place in it, its strings."""
    return (tag.astype(np.int64) << 44) | (lo.astype(np.int64) << 12) | (left.astype(np.int64) << 6) | span.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, ...]:
    return at >> 44, (at >> 12) & 0xFFFFFFFF, (at >> 6) & 63, at & 63


def tag_of(text: bytes) -> int:
    return zlib.crc32(text) & 0x7FFFF


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, context hash, first byte, anchor's place, strings) of every context of some texts."""
    n, width = len(data), LENGTH - K + 1
    begins = np.arange(n - LENGTH + 1)
    if not len(begins):
        return (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)
    power, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:n], out=prefix[1:])
    h = mix((prefix[K:] - prefix[:-K]) * inverse[: n - K + 1])
    bits = U(max(20, int(n).bit_length()))
    least = (h >> bits << bits) | np.arange(len(h), dtype=U)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(begins)], least[width - have : width - have + len(begins)])
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    text = np.searchsorted(offsets, begins, "right") - 1
    fits = begins + LENGTH <= offsets[text + 1]
    begins, anchor, text = begins[fits], anchor[fits], text[fits]
    new = np.ones(len(begins), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    span = np.diff(np.append(at, len(begins)))
    lo, anchor, text = begins[at], anchor[at], text[at]
    ends = lo + span - 1 + LENGTH
    context = mix((prefix[ends] - prefix[lo]) * inverse[lo] + span.astype(U) * U(0xD6E8FEB86659FD93))
    return text, h[anchor], context, lo - offsets[text], anchor - lo, span


ROW = ["anchor", "context", "doc", "at"]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of all texts; of equal ones only the least document's keep a sign, the rest (~at) are settled."""
    for batch in batches:
        parts, ids = [], batch.column("doc_id").to_numpy()
        for first, data, offsets in chunks(batch.column("text")):
            text, h, context, lo, left, span = anchors(data, offsets)
            tags = np.array([tag_of(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            parts.append((h.astype(np.int64), context.astype(np.int64), ids[first + text].astype(np.int64), pack(tags[text], lo, left, span)))
        if not parts:
            continue
        h, context, doc, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((doc, context))
        h, context, doc, at = h[order], context[order], doc[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = context[1:] != context[:-1]
        first_doc = doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else doc
        settled = doc > first_doc
        at, h = np.where(settled, ~at, at), np.where(settled, mix(doc).astype(np.int64), h)  # what is settled is dealt evenly, by document
        for i in range(0, len(h), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 500_000]) for x in (h, context, doc, at)], ROW)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts dealt by anchor: those settled (open: false), and those whose bytes must be compared."""
    parts = [[b.column(c).to_numpy() for c in ROW] for b in batches]
    if not parts:
        return
    anchor, context, doc, at = (np.concatenate(p) for p in zip(*parts, strict=True))
    del parts
    done = at < 0
    gone_doc, gone_at = [doc[done]], [~at[done]]
    anchor, context, doc, at = anchor[~done], context[~done], doc[~done], at[~done]
    order = np.lexsort((doc, context, anchor))
    anchor, context, doc, at = anchor[order], context[order], doc[order], at[order]
    new_anchor = np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new = new_anchor.copy()
    new[1:] |= context[1:] != context[:-1]
    spot = np.arange(len(anchor))
    later = doc > doc[np.maximum.accumulate(np.where(new, spot, 0))] if len(doc) else new
    gone_doc.append(doc[later])
    gone_at.append(at[later])
    anchor, doc, at = anchor[~later], doc[~later], at[~later]
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    starts = np.flatnonzero(new)
    if len(starts):
        several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        still = np.repeat(several, np.diff(np.append(starts, len(anchor))))
        doc, at = doc[still], at[still]
    out = [(np.concatenate(gone_doc), np.concatenate(gone_at), False), (doc, at, True)]
    for d, a, is_open in out:
        for i in range(0, len(d), 500_000):
            n = len(d[i : i + 500_000])
            yield pa.RecordBatch.from_arrays([pa.array(d[i : i + n]), pa.array(a[i : i + n]), pa.array(np.full(n, is_open))], ["doc_id", "at", "open"])


def key_of(core: bytes, side: int) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8, key=bytes([side])).digest(), "little", signed=True)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open contexts, once for strings that reach CORE bytes left of the anchor, once for the others."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            own = tag_of(raw)
            for tag, lo, left, span in zip(*(x.tolist() for x in unpack(np.array(places, np.int64))), strict=True):
                if tag != own:
                    continue
                reach = min(span, left - CORE + 1)
                core = lo + left
                if reach > 0:
                    rows.append((key_of(raw[core - CORE : core + K], 0), doc, lo | tag << 44, raw[lo : lo + reach - 1 + LENGTH]))
                if reach < span:
                    r = max(0, reach)
                    rows.append((key_of(raw[core : core + K + CORE], 1), doc, (lo + r) | tag << 44, raw[lo + r : lo + span - 1 + LENGTH]))
            if len(rows) > 50_000:
                yield _bytes_batch(rows)
                rows = []
        yield _bytes_batch(rows)


def _bytes_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "doc_id", "from", "bytes"])


class RunIndex:
    """A run-compressed transform of some strings, each ended by its own mark.

    Kept are the runs (first row, symbol's rank base) and, sampled for every interval of
    rows whose suffixes share ``length`` bytes, its first row, end and least owner.
    """

    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> None:
        sizes = np.array([len(s) for s in strings], np.int64)
        self.sizes, self.length = sizes, length
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        n = int((sizes + 1).sum())
        x = np.zeros(n, np.int64)
        ends = starts + sizes
        body = np.ones(n, bool)
        body[ends] = False
        x[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        end = np.repeat(ends, sizes + 1)
        place = np.arange(n)
        rank = np.zeros(n, np.int64)
        for j in range(7):
            at = np.minimum(place + j, n - 1)
            rank = rank * 257 + np.where(place + j <= end, x[at], 0)
        rank = np.unique(rank, return_inverse=True)[1]
        depth, at_length = 7, None
        while depth <= int(sizes.max(initial=0)):
            if at_length is None and 2 * depth >= length:
                at_length = (rank.copy(), length - depth)
            more = np.where(place + depth <= end, rank[np.minimum(place + depth, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 1) + more, return_inverse=True)[1]
            depth *= 2
        order = np.argsort(rank, kind="stable")
        row = np.empty(n, np.int64)
        row[order] = place
        self.last = row[ends]
        before = np.where(np.isin(order, starts), 0, x[np.maximum(order - 1, 0)])
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        self.runs = np.flatnonzero(head)
        symbol, lengths = before[self.runs], np.diff(np.append(self.runs, n))
        by = np.argsort(symbol, kind="stable")
        self.base = np.empty(len(self.runs), np.int64)
        self.base[by] = np.concatenate([[0], np.cumsum(lengths[by])])[:-1]
        if at_length is None:
            self.first = self.until = self.owner = np.zeros(0, np.int64)
            return
        deep, shift = at_length
        whole = end - place >= length
        pair = np.where(whole, deep * (n + 1) + deep[np.minimum(place + shift, n - 1)], -1 - place)[order]
        new = np.ones(n, bool)
        new[1:] = pair[1:] != pair[:-1]
        first = np.flatnonzero(new)
        of = np.repeat(owners, sizes + 1)[order]
        low, high = np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)
        kept = low < high
        self.first, self.owner = first[kept], low[kept]
        self.until = np.append(first, n)[1:][kept]

    def matched(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, place) of every ``length`` bytes that also start in a string of a smaller owner."""
        which, rows = np.arange(len(self.sizes)), self.last.copy()
        found_s, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            live = self.sizes[which] >= step
            which, rows = which[live], rows[live]
            run = np.searchsorted(self.runs, rows, "right") - 1
            rows = self.base[run] + rows - self.runs[run]
            if step >= self.length and len(self.first):
                i = np.maximum(np.searchsorted(self.first, rows, "right") - 1, 0)
                hit = (rows >= self.first[i]) & (rows < self.until[i]) & (self.owner[i] < owners[which])
                found_s.append(which[hit])
                found_p.append(self.sizes[which[hit]] - step)
        return np.concatenate(found_s), np.concatenate(found_p)


def _places(owners: np.ndarray, at: np.ndarray, s: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """(doc_id, at) of runs of neighbouring strings p of contexts s."""
    order = np.lexsort((p, s))
    s, p = s[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    span = np.diff(np.append(first, len(s)))
    own = at[s[first]]
    lo = (own & 0xFFFFFFFF) + p[first]
    return pa.RecordBatch.from_arrays([pa.array(owners[s[first]]), pa.array(pack(own >> 44, lo, np.zeros(len(lo), np.int64), span))], ["doc_id", "at"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, doc_id, at) of every string of some contexts."""
    for batch in batches:
        data, offsets = buffers(batch.column("bytes").cast(pa.large_binary()))
        n = len(data)
        power, inverse = powers(n + 1)
        prefix = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power[:n], out=prefix[1:])
        count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        of = np.repeat(np.arange(len(count)), count)
        p = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begins = offsets[of] + p
        h = mix((prefix[begins + LENGTH] - prefix[begins]) * inverse[begins])
        own = batch.column("from").to_numpy()[of]
        at = pack(own >> 44, (own & 0xFFFFFFFF) + p, np.zeros(len(p), np.int64), np.ones(len(p), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), batch.column("doc_id").take(pa.array(of)), pa.array(at)], ["hash", "doc_id", "at"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of contexts, sorted by key, that also start in a smaller document of their group."""

    def marked(docs: list[int], places: list[int], strings: list[bytes]) -> pa.RecordBatch:
        owners, at = np.array(docs, np.int64), np.array(places, np.int64)
        s, p = RunIndex(strings, owners).matched(owners) if strings else (np.zeros(0, np.int64),) * 2
        return _places(owners, at, s, p)

    chunk: tuple[list, list, list] = ([], [], [])
    group: tuple[list, list, list] = ([], [], [])
    held, last = 0, None

    def join() -> None:
        nonlocal held, group
        if len(set(group[0])) > 1:
            for a, b in zip(chunk, group, strict=True):
                a.extend(b)
            held += sum(map(len, group[2]))
        group = ([], [], [])

    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "from", "bytes")), strict=True):
            if key != last:
                join()
                last = key
                if held > CHUNK:
                    yield marked(*chunk)
                    chunk, held = ([], [], []), 0
            for a, b in zip(group, row, strict=True):
                a.append(b)
    join()
    yield marked(*chunk)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            columns: list[list] = [[] for _ in range(5)]
            for i, places in enumerate(batch.column("places").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(raw) + 1, np.int32)
                if places:
                    tag, lo, _, span = unpack(np.array(places, np.int64))
                    mine = tag == tag_of(raw.tobytes())
                    np.add.at(gone, lo[mine], 1)
                    np.add.at(gone, lo[mine] + span[mine] - 1 + LENGTH, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = raw[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for c, v in zip(columns, (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            used = 5 if keep_text else 4
            also = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns[:used], types, strict=False)), *also], ["doc_id", *names[:used], *carry])

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept], *carry) of every row of (doc_id, text, *carry).

    ``kept`` is the remaining bytes as text; bytes of characters that a removal has cut
    in two are left out of it (not of the digest).
    """
    every = only(docs, "doc_id", "text", *carry).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = every.select("doc_id", "text")
    rows = docs.where("doc_id is not null and octet_length(text) >= 50").mapInArrow(_deal, "anchor long, context long, doc long, at long")
    settled = written(rows.repartition("anchor").mapInArrow(_settle, "doc_id long, at long, open boolean"))
    asked = settled.where("open").groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    found = written(docs.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(_fetch, "key long, doc_id long, from long, bytes binary"))
    large = found.groupBy("key").count().where(F.col("count") > GROUP).select("key")
    small = found.join(large, "key", "left_anti").select("key", "doc_id", "from", "bytes")
    marked = written(small.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_mark, "doc_id long, at long"))
    strings = found.join(large, "key", "left_semi").select("doc_id", "from", "bytes").mapInArrow(_strings, "hash long, doc_id long, at long")
    least = strings.groupBy("hash").agg(F.min("doc_id").alias("least"))
    more = written(strings.join(least, "hash").where("doc_id > least").select("doc_id", "at"))
    dropped(found)
    gone = settled.where("not open").select("doc_id", "at").unionByName(marked).unionByName(more).groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    schema = RESULT + (", kept string" if keep_text else "") + "".join(f", {c} {every.schema[c].dataType.simpleString()}" for c in carry)
    return every.join(gone, "doc_id", "left").select("doc_id", "text", "places", *carry).mapInArrow(_cut(keep_text, carry), schema)
