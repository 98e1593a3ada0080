"""N-gram Jaccard self-join by parity sketches.

Every distinct shingle flips one bit of a sketch that is cut into pieces of 65,536 bits
(mostly zero, so that a piece is kept as a hash of its set bits), and the
Hamming distance of two sketches is at most the symmetric difference of the sets. Sets
of a Jaccard similarity of t or more, both of at most ``hi`` shingles, differ in at most
D = 2 hi (1 - t) / (1 + t) shingles and hence in at most D pieces: with more pieces than
that, some piece is equal (pigeonhole). Documents are joined on equal pieces within
layouts by size band, and every candidate is verified on its exact sets.

Exact at any size of bucket: every class of equal sets is first compared with two of the
first members of its buckets (the least, and the one it shares most with), which settles
copies in a number of pairs linear in the table. In buckets that hold several components
then, the members outside of the bucket's largest component are compared with all others
(of two members in different components, one at least is outside): first with the nearest,
then with all that share as many pieces of a layout as a linked pair must (the smaller of
the two sets' needs) or, in large buckets, whose sketches are near enough.

Defined cases: a null, empty or blank text has no shingle and links with nothing; a text
of fewer than ``k`` words is one shingle; equal sets are one class; sets are told apart by
64-bit hashes. A row without doc_id links with nothing and has no component_id; rows that
share a doc_id but not the text each have the component of their own text, and repeated
rows are repeated. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U, chunks, components, dropped, mix, only, words, written

MULTIPLIERS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)]
#: Texts whose class a task remembers, so as to emit the pieces of a copy once: bounds its memory, not the result.
REMEMBERED = 500_000
#: Bits of a sketch at least; a larger set has as many as shingles, or up to twice that, as a fuller sketch tells nothing apart.
SKETCH = 2048
#: Buckets of more members than this are compared by sketches in blocks, smaller ones by a join.
SMALL = 32
BLOCK = 2048
#: Ids (8 bytes each) that may be broadcast, once counted; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Pairs that are judged at once: this many, or one to SHARE rows of the table.
AT_ONCE, SHARE = 5_000, 4
#: Rounds in which a class meets only the nearest of other components, before all that is left is compared.
ROUNDS = 2


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of every text of an Arrow column, in order."""
    for first, data, offsets in chunks(column):
        h, starts = words(data, offsets)
        n = len(h) - k + 1
        full = np.zeros(max(n, 0), U)
        for j in range(k if n > 0 else 0):
            full += h[j : j + n] * MULTIPLIERS[j % 6] + U(j + 1)
            full ^= full >> U(29)
        full = mix(full)
        for i in range(len(offsets) - 1):
            a, b = starts[i], starts[i + 1]
            if b - a >= k:
                yield first + i, np.unique(full[a : b - k + 1])
            elif b > a:
                whole = U(b - a)
                for x in h[a:b]:
                    whole = mix(np.array([whole * MULTIPLIERS[1] + x]))[0]
                yield first + i, np.array([whole], U)
            else:
                yield first + i, full[:0]


def class_of(s: np.ndarray) -> int:
    """One number for a set of shingles (0: the empty set)."""
    return int((mix(s ^ MULTIPLIERS[2]).sum(dtype=U) ^ mix(np.array([len(s)], U))[0]).astype(np.int64)) if len(s) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int(np.isin(a, b, assume_unique=True).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def layout(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, pieces, most that may differ) of the layouts in which a set of this size takes part."""
    lo, band = 1, 0
    while True:
        hi = max(lo, lo * 10000 // (percent * percent))
        if size <= hi:
            break
        lo, band = hi + 1, band + 1
    out = [(band, hi)]
    if 100 * size >= percent * (hi + 1):
        out.append((band + 1, max(hi + 1, (hi + 1) * 10000 // (percent * percent))))
    return [(b, d + 1 + -(-(d + 1) // 12), d) for b, h in out if (d := 2 * h * (100 - percent) // (100 + percent))]


def banded_keys(s: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Per layout: its band, the join keys of a set's sketch pieces, and what is left of the equal pieces.

    A piece with one bit or none says little and would join strangers. As a partner has
    at least pieces - D equal pieces, those pieces are left out whenever fewer than that
    many of the set's pieces are such: an equal piece that says more must remain. The
    partner may leave out more or fewer, so of two linked sets only the SMALLER number
    (the last of the three) is sure to be shared in a common layout.
    """
    for band, pieces, most in layout(len(s), percent):
        at = ((s >> U(32)) * U(pieces) >> U(32) << U(16)) | (s & U(0xFFFF))
        at, times = np.unique(at, return_counts=True)
        at = at[times & 1 == 1]
        owner = (at >> U(16)).astype(np.int64)
        bits = np.bincount(owner, minlength=pieces)
        value = np.zeros(pieces, U)
        full = np.flatnonzero(bits)
        value[full] = np.add.reduceat(mix(at), np.concatenate([[0], np.cumsum(bits[full])[:-1]])) if len(full) else 0
        kept = np.ones(pieces, bool)
        for few in (0, 1):
            if (bits <= few).sum() < pieces - most:
                kept = bits > few
        names = mix(np.arange(pieces, dtype=U) + U(band << 32))
        yield band, mix(value[kept] ^ names[kept]), max(1, pieces - most - int(pieces - kept.sum()))


def piece_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``banded_keys`` over all layouts, and with each key its layout's number."""
    keys, needs = [], []
    for _, key, need in banded_keys(s, percent):
        keys.append(key)
        needs.append(np.full(len(key), need, np.int32))
    return (np.concatenate(keys), np.concatenate(needs)) if keys else (np.zeros(0, U), np.zeros(0, np.int32))


def sketch(s: np.ndarray) -> bytes:
    """Bits in which every shingle flips one, a power of two: the Hamming distance of two is at most the symmetric difference."""
    width = max(SKETCH, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of one width (a row each, in 64-bit words) in a smaller one: what the sets have in so many words of bits."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), 1)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), class_of(s), sketch(s)) for _, s in shingle_sets(batch.column("text"), k)]
            size, cls, bits = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "class", "sketch"])

    return run


def _keys(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, needs, bands, classes, held = [], [], [], [], 0
            for _, s in shingle_sets(batch.column("text"), k):
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                for band, key, need in banded_keys(s, percent):
                    keys.append(key.astype(np.int64))
                    needs.append(np.full(len(key), need, np.int32))
                    bands.append(np.full(len(key), band, np.int32))
                    classes.append(np.full(len(key), c, np.int64))
                    held += len(key)
                if held > 1_000_000:
                    yield _batch(keys, classes, needs, bands)
                    keys, needs, bands, classes, held = [], [], [], [], 0
            if held:
                yield _batch(keys, classes, needs, bands)

    def _batch(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "class", "need", "band"])

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cache: dict[int, tuple[int, np.ndarray]] = {}
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            second = shingle_sets(batch.column("text_v"), k)
            texts = batch.column("text_u")
            ok = []
            for (i, b), x, y in zip(second, u, v, strict=True):
                if x not in cache:
                    if len(cache) > 256:
                        cache.clear()
                    a = next(shingle_sets(texts.slice(i, 1), k))[1]
                    cache[x] = class_of(a), a
                ok.append(cache[x][0] == x and class_of(b) == y and linked(cache[x][1], b, percent))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(c, ok, strict=True) if y], pa.int64()) for c in (u, v)], ["u", "v"])

    return run


def _compared(percent: int, nearest: bool):
    """For a block of asking classes and one of members of a large bucket: per class that asks, the
    classes of other components that sketches do not tell apart, or the nearest of them.

    Two sketches are compared in the width of the smaller. Where asking classes are among the
    members, too (the bucket is one block), a pair of two that ask is found once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        size, cls, comp, asks, stays = (group[c].to_numpy() for c in ("n_shingles", "class", "component", "asks", "stays"))
        words = group["sketch"].map(len).to_numpy() // 8
        found: dict[int, list[tuple[int, int]]] = {}
        for width in np.unique(words):
            wide = [(w, np.flatnonzero(words == w)) for w in np.unique(words) if w >= width]
            rows = np.concatenate([r for _, r in wide])
            bits = np.concatenate([folded(np.frombuffer(b"".join(group["sketch"].iloc[r]), U).reshape(len(r), -1), width) for w, r in wide])
            order = np.argsort(size[rows], kind="stable")  # those of a like size are a slice
            rows, bits = rows[order], bits[order]
            sizes, names, comps, own = size[rows], cls[rows], comp[rows], words[rows] == width
            one, both = stays[rows], stays[rows] & asks[rows]
            low = np.searchsorted(sizes, -(-sizes * percent // 100))
            high = np.searchsorted(sizes, sizes * 100 // percent, "right")
            for i in np.flatnonzero(asks[rows]):
                part = slice(low[i], high[i])
                differ = np.bitwise_count(bits[part] ^ bits[i]).sum(1, dtype=np.int64)
                hit = one[part] & (differ * (100 + percent) <= (sizes[part] + sizes[i]) * (100 - percent))
                if not hit.any():
                    continue
                hit &= comps[part] != comps[i]
                # a sketch of this width meets all that are as wide or wider, a wider one those of this width
                if not own[i]:
                    hit &= own[part]
                if not nearest and both[i]:
                    hit &= ~both[part] | (names[part] > names[i])
                if hit.any():
                    found.setdefault(rows[i], []).append((names[part][hit], differ[hit]))
        out = []
        for i, parts in found.items():
            near, differ = (np.concatenate(x) for x in zip(*parts, strict=True))
            best = differ.argmin()
            out.append((cls[i], [near[best]] if nearest else near, differ[best]))
        return pd.DataFrame(out, columns=["u", "near", "differ"])

    return run


def compared(many: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(u, near, differ) of the large buckets: blocks of the classes that ask against blocks of all members.

    In a bucket of one block every member is sent once, in others once for each block that it meets."""
    who = many.select("class").distinct().join(classes.select("class", "rep"), "class").withColumnRenamed("rep", "doc_id")
    who = who.join(sets.select("doc_id", "class", "n_shingles", "sketch"), ["doc_id", "class"]).dropDuplicates(["class"]).select("class", "n_shingles", "sketch")
    asking = many.groupBy("key").agg(F.count_if("asks").alias("asking"))
    rows = many.join(asking.where("asking > 0"), "key").join(who, "class")
    across, down = F.ceil(F.col("asking") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    # where a row goes, as (i, j, asks, stays): it asks in a line of blocks, and stays in another to be compared with
    place = lambda i, j, asks, stays: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), asks.alias("asks"), stays.alias("stays"))
    no, yes = F.lit(False), F.lit(True)
    one = F.transform(F.sequence(F.lit(0), down - 1), lambda j: place(F.pmod(F.hash("class"), across), j, yes, no))
    two = F.transform(F.sequence(F.lit(0), across - 1), lambda i: place(i, F.pmod(F.hash("class"), down), no, yes))
    places = F.when(down == 1, F.array(place(F.lit(0), F.lit(0), F.col("asks"), yes))).when(F.col("asks"), F.concat(one, two)).otherwise(two)
    rows = rows.select("key", "class", "component", "n_shingles", "sketch", F.explode(places).alias("p")).select("key", "class", "component", "n_shingles", "sketch", "p.*")
    return rows.groupBy("key", "i", "j").applyInPandas(_compared(percent, nearest), "u long, near array<long>, differ long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text).

    Documents link at a Jaccard similarity of ``percent`` hundredths or more of their sets
    of distinct ``k``-word shingles; component_id is the smallest doc_id that links reach.
    """
    docs = only(docs, "doc_id", "text")
    sets = written(docs.mapInArrow(_sets(k), "doc_id long, n_shingles long, class long, sketch binary"))
    classes = written(sets.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    rows = docs.where("doc_id is not null").mapInArrow(_keys(k, percent), "key long, class long, need int, band int").repartition("key")
    # both sides read all four columns, so that one exchange serves both
    shared = rows.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("final"), F.min_by("need", "class").alias("first_need"), F.max("band").alias("band"))
    shared = shared.where("first <> final and band >= 0").drop("final", "band")
    members = written(rows.join(shared.hint("shuffle_hash"), "key").select("key", "class", "need", "band", "first", "first_need").dropDuplicates(["key", "class"]))

    rows_in = sets.count()

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs of classes (u, v) that link, written. Every pair brings both texts, so that no more
        than a share of the table's rows are judged at once; their shuffle files go in between."""
        reps = classes.select("class", "rep")
        pairs = pairs.join(reps.withColumnsRenamed({"class": "u", "rep": "rep_u"}), "u").join(reps.withColumnsRenamed({"class": "v", "rep": "rep_v"}), "v")
        pairs = written(pairs)
        parts = max(1, -(-pairs.count() // max(AT_ONCE, rows_in // SHARE)))
        part = F.pmod(F.xxhash64("u", "v"), F.lit(parts))
        needed = written(pairs.select(F.explode(F.array("rep_u", "rep_v")).alias("doc_id")).distinct())
        # ids that were counted are broadcast, so that no text is shuffled to find those that are needed
        few = needed.count() <= BROADCAST_IDS
        texts = written(docs.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi"))
        found = [written(judged(pairs.where(part == i) if parts > 1 else pairs, texts)) for i in range(parts)]
        for done in (pairs, needed, texts):
            dropped(done)
        return reduce(DataFrame.unionByName, found)

    def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of some pairs that link, on the texts of their classes' first documents."""
        two = texts.join(pairs.select(F.col("rep_u").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep_u"), F.col("text").alias("text_u"))
        one = texts.join(pairs.select(F.col("rep_v").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep_v"), F.col("text").alias("text_v"))
        both = pairs.join(one, "rep_v").join(two, "rep_u")
        return both.select("u", "v", "text_u", "text_v").mapInArrow(_verified(k, percent), "u long, v long").distinct()

    # linked sets share the smaller of their two needs in every layout that both are in
    least_need = F.min(F.least("nu", "nv")).alias("need")
    near = members.where("class <> first").select(F.col("first").alias("u"), F.col("class").alias("v"), "band", F.col("first_need").alias("nu"), F.col("need").alias("nv"))
    near = near.groupBy("u", "v", "band").agg(F.count("*").alias("n"), least_need).where("n >= need")
    # of the first members that a class meets, the least and the one it shares most with: two pairs a class at most
    best = near.groupBy("v").agg(F.min("u").alias("a"), F.max(F.struct("n", "u"))["u"].alias("b"))
    tried = written(best.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("u"), "v"))
    edges = verify(tried)
    group = written(components(edges))

    def left_over() -> DataFrame:
        """Members of buckets that hold several components yet, with the bucket's size; outside: not in its largest one.

        A linked pair of different components shares the smaller of its needs in such buckets of one band.
        A member that is in fewer of them than its own need and the least of its bucket links with nobody there.
        """
        placed = members.join(group.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "need", "band", F.coalesce("component", "class").alias("component"))
        found = written(several(placed))
        often = found.groupBy("class", "band").agg(F.count("*").alias("open"))
        least = found.groupBy("key").agg(F.min("need").alias("least"))
        able = found.join(often, ["class", "band"]).join(least, "key").where(F.col("open") >= F.least("need", "least"))
        left = written(several(able.select("key", "class", "need", "band", "component")))
        dropped(found)
        return left

    def several(placed: DataFrame) -> DataFrame:
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        open_keys = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size")).where(F.col("main.n") < F.col("size"))
        found = placed.join(open_keys.select("key", "size", F.col("main.component").alias("main")), "key")
        return found.withColumn("outside", F.col("component") != F.col("main")).drop("main")

    # what shares a large bucket and is in different components yet: first every class outside of the
    # main component with the nearest of others in its largest bucket, a pair a class, which joins most ...
    left = left_over()
    for _ in range(ROUNDS):
        many = left.where(F.col("size") > SMALL)
        chosen = many.where("outside").groupBy("class").agg(F.max(F.struct("size", "key"))["key"].alias("key"), F.lit(True).alias("asks"))
        # written, as it is read three times
        many = written(many.join(chosen.select("key").distinct(), "key", "left_semi").join(chosen, ["key", "class"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))))
        best = compared(many, classes, sets, percent, True).groupBy("u").agg(F.min(F.struct("differ", F.col("near")[0].alias("v")))["v"].alias("v"))
        best = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = verify(best)
        dropped(many)
        if new.isEmpty():
            break
        edges = edges.unionByName(new)
        group = written(components(edges))
        dropped(left)
        left = left_over()
    dropped(members)
    # ... then all that is left: small buckets by a join, large ones by sketches
    few = left.where(F.col("size") <= SMALL)
    x = few.where("outside").select("key", "band", F.col("class").alias("u"), F.col("component").alias("cu"), F.col("need").alias("nu"))
    y = few.select("key", F.col("class").alias("v"), F.col("component").alias("cv"), F.col("need").alias("nv"))
    # a pair may be outside of one bucket's main component as (u, v) and of another's as (v, u): keys are counted once
    rest = x.join(y, "key").where("cu <> cv").select("key", "band", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "nu", "nv").dropDuplicates(["key", "band", "u", "v"])
    rest = rest.groupBy("u", "v", "band").agg(F.count("*").alias("n"), least_need)
    rest = written(rest.where("n >= need").select("u", "v").distinct())
    alike = compared(left.where(F.col("size") > SMALL).withColumnRenamed("outside", "asks"), classes, sets, percent, False).select("u", F.explode("near").alias("v"))
    alike = written(alike.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    more = verify(rest.unionByName(alike).distinct().join(tried, ["u", "v"], "left_anti"))
    for done in (left, tried, rest, alike):
        dropped(done)
    if not more.isEmpty():
        group = components(edges.unionByName(more))
    roots = classes.join(group.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = roots.join(least, "component").select("class", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sets.join(named, "class", "left").select("doc_id", "n_shingles", own.alias("component_id"))
