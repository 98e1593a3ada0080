"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label are one node. The nodes of a label are dealt to clusters: each lies
in that of the nearest centroid, its home, and in no other. A task builds the robust-pruned
graph of a home's nodes. Its nodes search it, and so do those nodes of other homes that may
have one of them in range (no farther from the plane between the two centroids than two
vectors in range can be apart); of two homes one is asked by the other, so a pair is met
once. A search is greedy from the medoid and keeps expanding while nodes in range turn up;
every pair found is verified by its cosine in double precision and counts for both ends.
Askers whose vec_id is divisible by 100, and a few more of every task, audit it: they are
also compared with all its nodes, and a task whose recall is below ``RECALL`` is searched
exhaustively, in blocks. ``audited`` measures recall against all rows.

Centroids come from a sample of at most ``SAMPLE`` nodes, and there are at most
``CENTROIDS`` of them; they are kept apart, so that no dense group is cut by them. A
cluster of more than ``CAP`` nodes is cut into blocks, and those who ask a block into parts
of about ``PART``: a task holds a block and a part, whatever the size of a group. Vectors
travel as they are given, once for their home and once for each home that they ask.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite
components, and rows without label or vec_id, link with nothing (component: themselves).
Vectors of different lengths do not link. Repeated rows count as other vectors. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import components, written

SHARD, CAP, PART = 4000, 4096, 16_384
SAMPLE, CENTROIDS = 20_000, 32_768
DEGREE, CANDIDATES, ALPHA, BEAM = 20, 40, 1.2, 16
RECALL, AUDIT, FEW, MARGIN = 0.99, 100, 8, 0.03


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 8, apart: float = 0.9) -> np.ndarray:
    """At most k spherical k-means centroids of unit rows, none closer than ``apart`` to another."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < apart:
            kept.append(i)
    return c[kept]


def pruned(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Of each row's candidates (-1: none) those that no nearer kept one covers, many rows at once."""
    real = near >= 0
    y = x[np.maximum(near, 0)]
    d = np.where(real, 1 - np.einsum("rcd,rd->rc", y, x[rows]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    at = np.arange(len(rows))[:, None]
    near, d, y = near[at, order], d[at, order], y[at, order]
    between = 1 - y @ y.transpose(0, 2, 1)
    open_, kept = np.isfinite(d), np.zeros(near.shape, bool)
    one = np.arange(len(rows))
    for _ in range(degree):
        j = open_.argmax(1)
        some = open_[one, j]
        if not some.any():
            break
        kept[one[some], j[some]] = True
        open_ &= ~some[:, None] | (alpha * between[one, j] > d)
        open_[one, j] = False
    return [n[k] for n, k in zip(near, kept, strict=True)]


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency of a robust-pruned graph on unit rows: near neighbours that no kept one covers, both ways."""
    n = len(x)
    most = min(CANDIDATES, n - 1)
    if most < 1:
        return [np.zeros(0, np.int64)] * n
    out: list[np.ndarray] = []
    for a in range(0, n, 256):
        s = x[a : a + 256] @ x.T
        rows = np.arange(a, a + len(s))
        s[np.arange(len(s)), rows] = -2
        out += pruned(x, rows, np.argpartition(-s, most - 1, axis=1)[:, :most], degree, alpha)
    source, target = np.repeat(np.arange(n), [len(o) for o in out]), np.concatenate(out)
    both = np.unique(np.concatenate([source * n + target, target * n + source]))
    out = np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))
    large = np.array([i for i in range(n) if len(out[i]) > degree], np.int64)
    for a in range(0, len(large), 64):
        rows = large[a : a + 64]
        near = np.full((len(rows), max(len(out[i]) for i in rows)), -1, np.int64)
        for r, i in enumerate(rows):
            near[r, : len(out[i])] = out[i]
        for i, kept in zip(rows, pruned(x, rows, near, degree, alpha), strict=True):
            out[i] = kept
    return out


def range_search(x: np.ndarray, graph: list[np.ndarray], start: int, q: np.ndarray, least: float) -> np.ndarray:
    """Rows of x within ``least`` of q: greedy from ``start`` with a beam, then outwards while some are in range."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    beam, scores = np.array([start]), x[[start]] @ q
    done: set[int] = set()
    found_i, found_s = [beam], [scores]
    while True:
        todo = [i for i in beam.tolist() if i not in done]
        if not todo:
            break
        done.add(todo[0])
        new = graph[todo[0]]
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            s = x[new] @ q
            found_i.append(new)
            found_s.append(s)
            beam, scores = np.concatenate([beam, new]), np.concatenate([scores, s])
            order = np.argsort(-scores, kind="stable")[:BEAM]
            beam, scores = beam[order], scores[order]
    i, s = np.concatenate(found_i), np.concatenate(found_s)
    edge = i[s >= least - MARGIN]
    hits = [i[s >= least]]
    while len(edge):
        new = np.unique(np.concatenate([graph[e] for e in edge.tolist()]))
        new = new[~seen[new]]
        seen[new] = True
        s = x[new] @ q
        hits.append(new[s >= least])
        edge = new[s >= least - MARGIN]
    return np.concatenate(hits)


def reach(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cluster, home): of unit rows, the clusters that may be the home of a vector in range of each.

    Such a vector lies on the other side of the plane between the two centroids, and at most
    the chord of the range away.
    """
    s = x @ c.T
    home = s.argmax(1)
    best = s[np.arange(len(x)), home]
    chord = np.sqrt(2 - 2 * least) + 1e-9
    row, k = np.nonzero(s >= (best - 2 * chord)[:, None])
    apart = np.linalg.norm(c[home[row]] - c[k], axis=1)
    kept = best[row] - s[row, k] <= chord * apart + 1e-12
    row, k = row[kept], k[kept]
    return row, k, k == home[row]


def asks(home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether nodes of a cluster ask another one: of two clusters one asks the other, each about as often as it is asked."""
    return ((home + other) % 2 == 0) == (home < other)


def _homes(spots: dict[tuple, np.ndarray], least: float, batch: pa.RecordBatch) -> Iterator[tuple]:
    """((label, dim), rows, their home, (place among the rows, cluster) of the clusters that they ask) of some nodes, few at a time."""
    label, groups = batch.column("label").to_pylist(), {}
    embedding = batch.column("embedding")
    sizes = np.diff(np.asarray(embedding.offsets))
    flat, at = embedding.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    for i, (one, n) in enumerate(zip(label, sizes.tolist(), strict=True)):
        groups.setdefault((one, n), []).append(i)
    for key, members in groups.items():
        for a in range(0, len(members), 512):
            rows = np.array(members[a : a + 512])
            raw = np.stack([flat[at[i] : at[i + 1]] for i in rows])
            raw = raw if raw.dtype == np.float32 else raw.astype(np.float64)
            home, row, other = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if key in spots:
                row, other, own = reach(unit(raw.astype(np.float64)), spots[key], least)
                home[row[own]] = other[own]
                asked = ~own & asks(home[row], other)
                row, other = row[asked], other[asked]
            yield key, rows, raw, home, row, other


def _sizes(spots: dict[tuple, np.ndarray], least: float):
    """(label, dim, cluster, nodes, askers) of clusters, as a batch counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("label").type
            for key, _, _, home, _, other in _homes(spots, least, batch):
                if key in spots:
                    n = len(spots[key])
                    counts = np.bincount(home, minlength=n), np.bincount(other, minlength=n)
                    columns = [pa.array([key[0]] * n, kind), pa.array(np.full(n, key[1], np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, counts)]
                    yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "cluster", "nodes", "askers"])

    return run


def _deal(spots: dict[tuple, np.ndarray], large: dict[tuple, tuple[int, int]], least: float):
    """Every node to its home, and as an asker to the blocks behind its own and to the other clusters that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("label").type
            cid, copies, rep = (batch.column(c).to_numpy() for c in ("cid", "copies", "rep"))
            for key, rows, raw, home, row, other in _homes(spots, least, batch):
                to: list[tuple[int, int, int, int, bool]] = []  # place, cluster, block, part, whether as a node
                some = cid[rows].view(np.uint64)
                for i, (h, c) in enumerate(zip(home.tolist(), some.tolist(), strict=True)):
                    blocks, parts = large.get((*key, h), (1, 1))
                    own = c % blocks
                    to += [(i, h, own, p, True) for p in range(parts)]
                    to += [(i, h, b, c // blocks % parts, False) for b in range(own + 1, blocks)]
                for i, k in zip(row.tolist(), other.tolist(), strict=True):
                    blocks, parts = large.get((*key, k), (1, 1))
                    to += [(i, k, b, int(some[i]) // blocks % parts, False) for b in range(blocks)]
                place, cluster, block, part, node = (np.array(c) for c in zip(*to, strict=True))
                whole = [r.tobytes() for r in raw]
                for a in range(0, len(to), 4096):
                    cut = slice(a, a + 4096)
                    at = rows[place[cut]]
                    columns = [pa.array([key[0]] * len(at), kind), np.full(len(at), key[1], np.int32), *(c[cut].astype(np.int32) for c in (cluster, block, part)), node[cut], cid[at], copies[at], rep[at] % AUDIT == 0, pa.array([whole[i] for i in place[cut]], pa.binary())]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["label", "dim", "cluster", "block", "part", "node", "cid", "copies", "audit", "vector"])

    return run


def _search(least: float, dtype: type):
    def vectors(column: pd.Series, dim: int) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column), dtype).reshape(len(column), dim).astype(np.float64))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, askers = group[group["node"]], group[~group["node"]]
        if not len(nodes):
            return pd.DataFrame({"cid": [], "links": [], "root": [], "audited": [], "met": []})
        dim, n = int(group["dim"].iloc[0]), len(nodes)
        if group["part"].iloc[0] == 0:  # the nodes themselves ask once
            askers = pd.concat([nodes, askers])
        x, cid = vectors(nodes["vector"], dim), nodes["cid"].to_numpy()
        y, mine = vectors(askers["vector"], dim) if len(askers) else x[:0], askers["cid"].to_numpy()
        graph, start = robust_prune(x), int((x @ x.mean(0)).argmax())
        found = [range_search(x, graph, start, q, least) for q in y]
        audit = askers["audit"].to_numpy(bool).copy()
        audited = met = 0
        audit[:FEW] = True
        audit[n : n + FEW] = True
        for i in np.flatnonzero(audit):
            exact = np.flatnonzero(x @ y[i] >= least)
            exact = exact[cid[exact] != mine[i]]
            audited += len(exact)
            met += len(np.intersect1d(exact, found[i]))
        if met < RECALL * audited:
            found = [np.flatnonzero(r >= least) for a in range(0, len(y), 256) for r in y[a : a + 256] @ x.T]
        pairs = [np.zeros((0, 2), np.int64)]
        for i, f in enumerate(found):
            f = f[(x[f] @ y[i] >= least) & (cid[f] != mine[i])]
            if len(f):
                pairs.append(np.stack([np.full(len(f), mine[i]), cid[f]], 1))
        pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)  # a pair within the block is found from both ends, or from one
        # links and components of what this task has seen
        every, at = np.unique(np.concatenate([cid, mine]), return_index=True)
        copies = np.concatenate([nodes["copies"].to_numpy(), askers["copies"].to_numpy()])[at]
        a, b = np.searchsorted(every, pairs[:, 0]), np.searchsorted(every, pairs[:, 1])
        links = np.bincount(a, copies[b], len(every)) + np.bincount(b, copies[a], len(every))
        root = np.arange(len(every))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        shown = links > 0
        shown[0] = True  # a row for the audit
        out = pd.DataFrame({"cid": every[shown], "links": links[shown].astype(np.int64), "root": every[root[shown]], "audited": 0, "met": 0})
        out.iloc[0, 3:] = [audited, met]
        return out

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label), and (audited, met) of the audit."""
    rows = vectors.select("vec_id", "embedding", "label")
    e = F.col("embedding")
    sound = F.forall(e, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & F.exists(e, lambda v: v != 0)
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    ids = F.xxhash64("label", "embedding")
    nodes = ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("cid", ids))
    label = nodes.schema["label"].dataType.simpleString()

    large = nodes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    totals = {(r["label"], r["dim"]): r["n"] for r in large.orderBy(F.desc("n")).limit(CENTROIDS).collect()}
    count = sum(totals.values())
    sampled = nodes.where(F.pmod(F.xxhash64("cid"), F.lit(max(1, -(-2 * count // SAMPLE)))) == 0).limit(SAMPLE).select("label", "embedding")
    sample: dict[tuple, list] = {}
    for r in sampled.collect() if totals else []:
        sample.setdefault((r["label"], len(r["embedding"])), []).append(r["embedding"])
    scale = max(1.0, count / SHARD / CENTROIDS)
    spots = {k: centroids(unit(np.array(s, np.float64)), int(-(-totals[k] // (SHARD * scale)))) for k, s in sample.items() if k in totals}

    key = ["label", "dim", "cluster"]
    counts = nodes.mapInArrow(_sizes(spots, least), f"label {label}, dim int, cluster int, nodes long, askers long").groupBy(*key).agg(F.sum("nodes").alias("nodes"), F.sum("askers").alias("askers")) if spots else None
    many = counts.where((F.col("nodes") > CAP) | (F.col("askers") > PART)).collect() if spots else []  # a row per centroid at most
    large = {}
    for r in many:
        blocks = max(1, -(-r["nodes"] // CAP))
        large[(r["label"], r["dim"], r["cluster"])] = blocks, max(1, -(-(r["askers"] + (r["nodes"] if blocks > 1 else 0)) // PART))
    dealt = nodes.mapInArrow(_deal(spots, large, least), f"label {label}, dim int, cluster int, block int, part int, node boolean, cid long, copies long, audit boolean, vector binary")
    dtype = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    met = written(dealt.groupBy(*key, "block", "part").applyInPandas(_search(least, dtype), "cid long, links long, root long, audited long, met long"))

    group = components(met.where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = nodes.select("cid", "rep", "copies").join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least_id = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = roots.join(least_id, "component").join(links, "cid", "left").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    out = rows.select("vec_id", F.when(fine, ids).alias("cid")).join(facts, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    audit = met.agg(F.sum("audited").alias("audited"), F.sum("met").alias("met"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audit


def audited(vectors: DataFrame, found: DataFrame, least: float = 0.98) -> DataFrame:
    """One row (queries, links, met): vectors whose id is divisible by 100 against all of their label, in blocks.

    ``links`` are those that brute force finds, ``met`` the part that ``n_links`` of ``found`` has.
    """
    rows = vectors.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0))
    asked = rows.where(F.col("vec_id") % AUDIT == 0).select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"), F.col("embedding").alias("q"))
    count = asked.groupBy("q_label").agg(F.ceil(F.count("*") / CAP).cast("int").alias("blocks"))
    each = asked.join(count, "q_label").withColumn("block", F.pmod(F.xxhash64("q_id"), F.col("blocks")).cast("int")).drop("blocks").withColumn("part", F.explode(F.array(*map(F.lit, range(8)))))
    others = rows.join(count.withColumnRenamed("q_label", "label"), "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int"))

    def run(key: tuple, queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(nodes):
            return pd.DataFrame({"vec_id": [], "links": []})
        links = np.zeros(len(queries), np.int64)
        dims, q_dims = nodes["embedding"].map(len).to_numpy(), queries["q"].map(len).to_numpy()
        for d in np.unique(q_dims):
            at, of = np.flatnonzero(q_dims == d), np.flatnonzero(dims == d)
            if len(of):
                x, y = unit(np.stack(queries["q"].to_numpy()[at]).astype(np.float64)), unit(np.stack(nodes["embedding"].to_numpy()[of]).astype(np.float64))
                links[at] = (x @ y.T >= least).sum(1)
        return pd.DataFrame({"vec_id": queries["q_id"], "links": links})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    exact = each.groupBy("q_label", "block", "part").cogroup(others.groupBy("label", "block", "part")).applyInPandas(run, f"vec_id {kind}, links long")
    exact = exact.groupBy("vec_id").agg((F.sum("links") - 1).alias("links")).join(found.select("vec_id", "n_links"), "vec_id")
    return exact.agg(F.count("*").alias("queries"), F.sum("links").alias("links"), F.sum(F.least("links", "n_links")).alias("met"))
