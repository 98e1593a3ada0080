import numpy as np

from eventloom.llm import vectorgraph as V


def brute(rows, least):
    n = len(rows)
    ok = [e is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(e) and lab is not None and i is not None for i, e, lab in rows]
    links, root = [0] * n, list(range(n))
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float32).astype(np.float64) for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a] += 1
                    links[b] += 1
                    x, y = root[a], root[b]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], links[i], min(ids) if ids else None))
    return sorted(out, key=str)


def cases():
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        base = rng.normal(size=(60, 16))
        base[20:30] = base[:10] * 3 + rng.normal(size=(10, 16)) * 0.1
        base[30:45] = base[0] + rng.normal(size=(15, 16)) * 0.12
        rows += [(len(rows) + i, v.astype(np.float32).tolist(), label) for i, v in enumerate(base)]
    same = rows[3][1]
    return [*rows, (900, same, 0), (901, same, 0), (901, same, 0), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0), (905, [None] * 16, 1), (906, [float("inf")] * 16, 1), (907, [], 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1), (None, same, 0)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 20)
    df = spark.createDataFrame([(*r, "x") for r in cases()], "vec_id long, embedding array<float>, label int, cid string")
    out, audit = V.near_duplicates(df)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str) == brute(cases(), 0.98)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "CAP", 7)
    df = spark.createDataFrame(cases(), "vec_id long, embedding array<float>, label int")
    out, audit = V.near_duplicates(df)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str) == brute(cases(), 0.98)


def crowded(n=4000, dim=32):
    """One label with pairs near the threshold, chains along a curve, a crowd, and strangers."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x[500:1500] = x[:1000] + rng.normal(size=(1000, dim)) * 0.2
    t = np.linspace(0, 6, 800)[:, None]
    x[1500:2300] = np.cos(t) * x[0] + np.sin(t) * x[1]
    x[2300:2900] = x[2] + rng.normal(size=(600, dim)) * 0.12
    return [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]


def test_links_of_one_crowded_label(spark, monkeypatch):
    """Against brute force over all rows: links are the same from both ends, and recall is nearly whole."""
    monkeypatch.setattr(V, "SHARD", 300)
    rows = crowded()
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = V.near_duplicates(df)[0].cache()
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    got = np.array([got[i] for i in range(len(rows))])
    assert want.sum() > 50_000 and (got <= want).all() and got.sum() >= 0.999 * want.sum()
    queries, links, met = V.audited(df, out).first()
    assert (queries, links) == (40, want[::100].sum()) and met >= 0.99 * links


def test_reach_misses_no_home():
    rng = np.random.default_rng(5)
    c = V.unit(rng.normal(size=(40, 8)))
    a = V.unit(rng.normal(size=(3000, 8)))
    b = V.unit(a + rng.normal(size=a.shape) * 0.05)
    near = (a * b).sum(1) >= 0.98
    row, k, home = V.reach(b, c, 0.98)
    assert near.sum() > 500 and set(zip(np.flatnonzero(near).tolist(), (a @ c.T).argmax(1)[near].tolist(), strict=True)) <= set(zip(row.tolist(), k.tolist(), strict=True))
    assert home.sum() == len(b)


def test_recall_of_the_graph():
    rng = np.random.default_rng(0)
    x = V.unit(np.concatenate([rng.normal(size=(800, 64)), np.ones(64) + rng.normal(size=(200, 64)) * 0.08]))
    graph = V.robust_prune(x)
    start = int((x @ x.mean(0)).argmax())
    found = sum(len(V.range_search(x, graph, start, q, 0.98)) for q in x)
    assert found >= 0.9 * (x @ x.T >= 0.98).sum()


def test_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))[0].count() == 0
