import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import vectorgraph as V
from tests.llm.test_vectorgraph import brute, cases, crowded


def test_blocks_and_parts(spark, monkeypatch):
    for name, value in (("SHARD", 20), ("CAP", 7), ("PART", 5)):
        monkeypatch.setattr(V, name, value)
    df = spark.createDataFrame(cases(), "vec_id long, embedding array<float>, label int")
    out, audit = V.near_duplicates(df)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str) == brute(cases(), 0.98)


def test_double_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 20)
    df = spark.createDataFrame(cases(), "vec_id long, embedding array<float>, label int").withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in V.near_duplicates(df)[0].collect()), key=str) == brute(cases(), 0.98)


def test_of_two_clusters_one_asks_the_other():
    a, b = np.indices((30, 30))
    off = a != b
    assert (V.asks(a, b) != V.asks(b, a))[off].all() and abs(V.asks(a, b)[off].mean() - 0.5) < 0.05


def test_a_node_lies_in_its_home_alone(spark):
    """Before, a node lay in every cluster that might be the home of one in range, and again for each block of it."""
    rows = crowded()
    x = V.unit(np.array([r[1] for r in rows], np.float64))
    spots = {(0, 32): V.centroids(x, 12)}
    df = spark.createDataFrame([(i, i, 1, lab, e) for i, e, lab in rows], "cid long, rep long, copies long, label int, embedding array<float>")
    schema = "label int, dim int, cluster int, block int, part int, node boolean, cid long, copies long, audit boolean, vector binary"
    dealt = df.mapInArrow(V._deal(spots, {}, 0.98), schema).select("cluster", "node", "cid", F.length("vector").alias("size")).collect()
    assert sorted(r["cid"] for r in dealt if r["node"]) == list(range(len(rows))) and {r["size"] for r in dealt} == {4 * 32}
    at = {(r["cluster"], r["cid"]) for r in dealt if not r["node"]}
    home = {r["cid"]: r["cluster"] for r in dealt if r["node"]}
    assert len(at) == sum(not r["node"] for r in dealt)
    for i, j in np.argwhere(np.triu(x @ x.T >= 0.98, 1)).tolist():  # every pair meets once
        assert home[i] == home[j] or ((home[i], j) in at) != ((home[j], i) in at)
