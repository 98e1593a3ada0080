from eventloom.llm import paritysketch as P
from tests.llm.test_paritysketch import brute, corpus


def test_large_buckets_by_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 1)
    monkeypatch.setattr(P, "BLOCK", 2)
    monkeypatch.setattr(P, "AT_ONCE", 20)
    monkeypatch.setattr(P, "SHARE", 1000)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in P.jaccard_components(df, 4, 85).collect()} == brute(rows, 4, 85)
