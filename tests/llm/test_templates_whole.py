import pytest

from eventloom.llm import templates as T

ITEMS = [
    (1, "glass melts above copper slowly"),
    (2, "Carry 7 boxes past the old mill, then 9 crates over our bridge"),
    (3, "We saw Anna near a gate and then Carlo behind some wall"),
    (4, "every morning our baker sells warm bread beside that quiet river bank"),
]
PLAIN = "one two three four five six seven"


@pytest.mark.parametrize("lead", range(6))
def test_an_item_of_one_window_at_any_offset(spark, lead):
    words = PLAIN.split()[:lead]
    docs = spark.createDataFrame([(1, " ".join([*words, ITEMS[0][1], PLAIN]))], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["n_windows"]) for r in T.leaks(docs, items).collect()] == [(1, 1, 1)]


def test_values_of_other_lengths(spark):
    texts = {
        20: "Carry 3.5 boxes past the old mill, then 1,250.75 crates over our bridge",
        30: "We saw Maria Luisa Verdi near a gate and then Bo behind some wall",
        40: "every morning our baker sells warm very fresh bread beside that quiet river bank",
        41: "every morning our baker sells nothing",
    }
    docs = spark.createDataFrame([(d, f"{PLAIN} {t} {PLAIN}".replace("seven We", "seven. We")) for d, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in T.leaks(docs, items).collect()} == {(20, 2), (30, 3), (40, 4)}


def test_marks_keep_tokens_and_templates_aligned(spark):
    from pyspark.sql import functions as F

    texts = ["\ue000a 1\ue0002 \ue002x, Anna\ue003 Berta Carla 3", "x A1.5b 12:30 1/2 3. 4, 5", "so Anna Berta2 C 7,8,", "a 1.\u00e9 B\u00e9a C\ue001D E"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(T.tokens(F.col("text")).alias("a"), T.template(F.col("text")).alias("b"))
    rows = df.collect()
    assert all(len(r["a"]) == len(r["b"]) for r in rows)
    assert rows[1]["b"][2:6] == ["0", "0", "0", "0"]


def test_null_ids_and_rows_that_share_an_id(spark):
    passage = "the quick brown fox carries seven heavy stones over the old bridge before dusk falls on the town"
    other = "nobody in this village ever saw a green lantern burning so late behind the miller's locked door"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (1, f"x {passage} y"), (2, "nothing here at all to see for anyone today"), (2, other), (None, f"so {passage}"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (7, other), (7, "an entirely different question about rivers and boats"), (7, other)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in T.leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, None), (2, 7), (None, None)], key=str)
