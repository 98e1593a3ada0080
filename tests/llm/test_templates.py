from eventloom.llm import templates as T

ITEMS = [(1, "If Anna walks 3 km in 2 hours then how far does Anna walk in 5 hours on a road", "x"), (2, "Plain words without any slots make up this whole second question of ours", "x"), (3, None, "x"), (4, "too short", "x")]
FILL = "other sentences stand around here and there. "
DOCS = [
    (10, FILL * 3 + ITEMS[0][1] + ". " + FILL),
    (11, FILL + "If Berta walks 7 km in 4 hours then how far does Berta walk in 9 hours on a road. " + FILL),
    (12, FILL + "If Berta walks 7 km in 4 hours then how far does Carla walk in 9 hours on a road. " + FILL),
    (13, FILL * 20),
    (14, None),
    (15, ""),
    (16, "Lead in. " + ITEMS[1][1]),
    (16, "Lead in. " + ITEMS[1][1]),
    (17, "make up this whole second thing"),
    (18, FILL * 9000 + ITEMS[1][1]),
    (None, ITEMS[1][1]),
]


def test_leaks(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, gram string")
    got = {(r["doc_id"], r["item_id"]) for r in T.leaks(docs, items).collect()}
    assert got == {(10, 1), (11, 1), (16, 2), (18, 2), (None, 2)}


def test_tokens_and_templates_align(spark):
    texts = [(d[1],) for d in DOCS] + [(i[1],) for i in ITEMS] + [("İx A1b2, Ébc Def 5kg 3 KG É",)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts, "text string")
    assert df.where(F.size(T.tokens(F.col("text"))) != F.size(T.template(F.col("text")))).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, gram string")
    assert T.leaks(docs.limit(0), items).count() == 0
    assert T.leaks(docs, items.limit(0)).count() == 0
