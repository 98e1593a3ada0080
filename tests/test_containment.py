import numpy as np
from pyspark.sql import functions as F

from eventloom.operators import containment as C
from eventloom.operators import snapshots as N


def test_contained_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    text = lambda n: "".join(rng.choice(list("abあ会"), n))
    short = [(int(rng.integers(0, 3)), text(int(rng.integers(1, 6)))) for _ in range(200)] + [(0, None), (None, "abab")]
    long = [(int(rng.integers(0, 3)), text(int(rng.integers(1, 14)))) for _ in range(200)] + [(0, None), (None, "ababa")]
    a, b = (spark.createDataFrame(x, "block int, key string") for x in (short, long))
    want = {(i, x, y) for i, x in short for j, y in long if i == j and i is not None and x and y and len(x) >= 3 and x != y and x in y}
    got = C.contained(a, b, ["block"], "key").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    like = {(i, x, y) for i, x in short for j, y in long if i == j and i is not None and x and y and len(x) >= 3 and len(y) >= 3 and (x in y or y in x)}
    got = C.like_keys(a, b, ["block"], "key").collect()
    assert set(map(tuple, got)) == like and len(got) == len(like)


def test_longest_name_guard_and_festival(spark):
    names = spark.createDataFrame([("宇都宮駐屯地",), ("北宇都宮駐屯地",), ("入間基地",), ("下総航空基地",), ("市ケ谷駐屯地",), ("ab",), (None,)], "name string")
    rows = [(1, "北宇都宮駐屯地"), (2, "南宇都宮駐屯地"), (3, "陸上自衛隊宇都宮 駐屯地"), (4, "入間航空祭2026"), (5, "下総航空祭"), (6, "東入間基地と入間航空祭"), (7, "市ヶ谷駐屯地 祭"), (8, "ab"), (9, None), (10, "宇都宮駐屯地と入間基地"), (11, "")]
    got = dict(map(tuple, C.longest_name(spark.createDataFrame(rows, "id int, t string"), names, "id", "t", "name").collect()))
    assert got == {1: "北宇都宮駐屯地", 2: None, 3: "宇都宮駐屯地", 4: "入間基地", 5: "下総航空基地", 6: "入間基地", 7: "市ヶ谷駐屯地", 8: None, 9: None, 10: "宇都宮駐屯地", 11: None}


def test_merged_titles_and_twins(spark):
    gone = spark.createDataFrame([(1, "p", "広報活動 ふじざくらＦＣ"), (2, "p", "会"), (3, None, "音楽まつり"), (4, "p", None), (5, "q", "ふじざくらFC")], "id int, pref string, title string")
    now = spark.createDataFrame([("p", "ふじざくらFC"), ("p", "会"), (None, "音楽まつり"), ("p", None)], "pref string, title string")
    assert [r["id"] for r in N.merged_into(gone, now, ["pref"], "title").collect()] == [1]
    a = spark.createDataFrame([(1, "d", "音楽まつり", "港"), (2, "d", "音楽まつり", None), (3, "d", "音楽まつり", "山")], "id int, date string, title string, place string")
    b = spark.createDataFrame([(8, "d", "秋の音楽まつり", "港の広場"), (9, "e", "音楽まつり", "港")], "id int, date string, title string, place string")
    assert sorted(map(tuple, N.twins(a, b).collect())) == [(1, 8), (2, 8)]


def test_texts_meet_the_names_where_they_lie(spark):
    """Grams of texts are many times the texts: they are cut once for names and once for stems, and not counted."""
    names = [f"{a}{b}基地" for a in "甲乙丙丁" for b in ("", "山川", "山川草木花鳥", "山川草木花鳥風月雪")]
    texts = spark.createDataFrame([*enumerate(names), (98, None), (99, "名なし")], "id int, t string")
    got = C.longest_name(texts, spark.createDataFrame([(n,) for n in names], "name string"), "id", "t", "name")
    assert {r["id"]: r["name"] for r in got.collect()} == {**dict(enumerate(names)), 98: None, 99: None}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("explode(array_distinct(regexp_extract_all(t#") + plan.count("explode(concat(regexp_extract_all(t#") == 2


def test_first_twins_equal_those_of_all_pairs(spark):
    """Copies of a row have the same twins: they are found once for all copies, with the results of all pairs."""
    rng = np.random.default_rng(1)
    some = lambda *x: x[int(rng.integers(0, len(x)))]
    make = lambda first: [(None if i == 7 else first + i // 2 if i % 9 == 0 else first + i, some("d", "e", None), some("音楽まつり", "秋の音楽まつり", "音楽", "港", None), some("", None, "港", "港の広場", "山")) for i in range(120)]
    a, b = (spark.createDataFrame(make(n), "id int, date string, title string, place string") for n in (0, 1000))
    want = sorted(map(str, N.filled(a, b, N.twins(a, b), ["place"]).collect()))
    assert sorted(map(str, N.filled_by_twins(a, b, ["place"]).collect())) == want and len(want) < 240


def test_copies_of_a_row_make_no_pairs(spark, monkeypatch):
    made, twins = [], N.twins
    monkeypatch.setattr(N, "twins", lambda a, b: made.append(twins(a, b)) or made[-1])
    a, b = (spark.range(30).selectExpr(f"id + {n} as id", "'d' as date", "'音楽まつり' as title", "'港' as place") for n in (0, 1000))
    got = N.filled_by_twins(a, b, ["place"])
    assert made[0].count() == 1 and sorted(r["id"] for r in got.collect()) == list(range(30))


def test_candidates_do_not_grow_with_the_block(spark):
    """Titles of two letters share every gram of three: of 4,096 others each meets those of a longer gram only."""
    keys = spark.range(1 << 12).select(F.lit("b").alias("block"), F.translate(F.lpad(F.bin("id"), 12, "0"), "01", "ab").alias("key"))
    longer = keys.select("block", F.concat("key", F.lit("c")).alias("key"))
    pairs = C.candidates(keys, longer, ["block"], "key")
    assert pairs.count() == 1 << 12  # some 2 million by grams of three
    assert C.contained(keys, longer, ["block"], "key").count() == 1 << 12
