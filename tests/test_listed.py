"""Dates of lists under headings with years, and second readings of rows."""

from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.operators import joins as J
from eventloom.sources import trees as T


def test_listed_date(spark):
    cases = [
        ("令和８年 ９月１日（火）", None, None, "2026-09-01", "2026-09-01"),
        ("R8.9", None, None, None, None),
        ("平成元年1月8日", None, None, None, None),
        ("2026/9/1 10月2日", None, None, "2026-09-01", "2026-09-01"),
        ("2026年2月30日", None, None, None, None),
        ("9月1日（火）", None, None, "2026-09-01", "2026-09-01"),
        ("9月1日（水）", None, None, None, "2027-09-01"),
        ("9月1日（木）", None, None, None, None),
        ("3月1日（祝）", 2026, True, "2027-03-01", None),
        ("3月1日（月）", 2026, True, "2027-03-01", "2027-03-01"),
        ("3/1", 2026, False, None, None),
        ("12.24", 2027, True, "2027-12-24", "2026-12-24"),
        ("", 2026, False, None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(cases, "t string, year int, fiscal boolean, strict string, loose string")
    today = F.lit("2026-08-18")
    strict = D.listed_date(F.col("t"), today, F.struct("year", "fiscal"))
    for r in df.select("t", "strict", "loose", strict.alias("got"), D.listed_date(F.col("t"), today).alias("free")).collect():
        assert (r["got"] and r["got"]["date"]) == r["strict"], r
        assert (r["free"] and r["free"]["date"]) == r["loose"], r
    name = df.where("t = '3月1日（祝）'").select(strict["name"]).first()[0]
    assert name == "祝"


def test_year_contexts(spark):
    html = "<p>a</p><h2><b>２０２６</b>年度</h2><p>b</p><h3>一覧</h3><table><caption>令和元年<tr><td>c</table><h4>令和9年度</h4><p>d"
    pages = spark.createDataFrame([(1, html), (2, "<h1>x</h1><p>y"), (3, None)], "page long, html string")
    nodes, texts = T.elements(pages, "page", "html")
    rows = nodes.where("tag in ('p', 'td', 'b')").join(T.year_contexts(nodes, texts), ["id", "pre"]).join(texts, "id")
    got = {(r["id"], r["t"]): tuple(r["context"]) for r in rows.select("id", T.part_of(F.col("text"), F.col("begin"), F.col("end")).alias("t"), "context").collect()}
    assert got == {(1, "a"): (None, False), (1, "２０２６"): (2026, True), (1, "b"): (2026, True), (1, "c"): (2019, False), (1, "d"): (2027, True), (2, "y"): (None, False)}


def test_rechecked(spark):
    rows = spark.createDataFrame([(1, "会 Ａ", "x", 5), (2, "会", None, 5), (3, "会", "なし", 5), (None, "会", "x", 5)], "id long, title string, place string, keys int")
    readings = spark.createDataFrame([(1, ["title", "place"], "会a", "N/A"), (2, ["place"], None, " 館 "), (3, ["place"], None, "-"), (9, ["title"], "z", None)], "id long, keys array<string>, title string, place string")
    got = {r["id"]: r for r in J.rechecked(rows, readings, "id", ["title", "place"]).collect()}
    assert (got[1]["title"], got[1]["place"], got[1]["keys"]) == ("会 Ａ", None, 5)
    assert [tuple(c) for c in got[1]["changes"]] == [("place", "x", None)]
    assert (got[2]["title"], got[2]["place"]) == ("会", "館")
    assert got[3]["changes"] == [] and got[3]["place"] == "なし"
    assert got[None]["changes"] == [] and len(got) == 4


def test_with_reading_leaves_rows_without_one(spark):
    rows = spark.createDataFrame([(1, "t", "", None, " "), (2, None, "a", "n", "u")], "id int, title string, time string, notes string, url string")
    readings = spark.createDataFrame([(1, "r", " ", "m", "ftp://a")], "id int, title string, time string, notes string, url string")
    got = {r["id"]: tuple(r)[1:] for r in J.with_reading(rows, readings, "id", ["title"], ["time"], ["notes"], ["url"]).collect()}
    assert got == {1: ("t", None, "m", None), 2: (None, "a", "n", "u")}


def test_dated_entries_equal_the_contexts_without_a_shuffle(spark):
    html = "<li>9月1日<h2><b>２０２６</b>年度</h2><ul><li>2月3日<li>5月5日</ul><h3>一覧</h3><li>6月1日<table><caption>令和元年<tr><td>c</table><ul><li>7月1日<ul><li>8月1日</ul></ul><h4>令和9年度</h4><li>1月9日"
    pages = spark.createDataFrame([(1, html), (2, "<h1>x</h1><li>y"), (3, None), (4, "<h1>2025年</h1>"), (5, html)], "id long, html string")
    own = T.dated_entries(T.trees(pages, "html"), lambda x: x["tag"] == "li")
    assert "Exchange" not in own._jdf.queryExecution().toString()
    nodes, texts = T.elements(pages, "id", "html")
    old = nodes.where("tag = 'li'").join(T.year_contexts(nodes, texts), ["id", "pre"]).join(texts, "id")
    want = old.select("id", "pre", T.part_of(F.col("text"), F.col("begin"), F.col("end")).alias("text"), "context")
    assert sorted(own.collect()) == sorted(want.collect()) and own.count() == 15


def test_an_entry_is_cleaned_once_and_not_for_each_pattern(spark):
    day = D.listed_date(F.col("t"), F.lit("2026-08-18"), F.struct(F.lit(2026).alias("year"), F.lit(True).alias("fiscal")))
    plan = spark.createDataFrame([("9月1日",)], "t string").select(day["date"].alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1
