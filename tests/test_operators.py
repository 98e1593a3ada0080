"""Operators whose results SQL cannot state, or on rows of their own."""

import datetime as dt

from pyspark.sql import functions as F

from eventloom.functions import rules, scalars
from eventloom.operators import entities, joins, windows
from eventloom.sources import pages, sinks, tables
from eventloom.streaming import views

UTC = dt.UTC


def test_first_accept_is_anchored_at_the_first(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0, tzinfo=UTC) + dt.timedelta(minutes=m)
    rows = [("a", at(m)) for m in (0, 20, 29, 30, 59, 60, 200)] + [("b", at(5)), ("b", at(5))]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = sorted((r["k"], r["m"]) for r in windows.first_accept(df, ["k"], "ts", 1800).select("k", ((F.unix_seconds("ts") - 1704067200) / 60).cast("int").alias("m")).collect())
    assert got == [("a", 0), ("a", 30), ("a", 60), ("a", 200), ("b", 5)]
    two = windows.first_accept(df, ["k"], "ts", 1800, limit=2).where("k = 'a'").count()
    assert two == 7 - 1  # 0 20 | 30 59 | 60 | 200


def test_stream_accepts_what_the_batch_accepts(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0, tzinfo=UTC) + dt.timedelta(minutes=m)
    rows = [(k, at(m)) for k in "ab" for m in (0, 10, 31, 40, 61, 62)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    for i, part in enumerate((df.where("minute(ts) < 20 and hour(ts) = 0"), df.where("minute(ts) >= 20 or hour(ts) > 0"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            assert part.count() == 4
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = views.accepted(stream, ["k"], "ts", 1800).writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").format("parquet").start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, windows.first_accept(df, ["k"], "ts", 1800).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_leaders_follow_the_order(spark):
    rows = [(1, "x", "spring open day", 3), (2, "x", "spring open day at the port", 9), (3, "x", "other", 1), (4, "y", "spring open day", 1)]
    df = spark.createDataFrame(rows, "id long, day string, title string, score int")
    assert sorted(r["id"] for r in entities.leaders(df, ["day"], "title", "score", ["id"]).collect()) == [2, 3, 4]


def test_masked_phrases_do_not_cancel(spark):
    texts = [("荒天の場合は中止となる場合があります", False), ("本イベントは中止となりました", True), ("", False), (None, False)]
    df = spark.createDataFrame(texts, "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", rules.cancelled(F.col("t")).alias("got")).collect())


def test_rules_in_order(spark):
    df = spark.createDataFrame([("基地見学説明会",), ("護衛艦の一般公開",), ("何か",)], "t string")
    assert [r[0] for r in df.select(rules.category(F.col("t"))).collect()] == ["説明会", "一般公開", rules.OTHER_CATEGORY]
    assert df.select(rules.sticky_status(F.lit("cancelled"), F.lit("published"))).first()[0] == "cancelled"


def test_calendar_round_trip(spark):
    df = spark.createDataFrame([("u1", dt.date(2024, 2, 28), dt.date(2024, 3, 1), "a, b; c\\d", "hall")], "id string, a date, b date, t string, p string")
    text = df.select(sinks.ics(F.col("id"), F.col("a"), F.col("b"), F.col("t"), F.col("p")).alias("text"))
    row = pages.calendar_events(text, "text").first()
    assert (row["uid"], row["date"], row["endDate"], row["title"], row["place"]) == ("u1", "2024-02-28", "2024-03-01", "a, b; c\\d", "hall")
    folded = spark.createDataFrame([("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:long\r\n er\r\nDTSTART:20240105T100000Z\r\nEND:VEVENT",)], "text string")
    assert tuple(pages.calendar_events(folded, "text").select("title", "date").first()) == ("longer", "2024-01-05")


def test_snapshot_round_trip(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"updatedAt": "x", "tokyo": [{"id": "1", "title": "a"}, {"id": "2", "title": "b"}]}')
    got = tables.snapshot(spark, str(path))
    sinks.write_snapshot(got.select("pref", "id", "title"), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("pref", "id", "title").collect())) == [("tokyo", "1", "a"), ("tokyo", "2", "b")]
    path.write_text("{broken")
    assert tables.snapshot(spark, str(path)).count() == 0


def test_archive_keeps_the_latest(spark):
    old = spark.createDataFrame([("1", "2024-01-01", "old"), ("2", "2023-01-01", "old")], "id string, day string, v string")
    new = spark.createDataFrame([("1", "2024-01-02", "new")], old.schema)
    assert [tuple(r) for r in sinks.archive(old, new, "id", "day", "2023-06-01", 5).collect()] == [("1", "2024-01-02", "new")]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalars.half_width(F.lit("ＡＢ１２"))) == "AB12"
    assert get(scalars.nfkc(F.lit("ｶﾞ"))) == "ガ"
    assert get(scalars.normal_url(F.lit("https://a.jp/x/?b=2&utm_source=z&a=1#t"))) == "https://a.jp/x?a=1&b=2"
    assert get(scalars.safe_cell(F.lit("=1+1"))) == "'=1+1"
    assert get(scalars.degraded(F.lit("abcdef"), F.lit("abdef"))) is True
    assert get(scalars.degraded(F.lit("abcdef"), F.lit("abcde"))) is False
    assert get(scalars.escape_ics(F.lit("a;b,c"))) == "a\\;b\\,c"
    assert get(scalars.year_before(F.lit("2024-02-29"))) == "2023-02-29"
    assert get(scalars.clean_field(F.lit("a​b<"), 10)) == "ab＜"
    assert get(scalars.era_year(F.lit("令和"), F.lit(6))) == 2024


def test_rotation_and_nearest(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "i long")
    assert sorted(r["turn"] for r in windows.rotated(df, ["i"], 3, 5).collect()) == [0, 1, 2, 3, 4]
    p = spark.createDataFrame([(1, 35.0, 139.0)], "a long, lat double, lon double")
    q = spark.createDataFrame([(7, 35.044, 139.0), (8, 35.046, 139.0), (9, 35.0, 139.05)], "b long, lat double, lon double")
    assert [(r["b"], r["rk"]) for r in joins.nearest(p, q, 5000, 5, "a", "b").orderBy("rk").collect()] == [(9, 1), (7, 2)]


def test_lifted_facets_locale_ranks_and_misreadings(spark):
    from eventloom.functions import titles
    from eventloom.operators import aggregates, windows

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None), (None, 1)], "k string, n int")
    got = aggregates.lifted_facets(rows, {"k": F.col("k") == "a", "n": F.col("n") == 1}, {"k": F.col("k"), "n": F.col("n")}).collect()
    assert {(r["facet"], r["value"]): r["n"] for r in got} == {("list", ""): 1, ("k", "a"): 1, ("k", "b"): 1, ("k", aggregates.UNKNOWN): 1, ("n", "1"): 1, ("n", "2"): 1}
    names = spark.createDataFrame([("さくら",), ("アサヒ",), ("あき",), ("カメ",), ("亜",), (None,)], "name string").withColumn("g", F.lit(1))
    ranked = windows.locale_ranked(names, ["g"], "name").orderBy("rank").collect()
    assert [r["name"] for r in ranked] == ["あき", "アサヒ", "カメ", "さくら", "亜", None]
    fix = lambda t, pairs: spark.range(1).select(titles.corrected(F.lit(t), pairs)).first()[0]
    assert fix("abab aba", {"ab": "x", "aba": "y", "": "z"}) == "yb y"
    assert fix("a.b", {".": "-", "a-": "c"}) == "cb" and fix("aaaa", {"a": "b", "b": "c", "c": "d", "d": "e"}) == "dddd"
    assert fix(None, {"a": "b"}) is None and fix("x", {}) == "x" and fix(r"q\Eq", {r"\E": "!"}) == "q!q"


def test_corrected_walks_once_a_round(spark):
    """No text is cut into its characters, and none is made again for each place that names it."""
    from eventloom.functions import titles

    fixed = titles.corrected(F.col("t"), {"a+": "b", "𠮷": "吉", "吉b": "c", "": "x"})
    rows = spark.createDataFrame([("𠮷a+" * 1000,), ("\n.\r",), ("",), (None,)], "t string").select(fixed.alias("t"))
    assert [r["t"] for r in rows.collect()] == ["c" * 1000, "\n.\r", "", None]
    assert rows._jdf.queryExecution().analyzed().toString().count("corrections(") == 1
