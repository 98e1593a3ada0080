"""Boxes, tables and object literals of pages, over the given pages and over pages made of orders and their lines, beside their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from eventloom.functions import dates as D
from eventloom.sources import literals as J
from eventloom.sources import pages as G
from eventloom.sources import trees as T
from eventloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark, sf: str) -> DataFrame:
    """Per order its lines in a list that is sorted; an order has a handful."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "day"))).alias("x"))


def text(c) -> F.Column:
    return c.cast("string")


@query("""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 as n from lineitem)
    select l_orderkey as id, cast(n + 2 as int) as row, unnest(['date', 'title', 'place']) as role, unnest([strftime(l_shipdate, '%Y-%m-%d'), '説明会 ' || l_partkey, '会場' || (l_orderkey % 7)]) as text from l""")
def table_roles(spark, sf):
    """A table per order: a title across all columns, headings with blanks, a venue that reaches down over all rows."""
    row = lambda x, i: F.concat(F.lit("<tr><td>"), x["day"], F.lit("<td><b>説明会</b> "), text(x["l_partkey"]), F.when(i == 0, F.concat(F.lit('<td rowspan="'), text(F.size("x")), F.lit('">会場'), text(F.col("l_orderkey") % 7))).otherwise(""))
    html = F.concat(F.lit('<html><body><table><tr><th colspan="3">予定</th></tr><tr><th>月 日</th><th>行事</th><th>場　所</th></tr>'), F.array_join(F.transform("x", row), ""), F.lit("</table><p>終"))
    return T.roles_in(T.tables_in(lines(spark, sf).select(F.col("l_orderkey").alias("id"), html.alias("html")), "html")).select("id", "row", "role", "text")


@query("""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as n from lineitem)
    select l_orderkey as id, '/' || l_partkey as href, case when l_linenumber % 3 = 0 then 'o' || l_orderkey else 's' || l_orderkey || '-' || n end as box, cast(case when l_linenumber % 3 = 0 then 1 else 0 end + case when l_suppkey % 2 = 0 then 1 else 0 end as int) as level from l""")
def link_boxes(spark, sf):
    """An order's lines as sections with a link, two in three with a heading of their own; the others take the order's box."""
    def section(x, i):
        link = F.concat(F.lit('<a href="/'), text(x["l_partkey"]), F.lit('">x</a>'))
        deep = F.when(x["l_suppkey"] % 2 == 0, F.concat(F.lit("<div><!-- <h3> -->"), link, F.lit("</div>"))).otherwise(link)
        head = F.when(x["l_linenumber"] % 3 == 0, "").otherwise("<h4>行</h4>")
        return F.concat(F.lit("<section id=s"), text(F.col("l_orderkey")), F.lit("-"), text(i + 1), F.lit(">"), head, deep, F.lit("</section>"))

    html = F.concat(F.lit("<body><h1>頁</h1><article id='o"), text(F.col("l_orderkey")), F.lit("'><h2>注文</h2>"), F.array_join(F.transform("x", section), ""), F.lit("</article>"))
    return boxes(T.trees(lines(spark, sf).select(F.col("l_orderkey").alias("id"), html.alias("html")), "html"))


def boxes(pages: DataFrame) -> DataFrame:
    """(id, href, box, level): the nearest box with a heading around every link, by the box's id or its tag."""
    attr = lambda x, n: F.try_element_at(x["attrs"], F.lit(n))
    href, name = lambda t: [attr(t, "href").alias("href")], lambda b: [F.coalesce(attr(b, "id"), b["tag"]).alias("name")]
    found = T.nearest_in(pages, lambda x: (x["tag"] == "a") & F.map_contains_key(x["attrs"], F.lit("href")), heading, lambda b: b["n"] >= 1, href, name)
    return found.select("id", "href", F.col("name").alias("box"), "level")


def heading(x: F.Column) -> F.Column:
    return x["tag"].isin(*T.HEADINGS)


@query(None)
def paragraph_boxes(spark, sf):
    """For every paragraph of the given pages its nearest box with a heading; SQL cannot cut pages into elements, a test walks up from each."""
    pages = T.trees(table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html"), "html")
    return T.nearest_in(pages, lambda x: x["tag"] == "p", heading, lambda b: b["n"] >= 1).select(F.col("id").alias("page_id"), "target", "box", "tag", "level")


@query("""select o_custkey as id, strftime(o_orderdate, '%Y-%m') as month, strftime(o_orderdate, '%d') as day, cast(row_number() over (partition by o_custkey, o_orderdate::date order by o_orderkey) - 1 as int) as pos, '注文 "{' || o_orderkey || '}"' as title from orders""")
def literal_days(spark, sf):
    """A script per customer with months, days and orders as an object literal: bare and quoted keys, comments, braces in strings, trailing commas."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.date_format("o_orderdate", "dd").alias("day"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "")
    title = F.concat(F.lit("'注文 \"{"), text(F.col("o_orderkey")), F.lit("}\"', "))
    titles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", title.alias("t")))), lambda x: x["t"]), "")
    # dealt by customer once, so that days, months and scripts need no deal of their own
    days = o.repartition("o_custkey").groupBy("o_custkey", "month", "day").agg(titles.alias("t"))
    day = F.concat(F.lit("\n  "), F.when(F.col("day") < "15", F.concat(F.lit('"'), F.col("day"), F.lit('"'))).otherwise(F.col("day")), F.lit(": ["), F.col("t"), F.lit("], // it's } here"))
    months = days.groupBy("o_custkey", "month").agg(joined(day).alias("t"))
    month = F.concat(F.lit("'"), F.col("month"), F.lit("': { /* { */"), F.col("t"), F.lit("\n},"))
    scripts = months.groupBy("o_custkey").agg(F.concat(F.lit("<script>var other = {a: 1};\nconst DAYS = {"), joined(month), F.lit("};\nrun(DAYS); var x = '};';</script>")).alias("html"))
    return J.nested_rows(scripts.withColumnRenamed("o_custkey", "id"), "id", J.object_literal(F.col("html"), "DAYS"), ("month", "day"), "title")


# What a page says of its charset, in which it is written, and what the server says, by page_id modulo 6.
SAID = [("utf-8", "utf-8", None), ("Shift_JIS", "cp932", None), ("euc-jp", "euc_jp", "text/html"), ("iso-2022-jp", "iso2022_jp", None), ("utf-8", "cp932", "text/html; charset=sjis"), ("nonsense", "utf-8", None)]


@F.arrow_udf(BinaryType())
def _encoded(text: pa.Array, codec: pa.Array) -> pa.Array:
    return G.by_slices(lambda t, c: t.encode(c), pa.binary(), text, codec)


@query(f"""with p as (select page_id, {[s for s, _, _ in SAID]!r}[(page_id % 6)::int + 1] as said, regexp_replace(coalesce(html, ''), '[^\x20-\x7E\n]', '', 'g') as html from pages),
    t as (select page_id, '<meta charset="' || said || '">航空祭の説明会、第' || page_id || '回' || html as text from p)
    select page_id, sha256(text) as digest, length(text) as n_chars from t""")
def page_charsets(spark, sf):
    """Pages written in four charsets, one of them declared by the server against the page's own word, one under an unknown name, come back equal."""
    by = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in SAID]), (F.col("page_id") % 6).cast("int") + 1)
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x20-\x7E\n]", "")
    whole = F.concat(F.lit('<meta charset="'), by(0), F.lit('">航空祭の説明会、第'), text(F.col("page_id")), F.lit("回"), plain)
    raw = table(spark, sf, "pages").select("page_id", _encoded(whole, by(1)).alias("raw"), by(2).alias("content_type"))
    out = raw.select("page_id", G.decoded(F.col("raw"), F.col("content_type")).alias("text"))
    return out.select("page_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("n_chars"))


@query("""select page_id, case page_id % 5 when 0 then 'https://a.jp/pco/' || page_id || '/top/x.html' when 1 then 'https://a.jp/up/' || page_id when 2 then 'https://a.jp/pco/' || page_id || '/?q=1' end as target from pages""")
def page_forwards(spark, sf):
    """Pages that send their readers on: down, up, to a query, to another host, too late; the given html follows."""
    k = F.col("page_id")
    go = F.when(k % 5 == 0, F.concat(F.lit("0; URL='./top/./x.html#a'"))).when(k % 5 == 1, F.concat(F.lit("3;url=../../up/"), text(k))).when(k % 5 == 2, "0,url=?q=1").when(k % 5 == 3, "0;url=https://b.jp/").otherwise("11;url=late.html")
    html = F.concat(F.lit('<meta charset=utf-8><META content="'), go, F.lit('" http-equiv=Refresh>'), F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)<meta\b", "<m"))
    pages = table(spark, sf, "pages").select("page_id", html.alias("html"), F.concat(F.lit("https://A.jp/pco/"), text(k), F.lit("/#top")).alias("url"))
    return pages.select("page_id", G.forwarded_to(F.col("html"), F.col("url")).alias("target"))


@query("""select o_orderkey as id, case when o_orderkey % 10 <> 0 and d >= timestamp '2023-06-01' then strftime(d, '%Y-%m-%d') end as date from (select o_orderkey, o_orderdate + interval 28 year as d from orders)""")
def listed_dates(spark, sf):
    """A page per customer lists orders (28 years on, when days fall on the same weekdays) under headings of fiscal years; one in ten names a wrong weekday, one has a year of its own."""
    k, d = F.col("o_orderkey"), F.add_months("o_orderdate", 12 * 28)
    names = F.array(*[F.lit(x) for x in "日月火水木金土日"])
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", d.alias("d"), (F.year(d) - F.when(F.month(d) <= 3, 1).otherwise(0)).alias("fy"))
    name = F.element_at(names, F.when(k % 10 == 0, F.dayofweek("d") % 7 + 1).otherwise(F.dayofweek("d")))
    said = F.when(k % 10 == 1, F.date_format("d", "yyyy.M.d")).otherwise(F.concat(text(F.month("d")), F.lit("月"), text(F.dayofmonth("d")), F.lit("日（"), name, F.lit("）")))
    entry = F.concat(F.lit("<li>第"), text(k), F.lit("番 "), said)
    # dealt by customer once, so that years and pages need no deal of their own
    lists = o.repartition("o_custkey").groupBy("o_custkey", "fy").agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("entries"))
    heading = F.when(F.col("fy") % 2 == 0, F.concat(text(F.col("fy")), F.lit("年度"))).otherwise(F.concat(F.lit("令和"), F.when(F.col("fy") == 2019, "元").otherwise(text(F.col("fy") - 2018)), F.lit("年度の予定")))
    part = F.concat(F.lit("<h2>"), heading, F.lit("</h2><h3>一覧</h3><ul>"), F.col("entries"), F.lit("</ul>"))
    pages = lists.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fy", part.alias("p")))), lambda x: x["p"]), "").alias("html"))
    entries = T.dated_entries(T.trees(pages.select("html"), "html"), lambda x: x["tag"] == "li")
    number = F.regexp_extract("text", r"第(\d+)番", 1).cast("long")
    return entries.select(number.alias("id"), D.listed_date(F.col("text"), F.lit("2023-06-01"), F.col("context"))["date"].alias("date"))


@query("""with l as (select distinct l_orderkey as k, l_partkey as p from lineitem)
    select k as id, 'https://a.jp/o/f/' || p || '.pdf' as url, 'pdf' as type, '資料 ' || p as label from l where p % 3 = 0
    union all select k, 'https://a.jp/o/' || k || '/i/' || p || '.JPG', 'image', '図' || p from l where p % 3 = 1
    union all select k, 'https://a.jp/s/' || p || '.webp', 'image', '像' from l where p % 3 = 2
    union all select k, 'https://a.jp/s/' || p || '-2.webp', 'image', '' from l where p % 3 = 2""")
def page_assets(spark, sf):
    """A page per order shows a document, a picture in a link, or a picture with alternatives per line, in quotes of each kind or none."""
    def item(x):
        p = text(x["l_partkey"])
        pdf = F.concat(F.lit("<a class=x href='../f/"), p, F.lit(".pdf?utm_source=m#p2'>資料\n <b>"), p, F.lit("</b></a>"))
        linked = F.concat(F.lit("<a href=/g/"), p, F.lit(">図"), p, F.lit("<span><img src=\"i/"), p, F.lit(".JPG\"></span></a>"))
        several = F.concat(F.lit("<picture><source srcset='/s/"), p, F.lit(".webp 1x, /s/"), p, F.lit("-2.webp 2x'><img alt=像 src=/s/"), p, F.lit(".webp></picture><a href=mailto:a@a.jp>m</a>"))
        return F.when(x["l_partkey"] % 3 == 0, pdf).when(x["l_partkey"] % 3 == 1, linked).otherwise(several)

    pages = lines(spark, sf).select(F.col("l_orderkey").alias("id"), F.concat(F.lit("<body><!-- <a href=x.pdf> -->"), F.array_join(F.transform("x", item), "")).alias("html"))
    urls = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://a.jp/o/"), text(F.col("o_orderkey")), F.lit("/")).alias("page_url"))
    return T.assets_in(T.trees(pages.join(urls, "id"), "html"))
