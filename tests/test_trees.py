import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from eventloom.sources import trees as T

PAGE = """<!doctype html><html><head><meta charset=utf-8><title>見出し &amp; 題</title><style>p{}</style><body><nav><a href="/a">A</a></nav>
<main><section id=s1><h3>祭り</h3><div><p>日 時 9月1日<p><a href="/b.pdf">B</a></div></section><section><h3>会</h3><h4>会</h4><h5>x</h5><ul><li><a href=/c>C</a><li>日時 d</ul></section></main>
<!-- <a href="/no">no</a> --><!--><script>var x = "<a href='/s'>";</script><p-x><a HREF='/d' href="/e">D</a></p-x></body></html>"""


class Walk(HTMLParser):
    """Elements with their ancestors as the standard library sees well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.seen = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, tuple(self.stack), dict(reversed(attrs))))
        if tag not in T.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        while self.stack and self.stack.pop() != tag:
            pass


def tree(spark, pages):
    return T.elements(spark.createDataFrame(pages, "id long, html string"), "id", "html")


def test_elements_have_intervals_text_and_implied_ends():
    rows, text = T._elements(PAGE)
    names = [r[4] for r in rows]
    assert names.count("a") == 4 and "p-x" in names and text.startswith("見出し & 題") and "var x" not in text
    for pre, last, _, parent, tag, _, begin, end, above, *_ in rows:
        assert pre <= last and begin <= end and (parent is None or (rows[parent][0] < pre <= rows[parent][1] and rows[parent][6] <= begin <= end <= rows[parent][7]))
        assert above == [] or above[0] == parent
        if tag == "p":
            assert rows[parent][4] == "div"
    body = names.index("body")
    assert rows[body][3] == 0 and rows[names.index("head")][1] < body
    assert [dict(r[5]).get("href") for r in rows if r[4] == "a"] == ["/a", "/b.pdf", "/c", "/d"]
    assert T._elements("")[0] == [] and T._elements("plain <b")[1] == "plain <b"
    deep, _ = T._elements("<div>" * 5000 + "x")
    assert len(deep) == 5000 and max(r[2] for r in deep) == T.DEEPEST


def test_elements_equal_the_standard_library_on_well_formed_pages():
    page = "<html><body>" + "".join(f"<div class='c{i}'><p>t<b>x</b><br/><a href='/{i}'>l</a></p><ul><li>1</li><li>2</li></ul></div>" for i in range(20)) + "</body></html>"
    rows, _ = T._elements(page)
    path = lambda r: [] if r[3] is None else [*path(rows[r[3]]), rows[r[3]][4]]
    assert [(r[4], tuple(path(r)), dict(r[5])) for r in rows] == Walk(page).seen


def test_nearest_box_equals_a_walk_upwards(spark):
    nodes, texts = tree(spark, [(1, PAGE), (2, None), (3, "<p>x"), (4, "<div>日時<div><h3>a</h3><h3>b</h3><h3>c</h3></div></div>")])
    heading = F.col("tag").isin("h3", "h4", "h5")
    got = T.nearest_box(nodes, texts, heading, heading, F.col("n") <= 2, r"日\s*時", fallback=True).collect()
    want = set()
    for i, page in ((1, PAGE), (4, "<div>日時<div><h3>a</h3><h3>b</h3><h3>c</h3></div></div>")):
        rows, text = T._elements(page)
        inside = lambda r: sum(h[4] in ("h3", "h4", "h5") and r[0] < h[0] <= r[1] for h in rows)  # noqa: B023, E731
        for h in rows:
            if h[4] in ("h3", "h4", "h5"):
                far, cur = None, h[3]
                while cur is not None and rows[cur][4] not in ("html", "body"):
                    if re.search(r"日\s*時", text[rows[cur][6] : rows[cur][7]]):
                        far = cur
                        if inside(rows[cur]) <= 2:
                            break
                    if rows[cur][4] == "main":
                        break
                    cur = rows[cur][3]
                if far is not None:
                    want.add((i, h[0], far))
    assert {(r["id"], r["target"], r["box"]) for r in got} == want and len(got) == len(want)


def test_grids_roles_and_pairs(spark):
    table = """<table><tr><td colspan=3>予定<tr><th>月 日</th><th>イベント名</th><th>場 所</th></tr>
      <tr><td>9/1</td><td>祭り</td><td rowspan="2">港</td></tr><tr><td>9/2</td><td>会 <b>館</b></td></tr><tr><td colspan="2">9/3</td><td>山</td></tr></table>
      <table><tr><th>日時</th><td>9月</td></tr><tr><td>会場</td><td>港<table><tr><td>a<td>b</table></td></tr></table><dl><dt>締切<dd>明日<dd>明後日<dt>他</dl>"""
    nodes, texts = tree(spark, [(1, table), (2, "<p>none")])
    cells = T.grid(nodes, texts)
    first = {(r["row"], r["col"]): r["text"] for r in cells.collect() if r["table"] == 0}
    assert first == {(0, 0): "予定", (0, 1): "予定", (0, 2): "予定", (1, 0): "月 日", (1, 1): "イベント名", (1, 2): "場 所", (2, 0): "9/1", (2, 1): "祭り", (2, 2): "港", (3, 0): "9/2", (3, 1): "会 館", (3, 2): "港", (4, 0): "9/3", (4, 1): "9/3", (4, 2): "山"}
    roles = sorted((r["row"], r["role"], r["text"]) for r in T.with_roles(cells).collect())
    assert roles == [(2, "date", "9/1"), (2, "place", "港"), (2, "title", "祭り"), (3, "date", "9/2"), (3, "place", "港"), (3, "title", "会 館"), (4, "date", "9/3"), (4, "place", "山"), (4, "title", "9/3")]
    assert {(r["label"], r["value"]) for r in T.label_values(cells).collect()} == {("日時", "9月"), ("会場", "港ab"), ("a", "b")}
    assert sorted((r["label"], r["value"]) for r in T.definitions(nodes, texts).collect()) == [("締切", "明後日"), ("締切", "明日")]


def test_boxes_of_the_given_pages_equal_a_walk(spark):
    from eventloom.plans import markup

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, markup.paragraph_boxes(spark, sf).collect()))
    want = []
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        rows, _ = T._elements(page["html"] or "")
        for r in rows:
            level, cur = 0, r[3]
            while r[4] == "p" and cur is not None and level < T.LEVELS and rows[cur][4] not in ("html", "body"):
                if any(h[4] in T.HEADINGS and rows[cur][0] < h[0] <= rows[cur][1] for h in rows):
                    want.append((page["page_id"], r[0], cur, rows[cur][4], level))
                    break
                if rows[cur][4] == "main":
                    break
                level, cur = level + 1, rows[cur][3]
    assert got == sorted(want) and len(got) > 100


def test_object_literals(spark):
    import json

    from eventloom.sources import literals as J

    def get(text, name="DATA"):
        found = spark.range(1).select(J.object_literal(F.lit(text), name)).first()[0]
        return json.loads(found) if found else None

    assert get("let DATA = {a: 1, 'b c': \"x}\", 3: [1.5, -2, .5e1 , ], $d: null, e: undefined, /* } */ f: 'it\\'s \"q\"', // ]\n g: `two\nlines`,};x={}".replace(".5e1", "0.5e1")) == {"a": 1, "b c": "x}", "3": [1.5, -2, 5.0], "$d": None, "e": None, "f": 'it\'s "q"', "g": "two\nlines"}
    assert get("DATA: [[1],{}]") == [[1], {}] and get("DATA = {a: {") is None and get("none") is None and get(None) is None
    rows = spark.createDataFrame([(1, "D = {m: {1: ['a', 'b'], 2: []}}"), (2, "D = {m: run()}"), (3, None)], "id int, t string")
    got = J.nested_rows(rows, "id", J.object_literal(F.col("t"), "D"), ("month", "day"), "title").where("title is not null").collect()
    assert sorted(map(tuple, got)) == [(1, "m", "1", 0, "a"), (1, "m", "1", 1, "b")]


def test_assets(spark):
    html = '<a href="b.pdf#x"> 一  覧 </a><a href=""><img src=c.png></a><img alt="d" src="/D.GIF"><a href="./b.pdf">twice</a><source srcset=" , e.webp 2x,c.png"><img src=><a>none</a><a href="f.html">f</a>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<a href=x.pdf>x</a>")], "page long, html string")
    urls = spark.createDataFrame([(1, "https://a.jp/p/q.html"), (2, "https://a.jp/"), (3, None)], "id long, page_url string")
    nodes, texts = T.elements(pages, "page", "html")
    got = sorted(tuple(r) for r in T.assets(nodes, texts, urls).collect())
    base = "https://a.jp/p/"
    assert got == sorted([(1, base + "b.pdf", "pdf", "一 覧"), (1, base + "c.png", "image", ""), (1, "https://a.jp/D.GIF", "image", "d"), (1, base + "e.webp", "image", "")])


def test_pages_of_elements_ask_their_ancestors_without_a_shuffle(spark):
    from eventloom.plans import markup

    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<div><h3>a</h3><p><a href=x>x</a>" * 3)], "id long, html string")
    boxes = markup.boxes(T.trees(pages, "html"))
    assert "Exchange" not in boxes._jdf.queryExecution().toString()
    nodes, texts = tree(spark, [(1, PAGE), (2, None), (3, "<div><h3>a</h3><p><a href=x>x</a>" * 3)])
    old = T.nearest_box(nodes, texts, (F.col("tag") == "a") & F.map_contains_key("attrs", F.lit("href")), F.col("tag").isin(*T.HEADINGS), F.col("n") >= 1)
    assert sorted(r["level"] for r in boxes.collect()) == sorted(r["level"] for r in old.collect()) and boxes.count() == 5
    own = T.trees(pages, "html").collect()
    assert [[n["tag"] for n in r["nodes"]] for r in own] == [[n[4] for n in T._elements(p or "")[0]] for p in (PAGE, None, "<div><h3>a</h3><p><a href=x>x</a>" * 3)]


def test_few_pages_are_taken_up_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "CHARACTERS", 1000)
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "html": ["<p>" + "x" * 400] * 50})
    parts = [(b.num_rows, len(found)) for b, found in T._cut(iter([batch]))]
    assert parts == [(3, 3)] * 16 + [(2, 2)]


def test_tables_of_pages_equal_the_grid_without_a_shuffle(spark):
    from eventloom.plans import markup

    html = """<table><tr><th>月 日</th><th>イベント名</th><th>場 所<tr><td>9/1\u3000x<td colspan=2 rowspan=" 2 ">祭り<table><tr><td>日時<td>内容</table><tr><td>9/2<tr><td colspan=2.5>9/3<td colspan=-1>a<td colspan=+2>b<td colspan=99999999999>c<td rowspan=x>d</table>
      <table><tr><td>a<td rowspan=3>b<tr><td>日程<td>催し 行事 内容 行事 内容 行事 内容 行事 内容<tr><td>日程<td>内容<td>会場<tr><td>1<td>2<td>3<tr><td>日程<td>内容</table><tr><td>none"""
    pages = spark.createDataFrame([(1, html), (2, "<p>none"), (3, None), (4, html * 2)], "id long, html string")
    nodes, texts = T.elements(pages, "id", "html")
    cells = T.grid(nodes, texts)
    tables = T.tables_in(pages, "html")
    own = tables.select("id", "table", F.inline("cells")).select(*cells.columns)
    assert sorted(own.collect()) == sorted(cells.collect()) and own.count() > 50
    roles = T.roles_in(tables)
    want = T.with_roles(cells).select(*roles.columns)
    assert sorted(roles.collect()) == sorted(want.collect()) and want.count() > 20
    plan = markup.table_roles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1  # the lines of an order, no cell


def test_object_literals_are_cut_once_and_hold_long_strings(spark):
    import json

    from eventloom.sources import literals as J

    for quote in "\"'`":
        said = "x" * 100_000 + "\\\\" + "y" * 100_000  # one escaped backslash
        rows = spark.createDataFrame([(f"let D = {{a: {quote}{said}{quote}}};",)], "t string").repartition(2)
        found = rows.select(J.object_literal(F.col("t"), "D").alias("d"))
        assert json.loads(found.first()[0]) == {"a": "x" * 100_000 + "\\" + "y" * 100_000}
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
