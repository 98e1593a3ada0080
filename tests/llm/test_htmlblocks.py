from eventloom.llm import htmlblocks

BODY = ["The harbour reopened on Monday after the long repair of its outer wall.", "Crews worked through the winter &amp; finished two weeks early,   officials said.", "Ferries will run every hour until the end of the season, the company wrote."]
PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
    + "<article><h1>Harbour opens</h1>" + "".join(f"<p>{b}</p>" for b in BODY) + "</article><aside><ul><li><a href='/c'>More</a></li></ul></aside>"
    + "<div class='comments'><p>Great news for us all!</p></div><footer><p>Copyright notice</p></footer></body></html>"
)


def test_article_stays_and_frame_goes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    mine = spark.createDataFrame([(-1, "u", PAGE), (-2, "u", None), (-3, "u", "")], pages.schema)
    got = {r["page_id"]: r for r in htmlblocks.extract(pages.unionByName(mine)).collect()}
    assert len(got) == pages.count() + 3
    text = got[-1]["text"]
    for part in ("The harbour reopened", "winter & finished two weeks early, officials", "Ferries will run"):
        assert part in text
    for part in ("Home", "Copyright", "var a", "Great news"):
        assert part not in text
    assert got[-1]["n_chars"] == len(text)
    assert [got[i]["text"] for i in (-2, -3)] == ["", ""]


NEUTRAL = (
    "<div class='{0}'><ul>" + "".join(f"<li><a href='/{i}'>{w}</a></li>" for i, w in enumerate("Home News Sport Kontakt About".split())) + "</ul></div>"
    + "<div class='{1}'><h1>A long day at the harbour</h1>" + "".join(f"<p>{b}</p>" for b in BODY) + "</div><div class='{2}'><p>© 2024 Harbour News</p></div>"
)


def test_names_that_say_nothing_or_mislead(spark):
    """Menus and copyright lines go without telling names; a hyphenated topic does not empty a text."""
    names = [("x1", "x2", "x3"), ("globalnavi", "inhalt", "fuss"), ("x1", "comment-on-law story", "x3")]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    mine = spark.createDataFrame([(-1 - i, "u", NEUTRAL.format(*n)) for i, n in enumerate(names)], pages.schema)
    got = {r["page_id"]: r["text"] for r in htmlblocks.extract(pages.unionByName(mine)).where("page_id < 0").collect()}
    for text in got.values():
        assert "The harbour reopened" in text and "Ferries will run" in text
        assert "Kontakt" not in text and "©" not in text


def test_empty_repeated_clashing_and_long(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long = "<article>" + "<p>" + "<b>word</b> " * 30_000 + "end.</p>" + "<p>A plain sentence follows here, and it is said again.</p>" * 2_000 + "</article>"
    rows = [(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (None, None, None, None, None), (2, "u", long, "x", 1)]
    got = htmlblocks.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert len({r["text"] for r in got if r["page_id"] == 1}) == 1 and [r["text"] for r in got if r["page_id"] is None] == [""]
    assert htmlblocks.extract(spark.createDataFrame([], schema)).count() == 0


def test_pages_without_end_tags_and_with_odd_names_keep_their_text():
    texts = lambda page: [b[0] for b in htmlblocks.blocks(page)]
    assert texts("<html><head><meta charset=utf-8><title>x</title><body><p>Hello world</p><p>more") == ["Hello world", "more"]
    assert texts("<head><meta charset=utf-8><p>Hello</p>") == ["Hello"] and texts("<head><title>t</title>plain text") == ["plain text"]
    assert texts("<p>before</p><title-bar>x</title-bar><p>after</p>") == ["before", "x", "after"]
    assert texts("<p>a</p><!--><p>b</p><!---><p>c</p><!-- x --!><p>d</p><!-- <p>no") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><script>x</scripty></script ><p>b</p>") == ["a", "b"]
