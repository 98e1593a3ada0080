"""Bytes by charset: broken input, marks, unknown names, nulls; addresses against the standard library."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from eventloom.sources import pages as G


def test_decoded(spark):
    sjis = '<meta http-equiv="Content-Type" content="text/html; charset=Shift_JIS">①髙'.encode("cp932")
    cases = [
        (sjis, None, sjis.decode("cp932")),
        (b"\xef\xbb\xbfabc", None, "abc"),
        (b"a\xffb\xe3\x81", None, "a�b�"),
        (b"caf\xe9 \x93x\x94 \x81", "text/html; charset=ISO-8859-1", "café “x” \x81"),
        ("語".encode("utf-16-le") + b"\x00", "text/plain;charset=utf-16", "語�"),
        ("会".encode(), "text/html; charset=what", "会"),
        (b"x" * 5000 + b"charset=euc-jp \xe4\xbc\x9a", None, "x" * 5000 + "charset=euc-jp 会"),
        (b"\x82", "charset=sjis", "�"),
        (b"", None, ""),
        (None, "charset=sjis", None),
    ]
    df = spark.createDataFrame(cases, "raw binary, kind string, want string")
    for r in df.select("want", G.decoded(F.col("raw"), F.col("kind")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_resolved(spark):
    base = "https://a.jp/x/y/z.html?q=1#f"
    hrefs = ["b.html", "./b.html", "../b", "../../../b", "/c/./d/../e", "?k=2", "//b.jp/p", "http://b.jp/q?a=../b", "d/", "..", ".", "a?b#c"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = {r["h"]: r["r"] for r in df.select("h", G.resolved(F.col("h"), F.lit(base)).alias("r")).collect()}
    assert got == {h: urljoin(base, h).split("#")[0] for h in hrefs}
    none = df.limit(1).select(G.resolved(F.lit("mailto:x"), F.lit(base)), G.resolved(F.lit("x"), F.lit("ftp://a/")), G.resolved(F.lit(None), F.lit(base))).first()
    assert list(none) == [None, None, None]


def test_forwarded_to(spark):
    tag = lambda content, q='"': f"<meta http-equiv={q}refresh{q} content={q}{content}{q}>"
    cases = [
        (tag("0;url=n.html"), "https://a.jp/d/n.html"),
        (tag("0; url=n.html", "'"), "https://a.jp/d/n.html"),
        (tag("60;url=n.html") + tag("5;url=m.html"), "https://a.jp/d/m.html"),
        (tag("0;url=https://b.jp/"), None),
        (tag("0;url=i.html#x"), None),
        (tag("5"), None),
        ("x" * 20000 + tag("0;url=n.html"), None),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "html string, want string")
    for r in df.select("want", G.forwarded_to(F.col("html"), F.lit("https://a.jp/d/i.html")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_a_batch_leaves_arrow_by_slices():
    import tracemalloc

    import pyarrow as pa

    raw = pa.array(["あ".encode("cp932") * 5000, None] * 2000, pa.binary())  # 20 MB of bytes
    codec = pa.array(["cp932"] * 4000)
    tracemalloc.start()
    got = G.by_slices(lambda b, c: b.decode(c, "replace"), pa.string(), raw, codec)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.null_count == 2000 and got[0].as_py() == "あ" * 5000 and len(got) == 4000
    assert peak < 5_000_000  # all at once are 40 MB of Python objects
