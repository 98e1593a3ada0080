"""Pages and calendars as rows: links, assets, meta-refresh targets, VEVENT blocks, bytes by their charset. All in the JVM, but for charsets that it has no safe decoder for."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventloom.functions.scalars import bound

ASSET = r"(?i)\.(?:pdf|jpe?g|png|gif|webp)(?:[?#]|$)"


def links(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, href, kind): every href of a page, as asset, page, anchor or other."""
    href = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), 1)).alias("href")
    kind = F.when(F.col("href").rlike(ASSET), "asset").when(F.col("href").rlike("^#"), "anchor").when(F.col("href").rlike("(?i)^(mailto|tel|javascript):"), "other").otherwise("page")
    return pages.select(id_, href).withColumn("kind", kind)


def refresh_target(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+url=([^"'>\s]+)""", 1), F.lit(""))


def unescape_ical(c: Column) -> Column:
    t = F.regexp_replace(c, r"\\[nN]", "\n")
    return F.regexp_replace(t, r"\\([,;\\])", "$1")


def unfolded(text: Column) -> Column:
    """A calendar's text with its folded lines joined."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]", "")


def event_fields(block: Column) -> dict[str, Column]:
    """The fields of one VEVENT of an unfolded text."""
    field = lambda name: F.nullif(F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1), F.lit(""))
    day = lambda name: F.date_format(F.try_to_date(F.left(field(name), F.lit(8)), "yyyyMMdd"), "yyyy-MM-dd")
    whole = field("DTEND").rlike(r"^\d{8}$")  # an all-day end is exclusive
    end = F.when(whole, F.date_format(F.date_sub(F.to_date(day("DTEND")), 1), "yyyy-MM-dd")).otherwise(day("DTEND"))
    return {"uid": field("UID"), "date": day("DTSTART"), "endDate": end} | {n: unescape_ical(field(f)) for f, n in (("SUMMARY", "title"), ("LOCATION", "place"), ("DESCRIPTION", "notes"))}


def calendar_events(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, uid, date, endDate, title, place, notes) per VEVENT; folded lines are joined, no time zone is applied."""
    block = F.explode(F.slice(F.split(unfolded(F.col(text)), "BEGIN:VEVENT"), 2, 1 << 30)).alias("block")
    return texts.select(*keep, block).select(*keep, *[c.alias(n) for n, c in event_fields(F.col("block")).items()])


# Labels of charsets that need a codec of their own, with its name; of single-byte Western text; all others are UTF-8.
CODECS = {
    "cp932": ("shift_jis", "shift-jis", "sjis", "x-sjis", "ms_kanji", "ms932", "windows-31j", "csshiftjis"),
    "euc_jp": ("euc-jp", "x-euc-jp", "cseucpkdfmtjapanese"),
    "iso2022_jp": ("iso-2022-jp", "csiso2022jp"),
    "utf-16-le": ("utf-16", "utf-16le", "unicode", "ucs-2", "iso-10646-ucs-2"),
    "utf-16-be": ("utf-16be",),
    "gb18030": ("gb18030", "gbk", "gb2312", "x-gbk"),
    "big5": ("big5", "big5-hkscs", "x-x-big5"),
    "cp949": ("euc-kr", "ks_c_5601-1987", "windows-949"),
}
WESTERN = ("iso-8859-1", "iso8859-1", "latin1", "l1", "us-ascii", "ascii", "windows-1252", "cp1252", "x-cp1252")
#: Bytes 80 to 9F that Western text uses as characters.
UPPER = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


#: Rows that are Python objects at once: bounds a task's memory, not the result.
SLICE = 64


def by_slices(convert: Callable[[object, object], object], kind: pa.DataType, first: pa.Array, second: pa.Array) -> pa.Array:
    """``convert`` of each row's two values, null if one is; of a batch only a slice at a time is taken out of Arrow."""
    out = []
    for i in range(0, len(first), SLICE):
        rows = zip(first.slice(i, SLICE).to_pylist(), second.slice(i, SLICE).to_pylist(), strict=True)
        out.append(pa.array([None if a is None or b is None else convert(a, b) for a, b in rows], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


@F.arrow_udf(StringType())
def _by_codec(raw: pa.Array, codec: pa.Array) -> pa.Array:
    return by_slices(lambda b, c: b.decode(c, "replace"), pa.string(), raw, codec)


def charset(raw: Column, content_type: Column | None = None) -> Column:
    """The label declared by the content type, else within the first 5,000 bytes, in lower case; utf-8 if there is none."""
    found = lambda c, quote: F.nullif(F.regexp_extract(c, rf"(?i)charset\s*=\s*{quote}([\w-]+)", 1), F.lit(""))
    own = found(F.decode(F.substring(raw, 1, 5000), "ISO-8859-1"), """["']?""")
    return F.lower(F.coalesce(*([] if content_type is None else [found(content_type, "")]), own, F.lit("utf-8")))


def decoded(raw: Column, content_type: Column | None = None) -> Column:
    """Bytes as text by their declared charset.

    Unknown labels are read as UTF-8; what is no character of the charset becomes U+FFFD; a byte
    order mark goes; null stays null. UTF-8 and Western text stay in the JVM, and only the bytes
    of other charsets are sent to Python.
    """
    label = charset(raw, content_type)
    codecs = F.create_map(*[F.lit(x) for codec, labels in CODECS.items() for label_ in labels for x in (label_, codec)])
    codec = F.try_element_at(codecs, label)
    western = F.translate(F.decode(raw, "ISO-8859-1"), "".join(a for a, _ in UPPER), "".join(b for _, b in UPPER))
    text = F.when(label.isin(*WESTERN), western).when(codec.isNotNull(), _by_codec(F.when(codec.isNotNull(), raw), codec)).otherwise(F.make_valid_utf8(raw.cast("string")))
    return F.regexp_replace(text, "^\ufeff", "")


def resolved(href: Column, base: Column) -> Column:
    """An address as seen from a page, without its fragment and with dots taken out of its path; null if it is neither http nor https."""
    def joined(x: Column) -> Column:
        href, origin, path = x["href"], x["origin"], x["path"]
        return (
            F.when(origin == "", F.lit(None))
            .when(href.rlike("(?i)^https?://"), href)
            .when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
            .when(href.startswith("//"), F.concat(F.regexp_extract(origin, "^[^:]+:", 0), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("?"), F.concat(origin, path, href))
            .when(href == "", F.concat(origin, path, x["query"]))
            .otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), F.when(path == "", "/").otherwise(""), href))
        )

    def walked(x: Column) -> Column:
        step = lambda done, y: F.when(y == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(y == ".", done).otherwise(F.array_append(done, y))
        names = F.split(F.substring(x["path"], 2, 1 << 30), "/")
        tail = lambda left: F.when(F.element_at(names, -1).isin(".", "..") & (F.size(left) > 0), "/").otherwise("")
        ended = bound(F.aggregate(names, F.array().cast("array<string>"), step), lambda left: F.concat(F.array_join(left, "/"), tail(left)))
        return F.concat(F.lower(x["origin"]), F.lit("/"), ended, x["query"])

    pieces = lambda c: {n: F.regexp_extract(c, r"(?i)^(https?://[^/?#]+)?([^?#]*)(\?[^#]*)?", i).alias(n) for i, n in ((1, "origin"), (2, "path"), (3, "query"))}
    seen = F.struct(*pieces(base).values(), F.regexp_replace(F.trim(href), "#.*$", "").alias("href"))
    whole = bound(seen, joined)
    return bound(bound(whole, lambda c: F.struct(*pieces(c).values())), lambda x: F.when(x["origin"] != "", walked(x)))


def forwarded_to(html: Column, url: Column) -> Column:
    """Where a page sends its reader at once (within ten seconds) on the same host, else null; the first such tag decides, if it leads elsewhere."""
    tags = F.regexp_extract_all(F.left(html, F.lit(20000)), F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    content = lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, rf"(?i)content\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"])
    form = r"""(?i)^\s*(\d+(?:\.\d+)?)\s*[;,]\s*url\s*=\s*['"]?([^'"\s]+)"""
    sends = lambda t: t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh""") & (F.regexp_extract(content(t), form, 1).try_cast("double") <= 10)
    target = resolved(bound(F.try_element_at(F.filter(tags, sends), F.lit(1)), lambda t: F.regexp_extract(content(t), form, 2)), url)
    host = lambda c: F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return bound(target, lambda t: F.when((host(t) == host(url)) & (t != resolved(url, url)), t))
