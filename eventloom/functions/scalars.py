"""Scalar functions on columns: text, URLs, dates, places. All stay in the JVM but ``nfkc``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
HALF = "".join(chr(c - 0xFEE0) for c in map(ord, FULL))
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in map(ord, HIRAGANA))
SPACE = r"[\s　 ]+"
#: A character of white space as browsers count it.
WHITE = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# What two spellings of a title may differ in, in this order.
SPELLINGS = [
    (r"[（(][^）)]*[）)]", ""),
    (r"[［\[【][^］\]】]*[］\]】]", ""),
    (r"[\s　・|｜/／&＆!！?？.。、,，:：~〜～\-－]", ""),
    ("陸上自衛隊|海上自衛隊|航空自衛隊|自衛隊", ""),
    ("部隊見学", "見学"),
]
# Query parameters that only track.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref".split()


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def fold_kana(c: Column) -> Column:
    return F.lower(F.translate(c, HIRAGANA, KATAKANA))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


#: Steps that are tried by one pattern before they are taken one by one.
GROUP = 8


def _signs(parsed: Iterable, folded: bool) -> str | None:
    """Of a parsed pattern a class of characters one of which is in every match; None if there is none."""
    found: list[str] = []
    for op, arg in parsed:
        name, own = str(op), None
        if name == "LITERAL":
            own = "".join({f"\\x{{{ord(c):x}}}" for c in (chr(arg).lower() + chr(arg).upper() if folded else chr(arg))})
        elif name == "IN" and str(arg[0][0]) != "NEGATE":
            parts = [_signs([x], folded) if str(x[0]) == "LITERAL" else _range(x, folded) for x in arg]
            own = None if None in parts else "".join(parts)
        elif name == "SUBPATTERN":
            own = _signs(arg[3], folded or bool(arg[1] & re.IGNORECASE))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0]:
            own = _signs(arg[2], folded)
        elif name == "BRANCH":
            parts = [_signs(x, folded) for x in arg[1]]
            own = None if None in parts else "".join(parts)
        if own:
            found.append(own)
    # the fewest; of single ones the last in Unicode, as kanji are rarer than kana and letters
    return min(found, key=lambda x: (x.count("\\"), [-int(h, 16) for h in re.findall(r"x\{(\w+)\}", x)]), default=None)


def _range(item: tuple, folded: bool) -> str | None:
    kinds = {"CATEGORY_SPACE": r"\s", "CATEGORY_DIGIT": r"\d"}
    if str(item[0]) == "CATEGORY":
        return kinds.get(str(item[1]))
    return None if folded else "\\x{{{:x}}}-\\x{{{:x}}}".format(*item[1])


@cache
def signs(pattern: str) -> str | None:
    """A class of characters, one of which every text has that has the pattern; None if none can be told."""
    plain = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), pattern)  # code points in braces are no escapes of Python's
    try:
        parsed = re._parser.parse(plain)
    except re.error:
        return None
    return _signs(parsed, bool(parsed.state.flags & re.IGNORECASE))


def may_have(c: Column, patterns: Iterable[str]) -> Column:
    """False only for texts that have none of some patterns, by one look at their characters."""
    classes = [signs(p) for p in patterns]
    return F.lit(True) if None in classes else c.rlike(f"[{''.join(classes)}]")


def has_any(c: Column, tests: Sequence[tuple[str, str | None]]) -> Column:
    """Whether a text has a pattern, and not the one beside it that saves it; a group of patterns that it cannot have is passed over."""

    def hit(p: str, unless: str | None) -> Column:
        return c.rlike(p) & ~c.rlike(unless) if unless else c.rlike(p)

    groups = [tests[i : i + GROUP] for i in range(0, len(tests), GROUP)]
    return reduce(lambda a, b: a | b, [may_have(c, [p for p, _ in g]) & reduce(lambda a, b: a | b, [hit(*x) for x in g]) for g in groups])


def replaced_all(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """A text after some replacements (pattern, replacement) in order. A group of them none of whose patterns the text can have would leave it, and is passed over."""

    def group(some: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
        return lambda t: F.when(may_have(t, [p for p, _ in some]), reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), some, t)).otherwise(t)

    for i in range(0, len(steps), GROUP):
        c = bound(c, group(steps[i : i + GROUP]))
    return c


def decoded_url(c: Column) -> Column:
    """A URL without its escapes, or as it is if they are broken; most have none."""
    return F.when(c.rlike("[%+]"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space, the ideographic included, to one blank; trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def blank_to_null(c: Column) -> Column:
    """Null, blank, and the words null and undefined are no values."""
    t = squeeze(c)
    return F.when(~F.lower(t).isin("", "null", "undefined"), c)


def dedup_key(c: Column) -> Column:
    """A title without brackets and what stands in them, marks and spaces, and the words that spellings leave out."""
    return replaced_all(half_width(c), SPELLINGS)


def safe_url(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""))
    return F.when(t.rlike("(?i)^https?://"), t).otherwise("")


def normal_url(c: Column) -> Column:
    """Without fragment, tracking parameters and a closing slash; parameters in order."""
    bare = F.regexp_replace(c, "#.*$", "")
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING)))
    path = F.regexp_replace(base, "/+$", "")
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


def compare_url(c: Column) -> Column:
    """Host in lower case, path without index page and closing slash, query; '' if no web address."""
    host = F.lower(F.regexp_extract(c, r"(?i)^https?://([^/?#:]+)", 1))
    rest = F.regexp_replace(F.regexp_extract(c, r"(?i)^https?://[^/?#]+([^?#]*)", 1), r"(?i)/index\.html?$", "/")
    query = F.regexp_extract(c, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(c.rlike("(?i)^https?://"), F.concat(host, F.regexp_replace(rest, "/+$", ""), query)).otherwise("")


def url_basename(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?i)/([^/?#]+)\.(?:pdf|jpe?g|png|gif|webp)(?:[?#]|$)", 1))


def html_digest(c: Column) -> Column:
    """SHA-256 of a page without scripts, styles, comments and runs of white space."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    return F.sha2(F.trim(F.regexp_replace(t, r"\s+", " ")).cast("binary"), 256)


def short_hash(c: Column) -> Column:
    """Five base-36 digits of a 32-bit hash (h * 33 xor unit) over the text's UTF-16 units."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    count = F.char_length(units) / 4
    starts = F.when(count >= 1, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    points = F.transform(starts, lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    h = F.aggregate(points, F.lit(5381).cast("long"), lambda a, x: ((a * 33) % 4294967296).bitwiseXOR(x))
    return F.right(F.concat(F.lit("00000"), F.lower(F.conv(h.cast("string"), 10, 36))), F.lit(5))


def clean_field(c: Column, most: int) -> Column:
    """Without control, zero-width and direction characters; line breaks and runs of white space are one blank; angle brackets widened; cut."""
    t = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\r\n\t]+", " "), WHITE + "{2,}", " ")
    t = F.regexp_replace(t, f"^{WHITE}+|{WHITE}+$", "")
    return F.substring(F.translate(t, "<>", "＜＞"), 1, most)


def mask_contact(c: Column) -> Column:
    """A mail address keeps two characters and its host, another text two at each end; up to four characters are all stars."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), f"^{WHITE}+|{WHITE}+$", "")
    size, at = F.char_length(t), F.instr(t, "@")
    mail = F.concat(F.left(t, F.least(F.lit(2), at - 1)), F.repeat(F.lit("*"), F.greatest(F.lit(1), at - 3)), F.substr(t, at))
    other = F.concat(F.left(t, F.lit(2)), F.repeat(F.lit("*"), size - 4), F.right(t, F.lit(2)))
    return F.when(at > 1, mail).when(size <= 4, F.repeat(F.lit("*"), size)).otherwise(other)


def escape_html(c: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_ics(c: Column) -> Column:
    pairs = [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c)


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def repeated_phrase(c: Column, least: int = 6, most: int = 12) -> Column:
    """Whether a phrase of that many characters comes twice; white space does not count."""
    return F.regexp_replace(c, f"{WHITE}+", "").rlike(rf"(?s)(.{{{least},{most}}}).*\1")


def degraded(before: Column, now: Column, least: int = 4) -> Column:
    """Whether ``now`` is ``before`` without one or two characters of its middle; white space does not count, short texts never do."""
    a, b = (F.regexp_replace(F.coalesce(x, F.lit("")), f"{WHITE}+", "") for x in (before, now))
    gap = F.char_length(a) - F.char_length(b)
    ends = (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.right(a, F.lit(1)) == F.right(b, F.lit(1)))
    cut = a.startswith(b) | a.endswith(b)
    return (F.char_length(a) >= least) & (b != "") & gap.between(1, 2) & (F.levenshtein(a, b) == gap) & ends & ~cut


def names_label(names: Column, shown: int) -> Column:
    """The first names and how many others there are."""
    own = F.array_distinct(names)
    head = F.array_join(F.slice(own, 1, shown), "・")
    return F.when(F.size(own) > shown, F.concat(head, F.lit(" ほか"), (F.size(own) - shown).cast("string"), F.lit("拠点"))).otherwise(head)


def real_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def tokyo_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))


def weekday(d: Column) -> Column:
    return F.substring(F.lit("日月火水木金土"), F.dayofweek(d), F.lit(1))


def year_by_weekday(month: Column, day: Column, name: Column, this_year: Column) -> Column:
    """This or the next year, whichever has that weekday; this year without a weekday or if neither has."""
    named = lambda y: weekday(F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")) == name
    return F.when(name.isNull(), this_year).when(named(this_year), this_year).when(named(this_year + 1), this_year + 1).otherwise(this_year)


def era_year(era: Column, n: Column) -> Column:
    """令和 1 is 2019, 平成 1 is 1989; 元 is 1."""
    number = F.when(n.cast("string") == "元", 1).otherwise(n.cast("string").try_cast("int"))
    return F.when(era == "令和", number + 2018).when(era == "平成", number + 1988)


def year_before(c: Column) -> Column:
    """The same day's text a year earlier; 29 February stays as text."""
    return F.concat(F.lpad((F.left(c, F.lit(4)).cast("int") - 1).cast("string"), 4, "0"), F.substr(c, F.lit(5)))


def weekend_start(d: Column) -> Column:
    """The Saturday of this weekend (yesterday on a Sunday)."""
    return F.when(F.dayofweek(d) == 1, F.date_sub(d, 1)).otherwise(F.date_add(d, F.lit(7) - F.dayofweek(d)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, which Spark lacks: a pandas UDF over Arrow batches."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return run(c)
