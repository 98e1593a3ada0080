"""Dates, deadlines and times said in Japanese text, resolved against a given day. All in the JVM; days are texts YYYY-MM-DD."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.scalars import bound, half_width, real_date, replaced_all, squeeze, weekday
from eventloom.functions.titles import NO_TEXT, half_marks, separators

# Words before a date without a year and weekday that make it one; a weekday in brackets; English weekdays.
LABEL = r"(?:日\s{0,2}時|日\s{0,2}程|開催日|実施日|開催|期日|とき|開\s{0,2}催)"
NAMED = r"(?:\s*[（(]([月火水木金土日祝・\s]+)[）)])?"
FAMILIES = [
    (rf"(令和|平成)\s*(元|\d{{1,2}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日{NAMED}", 1, 2, 3, 4, 5),
    (rf"(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日{NAMED}", None, 1, 2, 3, 4),
    (rf"(\d{{4}})\s*[/.\-]\s*(\d{{1,2}})\s*[/.\-]\s*(\d{{1,2}}){NAMED}", None, 1, 2, 3, 4),
    (rf"(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日{NAMED}", None, None, 1, 2, 3),
]
#: A date with slash or full stop counts with its weekday, or up to 14 characters behind a label.
SLASHED = r"(\d{1,2})\s*[/.]\s*(\d{1,2})(?!\s*[\d/.])"
SLASHED_NAMED = SLASHED + r"\s*[（(]([月火水木金土日祝・\s]+)[）)]"
SLASHED_LABELLED = rf"(?<={LABEL}[\s\S]{{0,12}}){SLASHED}(?!\s*[（(][月火水木金土日祝])"
ENGLISH = {"sun": "日", "mon": "月", "tue": "火", "wed": "水", "thu": "木", "fri": "金", "sat": "土"}
# Eras by the year before their first.
ERAS = {"令和": 2018, "平成": 1988}
#: Days before and after today within which a date without year and weekday may lie.
PAST, AHEAD = 7, 200
# What is replaced in a time, in this order, before and after halves of the day are added.
TIME_BEFORE = [
    (r"^\d{1,2}\s*[/／.]\s*\d{1,2}\s*[（(][月火水木金土日祝・]{1,3}[）)]?\s*", ""),
    (r"[（(][^）)]*(?:受付|開場|開演)[^）)]*[）)]", ""),
    (r"[…‥][^、,]*受付[^、,]*", ""),
    (r"\s*※.*$", ""),
    (r"午前\s*(\d{1,2})\s*時", "$1時"),
    (r"午前\s*(\d{1,2})(:\d{2})", "$1$2"),
]
TIME_AFTER = [
    (r"(\d{1,2})\s*時\s*(\d)\s*分", "$1:0$2"),
    (r"(\d{1,2})\s*時\s*(\d{2})\s*分", "$1:$2"),
    (r"(\d{1,2})\s*時半", "$1:30"),
    (r"(\d{1,2})\s*時", "$1:00"),
    (r"\s*から\s*", "～"),
    (r"[〜~－―—]", "～"),
    (r"(?<=\d)\s*-\s*(?=\d)", "～"),
    (r"(?<![\d:])([01]\d|2[0-3])([0-5]\d)(?![\d:])", "$1:$2"),
    (r"(?<![\d:])(\d):(\d{2})", "0$1:$2"),
    (r"[\s、,]*[①-⑳][\s、,]*", "／"),
    (r"[\s、,]*第[一二三四五1-5]部[\s、,]*", "／"),
    (r"(\d{2}:\d{2})\s*[、,]\s*(?=\d{1,2}:\d{2})", "$1／"),
    (r"／{2,}", "／"),
    (r"^／+", ""),
    (r"\s+", " "),
    (r"\s*～\s*", "～"),
    (r"^[、,～\s]+|[、,\s～／]+$", ""),
]


def day_text(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null if there is no such day."""
    return bound(F.format_string("%04d-%02d-%02d", year, month, day), lambda text: F.when(real_date(text), text))


def day_name(day: Column) -> Column:
    return weekday(F.try_to_date(day, "yyyy-MM-dd"))


def era_number(n: Column) -> Column:
    return F.when(n == "元", 1).otherwise(n.try_cast("int"))


def first_name(c: Column) -> Column:
    """The first weekday of a text such as 土・日; '' if none."""
    return F.coalesce(F.regexp_extract(c, "([月火水木金土日])", 1), F.lit(""))


def likely_year(month: Column, day: Column, name: Column, today: Column) -> Column:
    """This or the next year, by the weekday if one is given, and else within the window around today; null if neither fits."""
    year = F.left(today, F.lit(4)).cast("int")

    def fits(y: Column) -> Column:
        text = day_text(y, month, day)
        away = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), today.cast("date"))
        return F.coalesce(F.when(name != "", day_name(text) == name).otherwise(away.between(-PAST, AHEAD)), F.lit(False))

    return F.when(fits(year), year).when(fits(year + 1), year + 1)


def mentions(text: Column) -> Column:
    """array<struct<year, month, day, name>> of all dates that a text says, surest forms first."""
    t = separators(half_marks(F.coalesce(text, F.lit(""))))

    def family(pattern: str, era: int | None, year: int | None, month: int, day: int, name: int) -> Column:
        def one(raw: Column) -> Column:
            take = lambda i: F.regexp_extract(raw, pattern, i)
            y = F.lit(None).cast("int") if year is None else take(year).try_cast("int")
            if era:
                y = F.when(take(era) == "令和", ERAS["令和"]).otherwise(ERAS["平成"]) + era_number(take(year))
            return F.struct(y.alias("year"), take(month).cast("int").alias("month"), take(day).cast("int").alias("day"), first_name(take(name)).alias("name"))

        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one)

    def slashed(pattern: str, named: bool) -> Column:
        def one(raw: Column) -> Column:
            take = lambda i: F.regexp_extract(raw, SLASHED_NAMED if named else SLASHED, i)
            name = first_name(take(3)) if named else F.lit("")
            return F.struct(F.lit(None).cast("int").alias("year"), take(1).cast("int").alias("month"), take(2).cast("int").alias("day"), name.alias("name"))

        return F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one), lambda x: x["month"].between(1, 12) & x["day"].between(1, 31))

    return F.concat(*[family(*f) for f in FAMILIES], slashed(SLASHED_NAMED, True), slashed(SLASHED_LABELLED, False))


def resolved(mention: Column, today: Column, past: bool = False) -> Column:
    year = F.coalesce(mention["year"], likely_year(mention["month"], mention["day"], mention["name"], today))
    text = day_text(year, mention["month"], mention["day"])
    return text if past else F.when(text >= today, text)


def first_date(text: Column, today: Column, past: bool = False) -> Column:
    """The first date of a text that can be resolved, broken or past ones passed over."""
    days = F.filter(F.transform(mentions(text), lambda m: resolved(m, today, past)), lambda d: d.isNotNull())
    return F.get(days, F.lit(0))


def weekday_conflict(text: Column, day: Column) -> Column:
    """Whether a text names weekdays with that month and day, and none of them is the day's own."""
    same = F.filter(mentions(text), lambda m: (m["name"] != "") & (m["month"] == F.month(day.cast("date"))) & (m["day"] == F.dayofmonth(day.cast("date"))))
    return (F.size(same) > 0) & ~F.exists(same, lambda m: m["name"] == day_name(day))


def deadline(text: Column, event: Column) -> Column:
    """struct(date, has_year, reliable): without a year the last such day up to the event's; a wrong weekday is not reliable."""
    t = squeeze(half_width(F.coalesce(text, F.lit(""))))
    none = t.rlike("(?i)^(なし|null|未定|なし。)?$")
    name = F.regexp_extract(t, r"[（(]\s*([日月火水木金土祝])\s*[）)]", 1)
    tail = r"\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?"
    forms = [(rf"(?i)(?:令和|R)\s*(元|\d{{1,2}}){tail}", 2018), (rf"平成\s*(元|\d{{1,2}}){tail}", 1988), (rf"(20\d{{2}}){tail}", 0)]
    part = lambda p, i: F.regexp_extract(t, p, i)
    bare = r"(\d{1,2})\s*月\s*(\d{1,2})\s*日?"
    month, day = part(bare, 1).try_cast("int"), part(bare, 2).try_cast("int")
    own = F.left(event, F.lit(4)).try_cast("int")
    this = day_text(own, month, day)
    loose = F.when(real_date(event), F.when(this > event, day_text(own - 1, month, day)).otherwise(this))
    date = reduce(lambda rest, f: F.when(t.rlike(f[0]), day_text(era_number(part(f[0], 1)) + f[1], part(f[0], 2).try_cast("int"), part(f[0], 3).try_cast("int"))).otherwise(rest), reversed(forms), loose)
    date = F.when(~none, date)
    dated = reduce(lambda a, b: a | b, [t.rlike(p) for p, _ in forms])
    right = (name == "") | (name == "祝") | (day_name(date) == name)
    return F.struct(date.alias("date"), (date.isNotNull() & dated).alias("has_year"), (date.isNotNull() & F.coalesce(right, F.lit(False))).alias("reliable"))


def shown_deadline(text: Column, today: Column) -> Column:
    """The day of M月D日 this year, or next year if it is more than 30 days past."""
    month, day = (F.regexp_extract(text, r"(\d+)月(\d+)日", i).try_cast("int") for i in (1, 2))
    year = F.left(today, F.lit(4)).cast("int")
    this = F.try_to_date(day_text(year, month, day), "yyyy-MM-dd")
    return F.when(F.datediff(today.cast("date"), this) > 30, day_text(year + 1, month, day)).otherwise(day_text(year, month, day))


def clean_time(text: Column) -> Column:
    """HH:MM～HH:MM, parts joined by ／; '' for texts without a time."""
    t = F.translate(F.trim(text), "０１２３４５６７８９", "0123456789")
    whole = t == "終日"
    afternoon = [(rf"午後\s*0?{h}(?=\s*時|:\d{{2}})", str(h % 12 + 12)) for h in range(1, 13)]
    t = replaced_all(replaced_all(replaced_all(t, TIME_BEFORE), afternoon), TIME_AFTER)
    return F.when(F.trim(text).rlike(NO_TEXT) | text.isNull(), "").when(whole, "終日").when(~F.translate(text, "０１２３４５６７８９", "0123456789").rlike(r"\d"), "").otherwise(t)


def clean_deadline(text: Column) -> Column:
    """7/8 wed. becomes 7月8日（水）; texts that stand for none are ''."""
    t, form = F.trim(text), r"(?i)^0?(\d{1,2})/0?(\d{1,2})\s*(sun|mon|tue|wed|thu|fri|sat)?\.?$"
    name = F.lower(F.regexp_extract(t, form, 3))
    shown = reduce(lambda rest, n: F.when(name == n[0], f"（{n[1]}）").otherwise(rest), ENGLISH.items(), F.lit(""))
    date = F.concat(F.regexp_extract(t, form, 1), F.lit("月"), F.regexp_extract(t, form, 2), F.lit("日"), shown)
    return F.when(text.isNull() | t.rlike(NO_TEXT), "").when(t.rlike(form), date).otherwise(t)


def time_range(text: Column) -> Column:
    """struct(start, end) of HH:MM～HH:MM whose end is after its start, else null."""
    form = r"^(\d{1,2}):(\d{2})\s*[～~〜\-–—]\s*(\d{1,2}):(\d{2})$"
    a, b, c, d = (F.regexp_extract(F.trim(text), form, i).try_cast("int") for i in range(1, 5))
    good = (a <= 23) & (c <= 23) & (b <= 59) & (d <= 59) & (c * 60 + d > a * 60 + b)
    return F.when(good, F.struct(F.format_string("%02d:%02d", a, b).alias("start"), F.format_string("%02d:%02d", c, d).alias("end")))


def plain_date(text: Column) -> Column:
    """YYYY-MM-DD of a date in one of the written forms, else null."""
    t = F.translate(F.trim(text), "０１２３４５６７８９", "0123456789")
    out = F.lit(None).cast("string")
    for form, base in ((r"^令和\s*(\d{1,2})年\s*(\d{1,2})月\s*(\d{1,2})日", 2018), (r"^(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", 0), (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 0)):
        y, m, d = (F.regexp_extract(t, form, i).try_cast("int") for i in (1, 2, 3))
        out = F.when(t.rlike(form), day_text(y + base, m, d)).otherwise(out)
    return out


def future_marks(text: Column, today: Column) -> Column:
    """How many different days from today on a text says; without a year, the next such day if this year's is over half a year past."""
    t = half_width(F.coalesce(text, F.lit("")))
    era, west, bare = r"令和\s*(?:元|\d{1,2})\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", r"20\d{2}\s*[年/.]\s*\d{1,2}\s*[月/.]\s*\d{1,2}(?:\s*日)?", r"(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    ints = lambda raw: F.transform(F.regexp_extract_all(raw, F.lit(r"元|\d+"), F.lit(0)), era_number)

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))

    dated = lambda base: lambda raw: iso(ints(raw)[0] + base, ints(raw)[1], ints(raw)[2])
    year = F.left(today, F.lit(4)).cast("int")

    def loose(raw: Column) -> Column:
        m, d = ints(raw)[0], ints(raw)[1]
        this = iso(year, m, d)
        gone = F.datediff(today.cast("date"), F.try_to_date(this, "yyyy-MM-dd")) > 180
        return F.when(this >= today, this).when(gone, iso(year + 1, m, d))

    rest = F.regexp_replace(F.regexp_replace(t, era, " "), west, " ")
    every = F.concat(F.transform(F.regexp_extract_all(t, F.lit(era), F.lit(0)), dated(2018)), F.transform(F.regexp_extract_all(t, F.lit(west), F.lit(0)), dated(0)), F.transform(F.regexp_extract_all(rest, F.lit(bare), F.lit(0)), loose))
    return F.size(F.array_distinct(F.filter(every, lambda x: x >= today)))


# Forms of a date in lists of a site, the first that is found decides; one weekday in brackets behind it.
ONE_NAME = r"(?:[（(]\s*([月火水木金土日祝])\s*[）)])?"
LISTED_ERAS = {
    "令和": rf"(?i)(?:令和|R)\s*(元|\d{{1,2}})\s*年?\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日?{ONE_NAME}",
    "平成": rf"平成\s*(元|\d{{1,2}})\s*年?\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日?{ONE_NAME}",
}
LISTED_WESTERN = rf"(20\d{{2}})\s*[年/.\-]\s*(\d{{1,2}})\s*(?:月|[/.\-])\s*(\d{{1,2}})\s*日?{ONE_NAME}"
LISTED_SHORT = rf"(?:^|[^\d])(\d{{1,2}})\s*[月/.]\s*(\d{{1,2}})\s*日?{ONE_NAME}"
# Years in a heading, with a mark if they are fiscal ones, which begin in April.
HEADING_WESTERN, HEADING_ERA = r"(20\d{2})\s*年(度)?", r"令和\s*(元|\d{1,2})\s*年(度)?"


def heading_year(text: Column) -> Column:
    """struct<year, fiscal> that a heading sets for what follows; null if it names no year."""
    t = half_width(text)
    found = lambda p, year: F.struct(year.alias("year"), (F.regexp_extract(t, p, 2) != "").alias("fiscal"))
    western = found(HEADING_WESTERN, F.regexp_extract(t, HEADING_WESTERN, 1).try_cast("int"))
    era = found(HEADING_ERA, ERAS["令和"] + era_number(F.regexp_extract(t, HEADING_ERA, 1)))
    return F.when(t.rlike(HEADING_WESTERN), western).when(t.rlike(HEADING_ERA), era)


def listed_date(text: Column, today: Column, context: Column | None = None) -> Column:
    """struct<date, name> of a list's entry; null if it is no day, past, or not the weekday that it says.

    With a context (struct<year, fiscal>, either of them null) a date without a year takes the heading's
    year, or that of today, and in a fiscal year January to March fall into the next one. Without a
    context it takes this or the next year by its weekday. The name is the one said, else the day's own.
    """
    this = F.left(today, F.lit(4)).cast("int")

    def agrees(y: Column, s: Column) -> Column:
        return F.coalesce(day_name(day_text(y, s["month"], s["day"])) == s["name"], F.lit(False))

    def short(s: Column) -> Column:
        told = s["name"].isin("", "祝")
        if context is None:
            year = F.when(told | agrees(this, s), this).when(agrees(this + 1, s), this + 1)
        else:
            next_ = F.when(F.coalesce(context["fiscal"], F.lit(False)) & (s["month"] <= 3), 1).otherwise(0)
            year = bound(F.coalesce(context["year"], this) + next_, lambda y: F.when(told | agrees(y, s), y))
        return F.struct(year.alias("year"), s["month"].alias("month"), s["day"].alias("day"), s["name"].alias("name"))

    def parts(t: Column) -> Column:
        part = lambda p, i: F.regexp_extract(t, p, i)
        rest = lambda p, i: [part(p, i).cast("int").alias("month"), part(p, i + 1).cast("int").alias("day"), part(p, i + 2).alias("name")]
        out = F.when(t.rlike(LISTED_SHORT), bound(F.struct(*rest(LISTED_SHORT, 1)), short))
        western = F.struct(part(LISTED_WESTERN, 1).try_cast("int").alias("year"), *rest(LISTED_WESTERN, 2))
        out = F.when(t.rlike(LISTED_WESTERN), western).otherwise(out)
        for era, p in reversed(LISTED_ERAS.items()):
            out = F.when(t.rlike(p), F.struct((ERAS[era] + era_number(part(p, 1))).alias("year"), *rest(p, 2))).otherwise(out)
        return out

    def built(s: Column) -> Column:
        name = lambda day: F.coalesce(F.nullif(s["name"], F.lit("")), day_name(day))
        return bound(day_text(s["year"], s["month"], s["day"]), lambda day: F.when(day >= today, F.struct(day.alias("date"), name(day).alias("name"))))

    # each step is a value that the next one reads: the text is cleaned once and its day built once, whatever the pattern
    return bound(half_width(squeeze(F.coalesce(text, F.lit("")))), lambda t: bound(parts(t), built))
