"""Rows out of page texts: bracketed fields, recurring and listed days, links of a site map, zipped readings. All in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.dates import day_text
from eventloom.functions.scalars import bound, half_width

# The names under which a field stands in brackets; weekdays from Monday.
FIELDS = {"日時": "date", "開催日": "date", "日程": "date", "場所": "place", "会場": "place", "時間": "time", "締切": "deadline", "申込締切": "deadline", "対象": "age", "内容": "notes"}
WEEKDAYS = "月火水木金土日"


def bracket_fields(text: Column, names: dict[str, str] | None = None) -> Column:
    """map(field, value) of 【name】value in a text; the first value of a field counts."""
    names = names or FIELDS
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"【([^】]+)】[^【]*"), F.lit(0))
    pairs = F.transform(parts, lambda p: F.struct(F.try_element_at(known, F.trim(F.regexp_extract(p, r"【([^】]+)】", 1))).alias("k"), F.trim(F.regexp_extract(p, r"】([^【]*)", 1)).alias("v")))
    sound = F.filter(pairs, lambda x: x["k"].isNotNull() & (x["v"] != ""))
    first = F.aggregate(sound, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))
    return first


def recurring(text: Column, year: Column) -> Column:
    """array of days for 10月(毎週月・木): every such weekday of the month."""
    t = half_width(F.coalesce(text, F.lit("")))
    form = r"(\d{1,2})月\s*[（(]毎週([月火水木金土日・、,]+)(?:曜日?)?[）)]"
    month = F.regexp_extract(t, form, 1).try_cast("int")
    names = F.regexp_extract(t, form, 2)
    first = F.try_to_date(day_text(year, month, F.lit(1)), "yyyy-MM-dd")
    days = F.when(first.isNotNull(), F.sequence(first, F.last_day(first))).otherwise(F.array().cast("array<date>"))
    hit = F.filter(days, lambda d: names.contains(F.substring(F.lit(WEEKDAYS), F.weekday(d) + 1, F.lit(1))))
    return F.transform(hit, lambda d: F.date_format(d, "yyyy-MM-dd"))


def listed_days(text: Column, year: Column) -> Column:
    """array of days of 12月4日、5日、6日: a day without a month has that of the one before."""
    t = half_width(F.coalesce(text, F.lit("")))
    parts = F.regexp_extract_all(t, F.lit(r"(?:\d{1,2}月)?\d{1,2}日"), F.lit(0))
    zero = F.struct(F.lit(None).cast("int").alias("month"), F.array().cast("array<string>").alias("days"))

    def step(a: Column, p: Column) -> Column:
        month = F.coalesce(F.regexp_extract(p, r"(\d{1,2})月", 1).try_cast("int"), a["month"])
        day = day_text(year, month, F.regexp_extract(p, r"(\d{1,2})日", 1).try_cast("int"))
        return F.struct(month.alias("month"), F.when(day.isNotNull(), F.array_append(a["days"], day)).otherwise(a["days"]).alias("days"))

    return F.aggregate(parts, zero, step)["days"]


def day_spans(text: Column, year: Column) -> Column:
    """array<struct<date, end>>: two days joined by a wave are one span, listed ones are one each."""
    wave = half_width(F.coalesce(text, F.lit(""))).rlike(r"日\s*(?:[（(][^）)]*[）)])?\s*[〜~～]\s*(?:\d{1,2}月)?\d{1,2}日")

    def spans(days: Column) -> Column:
        one = F.array(F.struct(F.get(days, F.lit(0)).alias("date"), F.get(days, F.lit(1)).alias("end")))
        return F.when((F.size(days) == 2) & wave, one).otherwise(F.transform(days, lambda d: F.struct(d.alias("date"), F.lit(None).cast("string").alias("end"))))

    return bound(listed_days(text, year), spans)


def locations(xml: Column) -> Column:
    """All <loc> values of a site map."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def zipped(rows: DataFrame, arrays: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """A struct of arrays as rows, as long as the longest: shorter ones end in nulls, scalars are repeated."""
    return rows.select(*scalars, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_x")).select(*scalars, "pos", *[F.col(f"_x.{a}").alias(a) for a in arrays])


def averaged(points: DataFrame, key: Sequence[str], values: Sequence[str], digits: int = 5) -> DataFrame:
    """Points of one name as their mean, rounded."""
    return points.groupBy(*key).agg(*[F.round(F.avg(v), digits).alias(v) for v in values])


def by_date(rows: DataFrame, series: DataFrame, id_: str, date: str, dates: str, values: Sequence[str]) -> DataFrame:
    """Of parallel arrays (dates, values) per id, the values of a row's own date; null where it is not there."""
    at = F.array_position(F.col(f"s.{dates}"), F.col(f"r.{date}")).cast("int")
    both = rows.alias("r").join(series.alias("s"), F.col(f"r.{id_}") == F.col(f"s.{id_}"), "left")
    return both.select(*[F.col(f"r.{c}") for c in rows.columns], *[F.when(at > 0, F.get(F.col(f"s.{v}"), at - 1)).alias(v) for v in values])


def month_groups(rows: DataFrame, date: str) -> DataFrame:
    """(label, place, n): rows by month, the undated ones last."""
    month = F.left(F.col(date), F.lit(7))
    counts = rows.groupBy(F.nullif(month, F.lit("")).alias("_m")).agg(F.count("*").alias("n"))
    label = F.concat(F.left("_m", F.lit(4)), F.lit("年"), F.substring("_m", 6, 2).cast("int").cast("string"), F.lit("月"))
    return counts.select(F.coalesce(label, F.lit("日程未定")).alias("label"), F.coalesce("_m", F.lit("9999-99")).alias("place"), "n")


def base_id(c: Column) -> Column:
    """An id without the suffix that tells repeats apart."""
    return F.regexp_replace(c, r"~\d+$", "")
