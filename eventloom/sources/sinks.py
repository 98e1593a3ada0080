"""Writers: snapshots by partition, safe CSV, calendars, linked data, bounded archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalars import escape_ics, safe_cell
from eventloom.operators.entities import priority_union


def write_snapshot(events: DataFrame, path: str, by: str = "pref") -> None:
    """JSON lines in a folder per partition value: no group is gathered in one row."""
    events.write.mode("overwrite").partitionBy(by).json(path)


def csv_cell(c: str) -> Column:
    """A cell as text: quoted where needed, never read as a formula."""
    t = safe_cell(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(c) for c in columns]).alias("line"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    csv_lines(df, columns).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def ics(uid: Column, start: Column, end: Column, title: Column, place: Column) -> Column:
    """A VEVENT of whole days; its end is exclusive."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(start)), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add(F.coalesce(end, start), 1))), F.concat(F.lit("SUMMARY:"), escape_ics(title)), F.concat(F.lit("LOCATION:"), escape_ics(F.coalesce(place, F.lit("")))), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *lines)


def json_ld(title: Column, start: Column, end: Column, place: Column, url: Column) -> Column:
    body = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), title.alias("name"), start.alias("startDate"), F.coalesce(end, start).alias("endDate"), F.struct(F.lit("Place").alias("@type"), place.alias("name")).alias("location"), url.alias("url")))
    return F.replace(body, F.lit("<"), F.lit("\\u003c"))


def archive(old: DataFrame, new: DataFrame, id_: str, day: str, since: str | None, most: int) -> DataFrame:
    """The union where the latest version of an id wins, back to a day, the newest ``most`` rows."""
    rows = priority_union([old, new], id_)
    kept = rows.where(F.col(day) >= since) if since else rows
    return kept.orderBy(F.col(day).desc(), id_).limit(most)
