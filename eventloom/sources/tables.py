"""Readers: parquet tables, and nested JSON snapshots of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event row; every column of a snapshot that is not listed is ignored.
EVENT = (
    "id string, date string, endDate string, title string, place string, address string, time string, category string, tag string, "
    "url string, notes string, deadline string, deadlineDate string, status string, statusReason string, source_type string, firstSeen string, "
    "weatherLocation struct<latitude double, longitude double, label string, accuracy string, source string, geocodedAt string>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; timestamps without a zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pref, pos, event columns) of a file ``{pref: [event, ...], updatedAt: text}``; a damaged file gives none.

    One file is one JSON document and hence one task's work; several files are read in parallel.
    """
    raw = spark.read.text(path, wholetext=True)
    fields = [x.split(" ")[0] for x in EVENT.replace("struct<latitude double, longitude double, label string, accuracy string, source string, geocodedAt string>", "struct").split(", ")]
    parsed = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("pref", "body")).where(F.col("pref") != "updatedAt")
    rows = parsed.select("pref", F.posexplode(F.from_json("body", f"array<struct<{EVENT.replace(' struct<', ':struct<', 1)}>>")).alias("pos", "event"))
    return rows.select("pref", "pos", *[F.col(f"event.{f}").alias(f) for f in fields])
