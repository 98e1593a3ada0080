"""Ordered operators: trailing windows, first-accept windows, runs, pages, rotation. Every order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(df: DataFrame, keys: Sequence[str], day: Column, today: str, days: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """Rows per key within the last n days up to ``today``, and in all; a single partial aggregate."""
    t = F.to_date(F.lit(today))
    sums = [F.sum(F.when((day > F.date_sub(t, n)) & (day <= t), 1).otherwise(0)).alias(f"d{n}") for n in days]
    return df.groupBy(*keys).agg(*sums, F.count("*").alias("total"))


def islands(df: DataFrame, keys: Sequence[str], ts: str, seconds: float) -> DataFrame:
    """``island``: a number per key that grows where a row comes ``seconds`` or more after the one before.

    The first row of an island is accepted by every window of that length, so islands can be folded apart:
    a key with many rows is no task of its own beyond its sort.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    return df.withColumn("island", F.sum(F.when(gap >= seconds * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_accept(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, limit: int = 1) -> DataFrame:
    """(keys, ts) of accepted rows: ``limit`` in a window that opens with the first accepted row and that
    rejected rows do not extend."""
    micros = seconds * 1_000_000
    times = F.array_sort(F.collect_list(F.unix_micros(ts)))
    state = "struct<begin:bigint,n:int,taken:array<bigint>>"
    zero = F.lit(None).cast(state)

    def step(a: Column, x: Column) -> Column:
        fresh = a.isNull() | (x >= a["begin"] + micros)
        taken = F.coalesce(a["taken"], F.array().cast("array<bigint>"))
        more = F.when(fresh | (a["n"] < limit), F.array_append(taken, x)).otherwise(taken)
        n = F.when(fresh, F.lit(1)).otherwise(a["n"] + 1)
        return F.struct(F.when(fresh, x).otherwise(a["begin"]).alias("begin"), n.alias("n"), more.alias("taken")).cast(state)

    groups = islands(df, keys, ts, seconds).groupBy(*keys, "island").agg(F.aggregate(times, zero, step)["taken"].alias("taken"))
    return groups.select(*keys, F.explode("taken").alias(ts)).withColumn(ts, F.timestamp_micros(ts))


def daily_series(df: DataFrame, key: str, day: Column, first: str, last: str) -> DataFrame:
    """Rows per key and day, zero where there are none."""
    days = df.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    counts = df.groupBy(key, day.alias("day")).agg(F.count("*").alias("n"))
    grid = df.select(key).distinct().join(F.broadcast(days))  # days are bounded by the range asked for
    return grid.join(counts, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null up to this row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """(keys, begins, ends, n): consecutive rows with the flag (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    both = df.withColumn("_at", F.row_number().over(w)).where(flag)
    run = both.withColumn("_run", F.col("_at") - F.row_number().over(w))
    return run.groupBy(*keys, "_run").agg(F.min(order[0]).alias("begins"), F.max(order[0]).alias("ends"), F.count("*").alias("n")).drop("_run")


def uniquify(df: DataFrame, id_: str, order: Sequence[str], name: str) -> DataFrame:
    """The second and later rows of an id get the next free of -2, -3, ...: numbers that some id's own name has are passed over.

    Names taken are those of the ids themselves; they are counted per id up to the number of its
    rows and its taken names, so no key gathers more than its own rows.
    """
    base, number = F.regexp_extract(id_, r"(?s)^(.*)-([1-9]\d*)$", 1), F.regexp_extract(id_, r"-([1-9]\d*)$", 1).try_cast("int")
    taken = df.select(base.alias("_base"), number.alias("_number")).where("_number >= 2").distinct()
    again = df.groupBy(F.col(id_).alias("_base")).agg(F.count("*").alias("_rows")).where("_rows > 1")
    near = again.join(taken.groupBy("_base").agg(F.count("*").alias("_used")).hint("merge"), "_base", "left")
    tries = near.select("_base", F.explode(F.sequence(F.lit(2), (F.col("_rows") + F.coalesce("_used", F.lit(0))).cast("int"))).alias("_number"))
    free = tries.join(taken.hint("merge"), ["_base", "_number"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy("_number")) + 1)
    counted = df.withColumn("_n", F.row_number().over(Window.partitionBy(id_).orderBy(*order)))
    both = counted.join(free.withColumnRenamed("_base", id_).hint("merge"), [id_, "_n"], "left")
    return both.select(*df.columns, F.when(F.col("_n") == 1, F.col(id_)).otherwise(F.concat_ws("-", id_, F.col("_number").cast("string"))).alias(name))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: a window that keeps one row before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rk") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def rotated(df: DataFrame, order: Sequence[str], run: int, size: int, stride: int = 17, name: str = "turn") -> DataFrame:
    """Place of each of ``size`` rows in an order that starts further on with each run."""
    return numbered(df, order, "_at").withColumn(name, F.pmod(F.col("_at") - 1 - (run * stride) % size, F.lit(size))).drop("_at")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Places from 1 in a total order, without a window over all rows: sorted by range, numbered within
    each range, and shifted by the rows of the ranges before (one count per range)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: both uses of the ranges agree
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    placed = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    first = F.struct(*order)
    sizes = placed.groupBy("_range").agg(F.min(first).alias("_least"), F.count("*").alias("_size"))
    shift = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_least")) - F.col("_size"))  # a row per range
    return placed.join(F.broadcast(shift.select("_range", "_before")), "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def locale_ranked(df: DataFrame, keys: Sequence[str], column: str, ties: Sequence[str] = (), locale: str = "ja", name: str = "rank") -> DataFrame:
    """Places from 1 within each key in a locale's order (kana by sound, whatever their script, then kanji), ties by other columns; nulls last."""
    w = Window.partitionBy(*keys).orderBy(F.collate(F.col(column), locale).asc_nulls_last(), *ties)
    return df.withColumn(name, F.row_number().over(w))
