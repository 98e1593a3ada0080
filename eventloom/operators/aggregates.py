"""Facets, reports and comparisons of counts. All are partial aggregates before a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "（不明）"


def facets(df: DataFrame, values: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """(facet, value, n) for all facets in one pass: columns count by value, flags count where they hold."""
    one = [F.struct(F.lit(k).alias("facet"), F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias("value")) for k, c in values.items()]
    two = [F.when(c, F.struct(F.lit(k).alias("facet"), F.lit("yes").alias("value"))) for k, c in flags.items()]
    return df.select(F.explode(F.array(*one, *two)).alias("f")).where("f is not null").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def summary(df: DataFrame, groups: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """(dim, key, n, sums): the grand total and a table per group, by grouping sets; blank keys are unknown."""
    names = list(groups)
    keyed = df.select(*[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN)).alias(k) for k, c in groups.items()], *[c.alias(k) for k, c in sums.items()])
    sets = [[F.col(k)] for k in names] + [[]]
    out = keyed.groupingSets(sets, *[F.col(k) for k in names]).agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in sums], F.grouping_id().alias("_g"))
    dim = F.lit("total")
    for i, k in enumerate(names):
        dim = F.when(F.col("_g") == (2 ** len(names) - 1) - 2 ** (len(names) - 1 - i), k).otherwise(dim)
    return out.select(dim.alias("dim"), F.coalesce(*names, F.lit("")).alias("key"), "n", *sums)


def zero_filled(df: DataFrame, dim: DataFrame, key: str, where: Column) -> DataFrame:
    """Rows per key of the dimension that meet a condition, none included."""
    counts = df.where(where).groupBy(key).agg(F.count("*").alias("n"))
    return dim.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def drops(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, before, now, level) of partitions that lost too many rows.

    Fixed values: to zero from 2 is an error; below 40 % of 5 or more an error; below 70 % of 3 or more a warning.
    """
    a, b = before.groupBy(key).agg(F.count("*").alias("before")), now.groupBy(key).agg(F.count("*").alias("now"))
    both = a.join(b, key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
    p, n = F.col("before"), F.col("now")
    level = F.when((n == 0) & (p >= 2), "error").when((p >= 5) & (n * 10 < p * 4), "error").when((p >= 3) & (n * 10 < p * 7), "warn")
    return both.withColumn("level", F.coalesce(level, F.lit("ok")))


def by_day(df: DataFrame, start: Column, end: Column, most: int = 60) -> DataFrame:
    """(day, n): rows on each day of their span, of which ``most`` days count."""
    last = F.least(F.coalesce(end, start), F.date_add(start, most - 1))
    days = F.when(last >= start, F.sequence(start, last)).otherwise(F.array(start))
    return df.select(F.explode(days).alias("day")).groupBy("day").agg(F.count("*").alias("n"))


def overlaps(df: DataFrame, start: Column, end: Column, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """(period, n): rows whose span meets a period, all periods in one pass."""
    hits = F.array(*[F.when((start <= F.lit(t).cast("date")) & (end >= F.lit(f).cast("date")), F.lit(k)) for k, (f, t) in periods.items()])
    return df.select(F.explode(hits).alias("period")).where("period is not null").groupBy("period").agg(F.count("*").alias("n"))


def violations(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(rule, level, n): rows that break each rule (name, level, condition that is bad), in one pass."""
    broken = F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, bad in rules])
    return df.select(F.explode(broken).alias("b")).where("b is not null").groupBy("b.rule", "b.level").agg(F.count("*").alias("n"))


def disposition(df: DataFrame, gates: Sequence[tuple[str, Column]], name: str = "disposition") -> DataFrame:
    """The first gate a row fails, else published: computed once, split afterwards."""
    out = F.lit("published")
    for label, bad in reversed(gates):
        out = F.when(bad, label).otherwise(out)
    return df.withColumn(name, out)


def lifted_facets(df: DataFrame, filters: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """(facet, value, n): the list's count (facet ``list``), and per facet its values among the rows that all *other* filters pass.

    A row carries one bit per filter it fails. With none it counts everywhere, with one in the facet
    of that name, with more nowhere: one scan and one partial aggregate for all facets. A null test
    fails; filters without values narrow the list and every facet.
    """
    bits = {name: 1 << i for i, name in enumerate(filters)}
    mask = F.lit(0)
    for name, test in filters.items():
        mask = mask + F.when(F.coalesce(test, F.lit(False)), 0).otherwise(bits[name])
    entry = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    own = [F.when(F.col("_failed").isin(0, bits.get(name, 0)), entry(name, F.coalesce(c.cast("string"), F.lit(UNKNOWN)))) for name, c in values.items()]
    named = df.select("*", mask.alias("_failed")).where(F.bit_count("_failed") <= 1)
    counted = named.select(F.explode(F.array_compact(F.array(F.when(F.col("_failed") == 0, entry("list", F.lit(""))), *own))).alias("f"))
    return counted.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
