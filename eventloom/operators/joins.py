"""Lookups and comparisons of snapshots as joins; sizes of broadcast sides are left to Spark's threshold."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scalars import half_width, haversine_m


def missing(before: DataFrame, now: DataFrame, id_: str, reasons: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows of ``before`` that ``now`` lacks, with the first reason whose table has the row's keys, else unexplained."""
    gone = before.join(now.select(id_).distinct(), id_, "left_anti")
    for i, (_, table, keys) in enumerate(reasons):
        gone = gone.join(table.select(*keys).distinct().withColumn(f"_r{i}", F.lit(True)), list(keys), "left")
    reason = reduce(lambda rest, i: F.when(F.col(f"_r{i}"), reasons[i][0]).otherwise(rest), reversed(range(len(reasons))), F.lit("unexplained"))
    return gone.withColumn("reason", reason).drop(*[f"_r{i}" for i in range(len(reasons))])


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def carry_forward(now: DataFrame, before: DataFrame, id_: str, fields: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Blank fields take the previous snapshot's value where the columns ``same`` agree; ``carried`` names them."""
    old = before.select(id_, *[F.col(c).alias(f"_old_{c}") for c in [*fields, *same]])
    both = now.join(old, id_, "left")
    agree = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_old_{c}")), same, F.lit(True))
    takes = {f: blank(F.col(f)) & ~blank(F.col(f"_old_{f}")) & agree for f in fields}
    carried = F.filter(F.array(*[F.when(takes[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    out = both.withColumn("carried", carried)
    return out.select(*[F.when(takes[c], F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in takes else F.col(c) for c in now.columns], "carried")


def overlay(rows: DataFrame, patches: DataFrame, id_: str, fields: Sequence[str]) -> DataFrame:
    """A patch (id, keys, fields) sets the fields its keys name, to null as well."""
    p = patches.select(id_, "keys", *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = rows.join(p, id_, "left")
    return both.select(*[F.when(F.array_contains("keys", c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def changed_fields(before: DataFrame, now: DataFrame, id_: str, fields: Sequence[str]) -> DataFrame:
    both = before.select(id_, *[F.col(f).alias(f"_old_{f}") for f in fields]).join(now.select(id_, *fields), id_)
    names = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_old_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.select(id_, F.array_join(names, ",").alias("changed")).where("changed <> ''")


def without_twins(rows: DataFrame, known: DataFrame, keys: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Rows that match no known row by any of the keys: an equi anti-join per key."""
    for i, (mine, theirs) in enumerate(keys):
        rows = rows.withColumn("_key", mine).join(known.select(theirs.alias(f"_known{i}")).where(F.col(f"_known{i}").isNotNull()).distinct(), F.col("_key") == F.col(f"_known{i}"), "left_anti").drop("_key")
    return rows


def nearest(points: DataFrame, places: DataFrame, metres: float, k: int, point: str, place: str) -> DataFrame:
    """(point, place, metres, rk): the k nearest places within a distance.

    Both have (id, lat, lon). Places go to a grid cell as large as the distance, points to the nine cells
    around theirs: an equi-join, no pair beyond neighbouring cells is made. A degree of longitude shrinks with
    latitude, so cells are as wide as 75 degrees of latitude needs. Points of one spot share one search, and of
    places at one spot only the first k by their id can be among the k nearest, so that pairs grow with the spots.
    """
    step = metres / 111_000
    wide = step / math.cos(math.radians(75))
    cell = lambda c, s: F.floor(F.col(c) / s)
    spot = Window.partitionBy("lat", "lon").orderBy(place)
    firsts = places.select(place, "lat", "lon").where("lat is not null and lon is not null").withColumn("_nth", F.row_number().over(spot)).where(F.col("_nth") <= k)
    near = firsts.select(F.col(place), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), cell("lat", step).alias("_i"), cell("lon", wide).alias("_j"))
    around = F.explode(F.array(*[F.struct((cell("lat", step) + i).alias("_i"), (cell("lon", wide) + j).alias("_j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    mine = points.select("lat", "lon").distinct().select("lat", "lon", around.alias("c")).select("lat", "lon", "c.*")
    pairs = mine.join(near.hint("merge"), ["_i", "_j"]).withColumn("metres", F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).cast("long"))
    w = Window.partitionBy("lat", "lon").orderBy("metres", place)
    best = pairs.where(F.col("metres") <= metres).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("lat", "lon", place, "metres", "rk")
    return points.select(point, "lat", "lon").join(best.hint("merge"), ["lat", "lon"]).select(point, place, "metres", "rk")


def longest_contained(texts: DataFrame, names: DataFrame, id_: str, text: str, name: str, most_words: int) -> DataFrame:
    """The longest name (of at most ``most_words`` words) that stands in a text at word boundaries: an
    equi-join of the text's word runs with the names instead of a scan of every name by every text."""
    words = F.split(F.trim(text), r"\s+")
    runs = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    parts = texts.select(id_, words.alias("_w")).select(id_, F.explode(F.array_distinct(F.concat(*[runs(n) for n in range(1, most_words + 1)]))).alias(name))
    hits = parts.join(names.select(name).distinct(), name)
    best = hits.groupBy(id_).agg(F.max(F.struct(F.char_length(name).alias("n"), F.col(name))).alias("b")).select(id_, F.col(f"b.{name}").alias(name))
    return texts.select(id_).join(best, id_, "left")


def transitions(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Every key of either side as entered, left or stayed."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(True)), now.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_a").isNull(), "entered").when(F.col("_b").isNull(), "left").otherwise("stayed").alias("state"))


def fallback(rows: DataFrame, id_: str, attempts: Sequence[str], lookup: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the first attempt (columns in order) that the lookup table knows, and which one it was."""
    tries = F.posexplode(F.array(*[F.col(a).cast("string") for a in attempts])).alias("_i", key)
    found = rows.select(id_, tries).join(lookup.select(F.col(key).cast("string").alias(key), value), key)
    best = found.groupBy(id_).agg(F.min(F.struct("_i", value)).alias("b"))
    by = F.element_at(F.array(*[F.lit(a) for a in attempts]), F.col("b._i") + 1)
    return rows.select(id_).join(best, id_, "left").select(id_, F.col(f"b.{value}").alias(value), by.alias("found_by"))


def overridden(rows: DataFrame, rules: Sequence[tuple[Column, dict[str, object]]]) -> DataFrame:
    """Rules (condition on the original row, values); a later rule wins per column, and rules do not chain."""
    fields = {f for _, v in rules for f in v}
    new = {f: reduce(lambda rest, r: F.when(r[0], F.lit(r[1][f])).otherwise(rest) if f in r[1] else rest, rules, F.col(f)) for f in fields}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def classified(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """baseline, unchanged or changed by the digest of the snapshot before."""
    old = before.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_hit"))
    state = F.when(F.col("_hit").isNull(), "baseline").when(F.col("_old").eqNullSafe(F.col(digest)), "unchanged").otherwise("changed")
    return now.join(old, key, "left").select(key, state.alias("state"))


# What a reading says when it has found nothing.
NOTHING = r"(?i)^(?:null|undefined|なし|不明|未定|該当なし|記載なし|N/A|-|―|—)$"


def told(c: Column) -> Column:
    """A reading's text, trimmed; null if it says that there is none."""
    t = F.trim(F.regexp_replace(c.cast("string"), r"^[\s　]+|[\s　]+$", ""))
    return F.when(~((t == "") | t.rlike(NOTHING)), t)


def rechecked(rows: DataFrame, readings: DataFrame, id_: str, fields: Sequence[str]) -> DataFrame:
    """The rows as a second reading of their source leaves them, with ``changes``: array<struct<field, before, after>>.

    ``readings`` has (id, keys, fields), one row per id: a field that ``keys`` names takes the reading's
    value, and null where the reading found none, as the old value has lost its support; other fields
    stay. Spelling alone (widths of letters and digits, white space, case) is no change, and keeps the
    old value as it is. Rows without a reading have no changes; readings without a row go.
    """
    new = readings.select(F.col(id_), F.col("keys").alias("_keys"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = rows.join(new, id_, "left")
    plain = lambda c: F.lower(F.regexp_replace(half_width(c), r"[\s　]", ""))
    # old and new values once per row, before they are compared and shown
    both = both.withColumns({f"_was_{f}": told(F.col(f)) for f in fields} | {f"_now_{f}": told(F.col(f"_new_{f}")) for f in fields})
    differs = {f: F.coalesce(F.array_contains("_keys", f), F.lit(False)) & ~plain(F.col(f"_was_{f}")).eqNullSafe(plain(F.col(f"_now_{f}"))) for f in fields}
    both = both.withColumns({f"_to_{f}": d for f, d in differs.items()})
    change = lambda f: F.when(F.col(f"_to_{f}"), F.struct(F.lit(f).alias("field"), F.col(f"_was_{f}").alias("before"), F.col(f"_now_{f}").alias("after")))
    changes = F.array_compact(F.array(*[change(f) for f in fields]))
    shown = [F.when(F.col(f"_to_{c}"), F.col(f"_now_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return both.select(*shown, changes.alias("changes"))


def with_reading(rows: DataFrame, readings: DataFrame, id_: str, ours: Sequence[str], theirs: Sequence[str], both: Sequence[str] = (), links: Sequence[str] = ()) -> DataFrame:
    """Rows completed by a reading of their picture (one row per id).

    Fields in ``ours`` take the reading's value where they are blank, those in ``theirs`` keep their own
    where the reading is blank, those in ``both`` hold one below the other, and ``links`` are filled
    like ``ours``, but with addresses only. Nothing on either side is null.
    """
    fields = [*ours, *theirs, *both, *links]
    joined = rows.join(readings.select(id_, *[F.col(f).alias(f"_read_{f}") for f in fields]), id_, "left")
    has = lambda c: F.when(~blank(c), c)

    def merged(f: str) -> Column:
        own, read = has(F.col(f)), has(F.col(f"_read_{f}"))
        if f in both:
            return F.nullif(F.concat_ws("\n", own, read), F.lit(""))
        if f in links:
            return F.coalesce(own, F.trim(F.when(read.startswith("http"), read)))
        return F.coalesce(own, read) if f in ours else F.coalesce(read, own)

    return joined.select(*[merged(c).alias(c) if c in fields else F.col(c) for c in rows.columns])
