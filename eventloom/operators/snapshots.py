"""Snapshots compared and merged: losses with reasons, twins, what is kept, carried or restored. Equi-joins with a residual test."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import quality as Q
from eventloom.functions.scalars import compare_url, dedup_key, degraded
from eventloom.operators.containment import like_keys
from eventloom.operators.windows import first_by

# From how many rows on a partition's loss is told, and how much of them may go.
ZERO_FROM, SHARP_FROM, SHARP, WARN_FROM, WARN = 2, 5, 0.4, 3, 0.7
MISSING_FROM, MISSING_SHARE, STALE_RUNS = 3, 0.3, 9
CARRIED = ("time", "address", "deadline", "ageRequirement", "place", "notes", "deadlineDate")


def title_key(c: Column) -> Column:
    return dedup_key(F.coalesce(c, F.lit("")))


def like_places(x: Column, y: Column) -> Column:
    """Keys of places that do not contradict: one unknown, or one within the other."""
    return (x == "") | (y == "") | x.contains(y) | y.contains(x)


def _pair(before: DataFrame, now: DataFrame, id_: str) -> DataFrame:
    """Rows of both by id, the former ones with an underscore."""
    return before.select(*[F.col(c).alias(f"_{c}") for c in before.columns]).join(now.hint("merge"), F.col(f"_{id_}") == F.col(id_))


def field_losses(before: DataFrame, now: DataFrame, fields: Sequence[str], today: str) -> DataFrame:
    """(id, field, reason): fields of events not over that had a value and have none, and why."""
    both = _pair(before, now, "id")
    old, new = ({c: F.col(p + c) for c in now.columns} for p in ("_", ""))
    live = [~Q.ended(r["endDate"], r["date"], F.lit(today)) for r in (old, new)]
    cancelled = Q.cancelled_row(new["status"], new["title"], new["notes"], new["place"])
    tests = {"_same": Q.same_event(old, new), "_cancelled": cancelled, "_said": Q.said(new)}  # once per row, before the fields
    both = both.where(live[0] & live[1]).withColumns(tests)
    out = []
    for f in fields:
        changed = ~Q.blank(new["deadline"]) if f == "deadlineDate" else F.lit(False)
        reason = Q.loss_reason(F.col("_same"), F.col("_cancelled"), Q.removed(f, F.col("_said"), new.get("fieldState")), F.lit(False), changed)
        out.append(F.when(~Q.blank(old[f]) & Q.blank(new[f]), F.struct(F.lit(f).alias("field"), reason.alias("reason"))))
    lost = F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("x")
    return both.select("id", lost).select("id", "x.field", "x.reason")


def carried(before: DataFrame, now: DataFrame, today: str) -> DataFrame:
    """``now`` with values of the same event before: blank fields, a degraded place, notes, and a deadline with its day; ``carried`` names them."""
    both = now.join(before.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in before.columns if c != "id"]).hint("merge"), "id", "left")
    new = {c: F.col(c) for c in now.columns}
    old = {c: F.col(f"_{c}") for c in before.columns if c != "id"} | {"id": F.col("id")}
    open_ = Q.same_event(old, new) & ~Q.ended(new["endDate"], new["date"], F.lit(today)) & ~Q.cancelled_row(new["status"], new["title"], new["notes"], new["place"])
    worse = ~Q.blank(new["place"]) & F.coalesce(degraded(old["place"], new["place"]), F.lit(False))
    tests = {"_open": open_, "_said": Q.said(new), "_worse": worse} | {f"_had_{f}": ~Q.blank(old[f]) for f in CARRIED if f in old} | {f"_none_{f}": Q.blank(new[f]) for f in CARRIED if f in old}
    both = both.withColumns(tests)  # each test once per row; the fields below only combine them
    had, none, gone = (lambda f: F.col(f"_had_{f}")), (lambda f: F.col(f"_none_{f}")), (lambda f: Q.removed(f, F.col("_said"), new.get("fieldState")))
    takes = {f: F.col("_open") & had(f) & none(f) & ~gone(f) for f in ("time", "address", "deadline", "ageRequirement") if f in old}
    takes["place"] = F.col("_open") & had("place") & ((none("place") & ~gone("place")) | F.col("_worse"))
    takes["notes"] = F.col("_open") & had("notes") & none("notes")
    takes["deadlineDate"] = takes["deadline"] & had("deadlineDate") & none("deadlineDate")
    both = both.withColumns({f"_take_{f}": t for f, t in takes.items()})
    names = F.filter(F.array(*[F.when(F.col(f"_take_{f}"), F.lit(f)) for f in takes]), lambda x: x.isNotNull())
    return both.select(*[F.when(F.col(f"_take_{c}"), old[c]).otherwise(new[c]).alias(c) if c in takes else new[c].alias(c) for c in now.columns], names.alias("carried"))


def _keyed(rows: DataFrame, block: Sequence[str], title: str) -> DataFrame:
    """The distinct (block, title) with the title's key: made once per text, after the shuffle that finds them."""
    return rows.select(*block, title).distinct().withColumn("_key", title_key(F.col(title)))


def merged_into(gone: DataFrame, now: DataFrame, block: Sequence[str], title: str) -> DataFrame:
    """Rows of ``gone`` that ``now`` has under another id: a like title in the same block, found through the index of grams."""
    keyed = _keyed(gone, block, title)
    found = like_keys(keyed, _keyed(now, block, title), block, "_key").select(*block, "_key").distinct()
    return gone.join(keyed.join(found.hint("merge"), [*block, "_key"], "left_semi").select(*block, title).hint("merge"), [*block, title], "left_semi").select(*gone.columns)


def twins(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, twin): rows (id, date, title, place) of the same day with like titles and places that do not contradict."""
    keys = [_keyed(x, ["date"], "title") for x in (a, b)]
    pairs = like_keys(*keys, ["date"], "_key")
    titles = keys[0].join(pairs, ["date", "_key"]).select("date", "title", "other").join(keys[1].select("date", F.col("title").alias("_title"), F.col("_key").alias("other")), ["date", "other"])
    mine = a.select("id", "date", "title", title_key(F.col("place")).alias("_place"))
    theirs = b.select(F.col("id").alias("twin"), "date", F.col("title").alias("_title"), title_key(F.col("place")).alias("_at"))
    both = mine.join(titles.select("date", "title", "_title"), ["date", "title"]).join(theirs, ["date", "_title"])
    return both.where(like_places(F.col("_place"), F.col("_at"))).select("id", "twin")


def filled(rows: DataFrame, other: DataFrame, pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose blanks take the value of their first twin, and the rows of ``other`` that are nobody's twin."""
    return _filled(rows, other, pairs.groupBy("id").agg(F.min("twin").alias("twin")), pairs.select("twin").distinct(), fields)


def _filled(rows: DataFrame, other: DataFrame, first: DataFrame, twins_: DataFrame, fields: Sequence[str]) -> DataFrame:
    theirs = other.select(F.col("id").alias("twin"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = rows.join(first.hint("merge"), "id", "left").join(theirs.hint("merge"), "twin", "left")
    own = both.select(*[F.when(Q.blank(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
    return own.unionByName(other.join(twins_.select(F.col("twin").alias("id")).hint("merge"), "id", "left_anti").select(*rows.columns))


def first_twins(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, twin), (twin)): of ``twins`` the first one of each row, and all rows of ``b`` that are somebody's.

    Rows of one day, title and place have the same twins, so that these are looked for once for all of them:
    the pairs of rows, whose number grows with the square of such groups, are not made.
    """
    kind = ["date", "title", "place"]
    mine, theirs = (x.where("id is not null").select("id", "date", "title", F.coalesce("place", F.lit("")).alias("place")) for x in (a, b))
    groups = [mine.select(*kind).distinct(), theirs.groupBy(*kind).agg(F.min("id").alias("_id"))]
    pairs = twins(groups[0].select(F.struct(*kind).alias("id"), *kind), groups[1].select(F.struct("_id", *kind).alias("id"), *kind))
    near = pairs.groupBy("id").agg(F.min("twin._id").alias("twin")).select("id.*", "twin")
    asked = pairs.select("twin").distinct().select(*[F.col(f"twin.{c}").alias(c) for c in kind])
    first = mine.join(near.hint("merge"), kind).groupBy("id").agg(F.min("twin").alias("twin"))
    return first, theirs.join(asked.hint("merge"), kind, "left_semi").select(F.col("id").alias("twin")).distinct()


def filled_by_twins(rows: DataFrame, other: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``filled`` with the twins of both, without a row per pair of twins."""
    first, theirs = first_twins(rows, other)
    return _filled(rows, other, first, theirs, fields)


def restored(now: DataFrame, before: DataFrame, fields: Sequence[str], place: Sequence[str]) -> DataFrame:
    """Values that were lost, from the same id before, where the place's columns are the same."""
    old = before.select("id", *[F.col(c).alias(f"_{c}") for c in (*fields, *place)])
    both = now.join(old, "id", "left")
    lost = F.coalesce(reduce(lambda a, c: a & F.col(c).isNull() & F.col(f"_{c}").isNotNull(), fields, F.lit(True)) & reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), place, F.lit(True)), F.lit(False))
    return both.select(*[F.when(lost, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in now.columns])


def kept_sources(before: DataFrame, visited: DataFrame, url: str) -> DataFrame:
    """Former rows whose source was not visited again."""
    return before.withColumn("_key", compare_url(F.col(url))).join(visited.select(compare_url(F.col(url)).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def with_fallback(found: DataFrame, before: DataFrame, key: str, failed: DataFrame) -> DataFrame:
    """What was found, and the former rows of keys that failed or of which nothing was found."""
    seen = found.select(key).distinct().join(failed.select(key).distinct(), key, "left_anti")
    return found.join(failed.select(key).distinct(), key, "left_anti").unionByName(before.join(seen, key, "left_anti"))


def vanished(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """``now`` and all former rows of partitions that had ZERO_FROM rows or more and have none."""
    gone = before.groupBy(key).count().where(F.col("count") >= ZERO_FROM).join(now.select(key).distinct(), key, "left_anti").select(key)
    return now.unionByName(before.join(gone, key, "left_semi"))


def partition_alerts(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, previous, current, level, rule) of partitions that lost too much."""
    p, c = before.groupBy(key).agg(F.count("*").alias("previous")), now.groupBy(key).agg(F.count("*").alias("current"))
    both = p.join(c, key, "left").withColumn("current", F.coalesce("current", F.lit(0)))
    a, b = F.col("previous"), F.col("current")
    rule = F.when((a >= ZERO_FROM) & (b == 0), "pref_zero").when((a >= SHARP_FROM) & (b < a * SHARP), "pref_sharp_drop").when((a >= WARN_FROM) & (b < a * WARN), "pref_drop")
    return both.withColumn("rule", rule).where("rule is not null").withColumn("level", F.when(F.col("rule") == "pref_drop", "warning").otherwise("error"))


def missing_levels(missing: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, missing, previous, level): unexplained losses per partition."""
    lost = missing.where("reason = 'unexplained'").groupBy(key).agg(F.count("*").alias("missing"))
    both = lost.join(before.groupBy(key).agg(F.count("*").alias("previous")), key, "left").withColumn("previous", F.coalesce("previous", F.lit(0)))
    return both.withColumn("level", F.when((F.col("missing") >= MISSING_FROM) & (F.col("missing") >= F.col("previous") * MISSING_SHARE), "error").otherwise("warning"))


def carry_state(state: DataFrame, taken: DataFrame, today: str) -> DataFrame:
    """(id, field, count, since, last, stale): one more for what was carried again, gone for what was not."""
    both = taken.select("id", "field").distinct().join(state.select("id", "field", F.col("count").alias("_n"), F.col("since").alias("_since")).hint("merge"), ["id", "field"], "left")
    n = F.coalesce("_n", F.lit(0)) + 1
    return both.select("id", "field", n.alias("count"), F.coalesce("_since", F.lit(today)).alias("since"), F.lit(today).alias("last"), (n >= STALE_RUNS).alias("stale"))


def quarantine_history(before: DataFrame, now: DataFrame, published: DataFrame, today: str) -> DataFrame:
    """(id, action, day): rows that entered the quarantine, and those that left it for publication or are gone."""
    entered = now.join(before.select("id").hint("merge"), "id", "left_anti").select("id", F.lit("entered").alias("action"))
    left = before.select("id").join(now.select("id").hint("merge"), "id", "left_anti").join(published.select("id").distinct().withColumn("_p", F.lit(True)).hint("merge"), "id", "left")
    return entered.unionByName(left.select("id", F.when(F.col("_p"), "published").otherwise("gone").alias("action"))).withColumn("day", F.lit(today))


def news(before: DataFrame, now: DataFrame, order: Sequence[str], title: str, shown: int = 3) -> DataFrame:
    """One row (n, titles): how many rows are new, and the first titles; the order is by partial top-k, not a gathered list."""
    new = now.join(before.select("id"), "id", "left_anti")
    top = new.orderBy(*order).limit(shown).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, title))), lambda x: x[title]).alias("titles"))
    return new.agg(F.count("*").alias("n")).join(top)


def page_of(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page with ``total`` and ``has_more``: the total is one partial count."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def planned(assets: DataFrame, key: str, order: str, rank: Column, limit: int) -> DataFrame:
    """Assets once each (the last row of a key at its first place), by priority, ``now`` for the first ``limit`` and else ``deferred``."""
    last = first_by(assets, [key], [F.col(order).desc()])
    first = assets.groupBy(key).agg(F.min(order).alias("_first"))
    plan = last.join(first, key).withColumn("_rank", rank)
    chosen = plan.orderBy("_rank", "_first", key).limit(limit).select(key).withColumn("_now", F.lit(True))
    return plan.join(chosen, key, "left").withColumn("state", F.when(F.col("_now"), "now").otherwise("deferred")).drop("_now", "_first", "_rank")


def outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "full")


def neighbours(counts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, neighbour, n): of partitions without rows, those beside them that have some."""
    some = counts.where("n > 0")
    empty = edges.join(some.select(key), key, "left_anti")
    return empty.join(some.select(F.col(key).alias("neighbour"), "n"), "neighbour").select(key, "neighbour", "n")


def fan_out(changes: DataFrame, watchers: DataFrame, targets: DataFrame, id_: str, who: str) -> DataFrame:
    """A row per change and target of everybody who watches it."""
    return changes.join(watchers, id_).join(targets, who)


def probed(keys: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """hit, negative (a known absence) or miss per key: a null in the cache is no miss."""
    known = cache.select(key, value, F.lit(True).alias("_hit"))
    return keys.join(known, key, "left").withColumn("state", F.when(F.col("_hit").isNull(), "miss").when(F.col(value).isNull(), "negative").otherwise("hit")).drop("_hit")


def roster(members: DataFrame, seen: DataFrame, id_: str, now: Column, ts: str) -> DataFrame:
    """Members with the seconds since they were last seen, online, away or offline."""
    last = seen.groupBy(id_).agg(F.max(ts).alias("_last"))
    ago = F.unix_seconds(now) - F.unix_seconds("_last")
    return members.join(last, id_, "left").withColumn("ago", ago).withColumn("state", Q.presence(F.col("ago"))).drop("_last")


def next_names(rows: DataFrame, known: DataFrame, name: str, prefix: str, order: Sequence[str]) -> DataFrame:
    """New names with the next numbers behind the largest in use."""
    from eventloom.operators.windows import numbered

    largest = known.agg(F.coalesce(F.max(F.regexp_extract("key", rf"^{prefix}(\d+)$", 1).try_cast("int")), F.lit(0)).alias("_top"))
    new = numbered(rows.join(known.select(name), name, "left_anti"), order, "_n").join(F.broadcast(largest))
    return new.withColumn("key", F.concat(F.lit(prefix), (F.col("_top") + F.col("_n")).cast("string"))).drop("_top", "_n")


def best_page(pages: DataFrame, owner: str, score: Column, title: str) -> DataFrame:
    """Of each owner the page of the highest score of 1 or more; ties to the shorter title, then the title."""
    w = Window.partitionBy(owner).orderBy(F.col("score").desc(), F.char_length(title), title)
    return pages.withColumn("score", score).where("score >= 1").withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
