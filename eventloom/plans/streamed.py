"""Counters, quotas and notices over all events as a stream in three runs, each started from the checkpoint of the one before, beside SQL over the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.shelf import scratch
from eventloom.sources.tables import table
from eventloom.streaming import counters as C

QUERIES: dict = {}
ORACLES: dict = {}
RUNS, LATE = 3, "2 hours"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def in_runs(spark, sf: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Events arrive by time in equal spans; after each the stream runs, ends, and is started again."""
    events, folder = table(spark, sf, "events").where("ts is not null"), scratch(spark)
    begin, end = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if begin is None:
        begin = end = 0
    span = (end - begin) // RUNS + 1
    for i in range(RUNS):
        part = F.floor((F.unix_micros("ts") - begin) / span) == i
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        got = C.drain(build(spark.readStream.schema(events.schema).parquet(f"{folder}/in")), folder)
    return got


@query("""with v as (select user_id, strftime(ts + interval 9 hour, '%Y-%m-%d') as day, count(*) as n, max(ts) as last from events where user_id is not null and ts is not null group by all),
    t as (select user_id, sum(n)::bigint as total from v group by user_id)
    select user_id, day, n, total from v join t using (user_id) where last + interval 10 day > (select max(ts) - interval 2 hour from events)""")
def kept_counters(spark, sf):
    """Views per user and day, kept for ten days after the day's last one, with the user's total."""
    got = in_runs(spark, sf, lambda s: C.counters(s, "user_id", "ts", 10, LATE))
    totals = got.groupBy("user_id").agg(F.max("total").alias("total"))
    return C.latest(got, ["user_id", "day"]).where("kept").drop("total").join(totals, "user_id").select("user_id", "day", "n", "total")


@query("""select event_id, event_type, strftime(ts + interval 9 hour, '%Y-%m') as month, case when n <= 150 then n end as used, n <= 150 as granted
    from (select *, row_number() over (partition by event_type, strftime(ts + interval 9 hour, '%Y-%m') order by ts, event_id) as n from events where event_type is not null and event_id is not null and ts is not null)""")
def monthly_quotas(spark, sf):
    got = in_runs(spark, sf, lambda s: C.within_quota(s, "event_type", "event_id", "ts", 150, LATE))
    return got.select(F.col("call").alias("event_id"), "event_type", "month", "used", "granted")


@query("""with recursive e as (select event_id, user_id, event_type, ts, case when event_id % 3 = 0 then ts + interval 1 hour else ts + interval 72 hour end as until from events where user_id is not null and event_type is not null and event_id is not null and ts is not null),
    s as (select user_id, event_type, min({'ts': ts, 'k': event_id::varchar, 'until': until}) as r from e group by all
        union all select user_id, event_type, min({'ts': e.ts, 'k': event_id::varchar, 'until': e.until}) from s join e using (user_id, event_type) where e.ts >= s.r.until group by user_id, event_type)
    select event_id, case when event_id::varchar in (select r.k from s) then 'send' else 'duplicate' end as action from e""")
def notices_sent(spark, sf):
    """A notice per user and type of event at most every 72 hours; one in three cannot be delivered, which is reported an hour later."""
    def build(stream):
        row = lambda ts, failed: F.struct("user_id", "event_type", "event_id", ts.alias("ts"), F.lit(failed).alias("failed"))
        report = F.when(F.col("event_id") % 3 == 0, row(F.col("ts") + F.expr("interval 1 hour"), True))
        rows = stream.select(F.explode(F.array_compact(F.array(row(F.col("ts"), False), report))).alias("r")).select("r.*")
        return C.notices(rows, ["user_id", "event_type"], "event_id", "ts", "failed", 72, LATE)

    return in_runs(spark, sf, build).select(F.col("request").cast("long").alias("event_id"), "action")
