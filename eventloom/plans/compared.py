"""Snapshots, plans and lookups over whole supplied tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import quality as Q
from eventloom.functions import scalars as S
from eventloom.functions import titles as T
from eventloom.operators import aggregates as A
from eventloom.operators import containment as C
from eventloom.operators import entities as E
from eventloom.operators import joins as J
from eventloom.operators import layouts as L
from eventloom.operators import snapshots as N
from eventloom.operators import windows as W
from eventloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
TODAY = "1998-06-15"
#: Orders as events: (id, k, pref, date) in both languages.
EV = "(select cast(o_orderkey as varchar) as id, o_orderkey as k, o_orderpriority as pref, strftime(o_orderdate, '%Y-%m-%d') as date, o_orderstatus as s, o_custkey as c, o_totalprice as price from orders)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def events(spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("pref"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("price"))


def two(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot, and the next one with what got lost by rules on the key."""
    ev = events(spark, sf)
    k = F.col("k")
    text = F.lit("").cast("string")
    before = ev.select("id", "pref", "date", text.alias("endDate"), F.concat(F.lit("会"), F.col("c")).alias("title"), F.lit("10:00").alias("time"), F.lit("横須賀基地").alias("place"), F.lit("住所").alias("address"), F.lit("7月1日").alias("deadline"), F.lit("1998-07-01").alias("deadlineDate"), F.lit("抽選").alias("notes"), F.lit("published").alias("status"), text.alias("url"), "k")
    gone = lambda n, c: F.when(k % n == 0, "").otherwise(F.col(c)).alias(c)
    now = before.select("id", "pref", "date", "endDate", F.when(k % 11 == 0, "別の催し").otherwise(F.col("title")).alias("title"), gone(3, "time"), F.when(k % 5 == 0, "").when(k % 13 == 0, "横賀基地").otherwise(F.col("place")).alias("place"), gone(4, "address"), F.when(k % 6 == 0, "").when(k % 9 == 0, "近日").otherwise(F.col("deadline")).alias("deadline"), gone(3, "deadlineDate"), F.when(k % 10 == 0, "会場未定").when(k % 17 == 0, "").otherwise(F.col("notes")).alias("notes"), F.when(k % 7 == 0, "cancelled").otherwise(F.col("status")).alias("status"), "url", "k")
    return before, now


@query(f"""with l as (select id, k, unnest(['time', 'place', 'deadlineDate']) as field from {EV} where date >= '{TODAY}')
    select id, field, case when k % 11 = 0 then 'identity_mismatch' when k % 7 = 0 then 'cancelled' when field = 'place' and k % 10 = 0 then 'explicit_removal' when field = 'deadlineDate' and k % 6 <> 0 then 'deadline_changed' else 'extraction_failure' end as reason
    from l where (field = 'time' and k % 3 = 0) or (field = 'place' and k % 5 = 0) or (field = 'deadlineDate' and k % 3 = 0)""")
def field_losses(spark, sf):
    return N.field_losses(*two(spark, sf), ["time", "place", "deadlineDate"], TODAY)


@query(f"""with e as (select *, date >= '{TODAY}' and k % 11 <> 0 and k % 7 <> 0 as ok from {EV})
    select id, case when k % 3 = 0 and not ok then '' else '10:00' end as time, case when k % 5 = 0 and (not ok or k % 10 = 0) then '' when k % 5 <> 0 and k % 13 = 0 and not ok then '横賀基地' else '横須賀基地' end as place,
    case when k % 3 = 0 and not (ok and k % 6 = 0) then '' else '1998-07-01' end as day,
    concat_ws(',', case when ok and k % 3 = 0 then 'time' end, case when ok and k % 4 = 0 then 'address' end, case when ok and k % 6 = 0 then 'deadline' end, case when ok and ((k % 5 = 0 and k % 10 <> 0) or (k % 5 <> 0 and k % 13 = 0)) then 'place' end, case when ok and k % 17 = 0 and k % 10 <> 0 then 'notes' end, case when ok and k % 6 = 0 then 'deadlineDate' end) as carried from e""")
def carried_rows(spark, sf):
    return N.carried(*two(spark, sf), TODAY).select("id", "time", "place", F.col("deadlineDate").alias("day"), F.array_join("carried", ",").alias("carried"))


@query(f"""with e as (select *, 'の会' || c as title, left(date, 7) as m from {EV}) select id from e g where s = 'P' and exists (select 1 from e n where n.s <> 'P' and n.pref = g.pref and n.m = g.m and (contains(n.title, g.title) or contains(g.title, n.title)))""")
def merged_titles(spark, sf):
    e = events(spark, sf).select("id", "pref", F.left("date", F.lit(7)).alias("m"), F.concat(F.lit("の会"), "c").alias("title"), "s")
    return N.merged_into(e.where("s = 'P'"), e.where("s <> 'P'"), ["pref", "m"], "title").select("id")


CUSTOMERS = "(select cast(c_custkey as varchar) as id, cast(c_nationkey as varchar) as date, 'Rx' || (c_custkey % 40) as title, case when c_custkey % 3 = 0 then '' else c_mktsegment end as place from customer)"
SUPPLIERS = "(select 's' || s_suppkey as id, cast(s_nationkey as varchar) as date, 'Rx' || s_suppkey as title, 'FURNITURE HALL' as place from supplier)"
TWINS = f"(select c.id, s.id as twin from {CUSTOMERS} c join {SUPPLIERS} s on c.date = s.date and length(c.title) >= 3 and length(s.title) >= 3 and (contains(c.title, s.title) or contains(s.title, c.title)) and (c.place = '' or contains(replace(s.place, ' ', ''), c.place)))"


def _twins(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("date"), F.concat(F.lit("Rx"), F.col("c_custkey") % 40).alias("title"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("place"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("date"), F.concat(F.lit("Rx"), "s_suppkey").alias("title"), F.lit("FURNITURE HALL").alias("place"))
    return c, s


@query(f"select id, twin from {TWINS}")
def twin_rows(spark, sf):
    return N.twins(*_twins(spark, sf))


@query(f"""with t as (select id, min(twin) as twin from {TWINS} group by id) select c.id, case when c.place = '' and t.twin is not null then 'FURNITURE HALL' else c.place end as place from {CUSTOMERS} c left join t on t.id = c.id
    union all select id, place from {SUPPLIERS} where id not in (select twin from {TWINS})""")
def filled_rows(spark, sf):
    c, s = _twins(spark, sf)
    return N.filled_by_twins(c, s, ["place"]).select("id", "place")


@query(f"select id, case when k % 4 = 0 and k % 3 <> 0 then null else price end as lat from {EV}")
def restored_points(spark, sf):
    e = events(spark, sf)
    before = e.select("id", F.col("price").alias("lat"), F.col("pref").alias("place"))
    now = e.select("id", F.when(F.col("k") % 4 == 0, None).otherwise(F.col("price")).alias("lat"), F.when(F.col("k") % 3 != 0, "x").otherwise(F.col("pref")).alias("place"))
    return N.restored(now, before, ["lat"], ["place"]).select("id", "lat")


@query("""with k as (select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) as u from pages)
    select page_id from k where u not in (select u from k where page_id % 3 = 0)""".replace("\\\\", "\\"))
def kept_source_rows(spark, sf):
    p = table(spark, sf, "pages")
    return N.kept_sources(p, p.where("page_id % 3 = 0"), "url").select("page_id")


@query("""select n_name as key, cast(1 as bigint) as now_, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' and n_regionkey <> 2 group by 1
    union all select n_name, 0, count(*) from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 or n_nationkey not in (select c_nationkey from customer where c_mktsegment = 'BUILDING') group by 1""")
def fallback_partitions(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("key"), "c_custkey", "c_mktsegment", "n_regionkey")
    found = rows.where("c_mktsegment = 'BUILDING'").select("key", "c_custkey", F.lit(1).cast("long").alias("now_"))
    out = N.with_fallback(found, rows.select("key", "c_custkey", F.lit(0).cast("long").alias("now_")), "key", rows.where("n_regionkey = 2").select("key").distinct())
    return out.groupBy("key", "now_").agg(F.count("*").alias("n"))


@query("""with p as (select n_nationkey, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1), q as (select c_nationkey, count(*) as n from customer where c_acctbal > 9500 group by 1)
    select p.n_nationkey as nation, coalesce(q.n, p.n) as n from p left join q on q.c_nationkey = p.n_nationkey where q.n is not null or p.n >= 2""")
def vanished_partitions(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation")
    return N.vanished(c, c.where("c_acctbal > 9500"), "nation").groupBy("nation").agg(F.count("*").alias("n"))


@query("""with p as (select c_nationkey as nation, count(*) as previous from customer group by 1), q as (select c_nationkey as nation, count(*) as n from customer where c_acctbal > 5000 group by 1), b as (select p.*, coalesce(q.n, 0) as current from p left join q using (nation)),
    r as (select *, case when previous >= 2 and current = 0 then 'pref_zero' when previous >= 5 and current * 10 < previous * 4 then 'pref_sharp_drop' when previous >= 3 and current * 10 < previous * 7 then 'pref_drop' end as rule from b)
    select nation, previous, current, rule, case when rule = 'pref_drop' then 'warning' else 'error' end as level from r where rule is not null""")
def partition_alerts(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation")
    return N.partition_alerts(c, c.where("c_acctbal > 5000"), "nation")


@query("""with m as (select c_nationkey as nation, count(*) as missing from customer where c_acctbal < 2000 group by 1), p as (select c_nationkey as nation, count(*) as previous from customer group by 1)
    select nation, missing, previous, case when missing >= 3 and missing * 10 >= previous * 3 then 'error' else 'warning' end as level from m join p using (nation)""")
def missing_levels(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nation")
    gone = c.where("c_acctbal < 4000").withColumn("reason", F.when(F.col("c_acctbal") < 2000, "unexplained").otherwise("merged"))
    return N.missing_levels(gone, c, "nation")


@query("""with t as (select o_orderpriority as p, count(*) filter (o_orderstatus <> 'P') as a, count(*) filter (o_orderstatus = 'F') as b, count(*) as n from orders group by 1) select p, case when (n - a) / n >= 0.35 then 'error' when (n - a) / n >= 0.2 then 'warning' end as few, case when (n - b) / n >= 0.35 then 'error' when (n - b) / n >= 0.2 then 'warning' end as many from t""")
def total_drops(spark, sf):
    n = lambda c: F.count(F.when(c, 1))
    t = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(n(F.expr("o_orderstatus <> 'P'")).alias("a"), n(F.expr("o_orderstatus = 'F'")).alias("b"), F.count("*").alias("n"))
    return t.select("p", Q.drop_level(F.col("n"), F.col("a")).alias("few"), Q.drop_level(F.col("n"), F.col("b")).alias("many"))


@query(f"""select id, 'time' as field, cast(case when k % 4 = 0 then 1 + k % 12 else 1 end as bigint) as count, case when k % 4 = 0 then date else '{TODAY}' end as since, '{TODAY}' as last, k % 4 = 0 and 1 + k % 12 >= 9 as stale from {EV} where k % 2 = 0""")
def carry_states(spark, sf):
    e = events(spark, sf)
    state = e.where("k % 4 = 0 or k % 5 = 0").where("k % 4 = 0 or k % 2 = 1").select("id", F.lit("time").alias("field"), (F.col("k") % 12).cast("long").alias("count"), F.col("date").alias("since"))
    return N.carry_state(state, e.where("k % 2 = 0").select("id", F.lit("time").alias("field")), TODAY).withColumn("count", F.col("count").cast("long"))


@query(f"""select id, case when k % 3 = 0 and k % 2 <> 0 then 'entered' when k % 5 = 0 then 'published' else 'gone' end as action, '{TODAY}' as day from {EV} where (k % 3 = 0) <> (k % 2 = 0)""")
def quarantine_history(spark, sf):
    e = events(spark, sf)
    return N.quarantine_history(e.where("k % 2 = 0"), e.where("k % 3 = 0"), e.where("k % 5 = 0"), TODAY)


@query(f"""with n as (select *, row_number() over (order by date, id) as r from {EV} where k % 3 = 0) select count(*) as n, string_agg(pref, ',' order by r) filter (r <= 3) as titles from n""")
def new_rows(spark, sf):
    e = events(spark, sf)
    return N.news(e.where("k % 3 <> 0"), e, ["date", "id"], "pref").select("n", F.array_join("titles", ",").alias("titles"))


@query(f"""with p as (select * from {EV} where date < '{TODAY}' and date >= '1996-01-01' and date <= '1998-01-31' and s = 'F' and contains(lower(pref || ' ' || c), 'urgent')) select id, date, (select count(*) from p) as total, (select count(*) from p) > 3 + 20 as has_more from p order by date desc, k desc limit 20 offset 3""")
def past_page(spark, sf):
    e = events(spark, sf).withColumn("endDate", F.lit(None).cast("string"))
    row = {"date": F.col("date"), "endDate": F.col("endDate"), "status": F.col("s"), "pref": F.col("pref"), "office": F.lit(""), "title": F.col("pref"), "place": F.col("c").cast("string")}
    hit = Q.past(F.col("endDate"), F.col("date"), F.lit(TODAY)) & Q.past_match(row, from_="1996-01-01", to="1998-01-31", status="F", q="URGENT")
    return N.page_of(e.where(hit), [F.col("date").desc(), F.col("k").desc()], 3, 20).select("id", "date", "total", "has_more")


@query(f"select pref, count(*) filter (date < '{TODAY}') as ended, count(*) filter (date >= '1998-06-08') as retained from {EV} group by pref")
def retained_rows(spark, sf):
    none, today = F.lit(None).cast("string"), F.lit(TODAY)
    return events(spark, sf).groupBy("pref").agg(F.count(F.when(Q.ended(none, F.col("date"), today), 1)).alias("ended"), F.count(F.when(Q.retained(none, F.col("date"), today), 1)).alias("retained"))


@query("""with f as (select p_name as key, min(p_partkey) as first, max(p_partkey) as last from part group by 1), a as (select f.*, p_size from f join part on p_partkey = last), r as (select *, row_number() over (order by case when p_size < 10 then 0 when p_size < 30 then 1 else 2 end, first, key) as n from a)
    select key, last, case when n <= 10 then 'now' else 'deferred' end as state from r""")
def planned_assets(spark, sf):
    rank = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    rows = table(spark, sf, "part").withColumnRenamed("p_name", "key")
    return N.planned(rows, "key", "p_partkey", rank, 10).select("key", F.col("p_partkey").alias("last"), "state")


@query("""with c as (select c_nationkey as nation, count(*) filter (c_acctbal > 9000) as n from customer group by 1), e as (select a.n_nationkey as nation, b.n_nationkey as neighbour from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey)
    select e.nation, e.neighbour, c.n from e join c on c.nation = e.neighbour and c.n > 0 where e.nation not in (select nation from c where n > 0)""")
def empty_neighbours(spark, sf):
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").alias("nation"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("neighbour"), "n_regionkey"), "n_regionkey").where("nation <> neighbour").select("nation", "neighbour")
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.when(F.col("c_acctbal") > 9000, 1)).alias("n"))
    return N.neighbours(counts, edges, "nation")


@query("""select o_orderkey, e.event_type as target, count(*) as n from orders join events e on e.user_id = o_custkey where o_orderstatus = 'P' group by all""")
def fanned_out(spark, sf):
    o = table(spark, sf, "orders")
    changes = o.where("o_orderstatus = 'P'").select("o_orderkey")
    watchers = o.select("o_orderkey", F.col("o_custkey").alias("who"))
    targets = table(spark, sf, "events").select(F.col("user_id").alias("who"), F.col("event_type").alias("target"))
    return N.fan_out(changes, watchers, targets, "o_orderkey", "who").groupBy("o_orderkey", "target").agg(F.count("*").alias("n"))


@query("""select o_orderkey, case when c_custkey is null then 'miss' when c_acctbal < 0 then 'negative' else 'hit' end as state from orders left join customer on c_custkey = o_custkey and c_mktsegment <> 'FURNITURE'""")
def cache_probes(spark, sf):
    cache = table(spark, sf, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"))
    return N.probed(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), cache, "key", "name").select("o_orderkey", "state")


@query("""with l as (select user_id, max(ts) as t from events group by 1) select c_custkey as user_id, case when t is null then 'offline' when epoch(timestamp '2024-01-30 12:00:00') - floor(epoch(t)) <= 120 then 'online' when epoch(timestamp '2024-01-30 12:00:00') - floor(epoch(t)) <= 600 then 'away' else 'offline' end as state from customer left join l on user_id = c_custkey""")
def presence_roster(spark, sf):
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return N.roster(members, table(spark, sf, "events"), "user_id", F.lit("2024-01-30 12:00:00").cast("timestamp"), "ts").select("user_id", "state")


@query("""select s_name as name, 'o' || (9 + row_number() over (order by s_suppkey)) as key from supplier where s_suppkey % 3 <> 0""")
def next_numbers(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    known = s.where("s_suppkey % 3 = 0").select("name", F.when(F.col("s_suppkey") == 0, "o9").otherwise("x77").alias("key"))
    return N.next_names(s.select("name", "s_suppkey"), known, "name", "o", ["s_suppkey"]).select("name", "key")


@query("""with s as (select *, p_size // 20 as score from part) select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by score desc, length(p_name), p_name, p_partkey) as r from s where score >= 1) where r = 1""")
def best_pages(spark, sf):
    p = table(spark, sf, "part").withColumn("title", F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return N.best_page(p, "p_brand", F.floor(F.col("p_size") / 20), "title").select("p_brand", "p_partkey")


@query("""with a as (select o_custkey as c, list(o_orderkey order by o_orderkey) as x, list(o_totalprice order by o_orderkey) filter (o_orderstatus = 'F') as y from orders group by 1), g as (select c, x, y, unnest(range(greatest(len(x), coalesce(len(y), 0)))) as pos from a)
    select c, pos, x[pos + 1] as x, y[pos + 1] as y from g""")
def zipped_arrays(spark, sf):
    ordered = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("o_orderkey", c)))), lambda s: s[c])
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"), ordered("o_totalprice", F.col("o_orderstatus") == "F").alias("y"))
    return L.zipped(a, ["x", "y"], ["c"]).withColumn("pos", F.col("pos").cast("long"))


@query("""select p_brand, round(avg(p_size), 4) as lat from part group by 1""")
def averaged_points(spark, sf):
    return L.averaged(table(spark, sf, "part").withColumn("lat", F.col("p_size")), ["p_brand"], ["lat"], 4)


@query("""with s as (select o_custkey as c, min(o_totalprice) as v, strftime(o_orderdate, '%Y-%m-%d') as d from orders where o_orderstatus = 'F' group by 1, 3) select o_orderkey, s.v from orders left join s on s.c = o_custkey and s.d = strftime(o_orderdate, '%Y-%m-%d')""")
def forecast_days(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumnRenamed("o_custkey", "c")
    days = o.where("o_orderstatus = 'F'").groupBy("c", "date").agg(F.min("o_totalprice").alias("v"))
    series = days.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("date", "v"))).alias("x")).select("c", F.col("x.date").alias("dates"), F.col("x.v").alias("v"))
    return L.by_date(o.select("o_orderkey", "c", "date"), series, "c", "date", "dates", ["v"]).select("o_orderkey", "v")


@query(f"""select case when k % 50 = 0 then '日程未定' else cast(year(cast(date as date)) as varchar) || '年' || month(cast(date as date)) || '月' end as label, case when k % 50 = 0 then '9999-99' else left(date, 7) end as place, count(*) as n from {EV} group by 1, 2""")
def month_groups(spark, sf):
    return L.month_groups(events(spark, sf).withColumn("date", F.when(F.col("k") % 50 == 0, None).otherwise(F.col("date"))), "date")


@query("""select c_custkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 6) as km, round((degrees(atan2(sin(radians(l2 - 139)) * cos(radians(l1)), cos(radians(35)) * sin(radians(l1)) - sin(radians(35)) * cos(radians(l1)) * cos(radians(l2 - 139)))) + 360) % 360, 6) as bearing from
    (select *, pow(sin(radians(l1 - 35) / 2), 2) + cos(radians(35)) * cos(radians(l1)) * pow(sin(radians(l2 - 139) / 2), 2) as a from (select c_custkey, 30 + (c_custkey % 97) / 10.0 as l1, 130 + (c_custkey % 89) / 10.0 as l2 from customer))""")
def distances(spark, sf):
    at = [F.lit(35.0), F.lit(139.0), 30 + (F.col("c_custkey") % 97) / 10.0, 130 + (F.col("c_custkey") % 89) / 10.0]
    return table(spark, sf, "customer").select("c_custkey", F.round(S.haversine_m(*at, radius=6371.0), 6).alias("km"), F.round(S.bearing(*at), 6).alias("bearing"))


@query("""with r(n, of_) as (values (1, null), (2, null), (3, 2), (4, null)) select p_partkey, cast(n as bigint) as n, cast(of_ as bigint) as of_ from part, r""")
def marked_twins(spark, sf):
    """Of four rows a part: 3 is like 2 (title within it, place around it); 1 is at another place, 4 another title."""
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(t).alias("t"), F.lit(p).alias("pl")) for n, t, p in ((1, "はたらく車", "港"), (2, "はたらく車大集合", "会館 前"), (3, "はたらく車", "会館前広場"), (4, "音楽", "会館前"))])).alias("x")).select("p_partkey", "x.*")
    return E.marked_duplicates(rows, ["p_partkey"], "n", "t", "pl", ["n"]).select("p_partkey", "n", F.col("duplicate_of").alias("of_"))


@query("""select p_partkey, cast(unnest([3, 4, 6]) as bigint) as n from part""")
def folded_leaders(spark, sf):
    """Of six rows a part: 3 takes the place of 1 and 2 (contained, higher score), 4 is at another place, 6 joins 5 by its asset and replaces it."""
    samples = ((1, "合同企業説明会東", "港", "", 5), (2, "合同企業説明会東北", "", "", 4), (3, "第一合同企業説明会東", "港", "", 9), (4, "合同企業説明会東", "会館", "", 3), (5, "祭り", "山", "f", 1), (6, "祭り", "川", "f", 2))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(t).alias("t"), F.lit(p).alias("pl"), F.lit(a).alias("a"), F.lit(s).alias("s")) for n, t, p, a, s in samples])).alias("x")).select("p_partkey", "x.*")
    return E.leaders(rows, ["p_partkey"], "t", "s", ["n"], "pl", "a").select("p_partkey", "n")


@query("""with b as (select c_custkey as k, case when c_custkey % 7 = 0 then 'a' || (c_custkey % 5) || '-' || (2 + c_custkey % 4) else 'a' || (c_custkey % 5) end as id from customer), f as (select *, row_number() over (partition by id order by k) as n from b),
    c as (select id as base, unnest(range(2, 400)) as m from (select distinct id from b)), free as (select base, m, 1 + row_number() over (partition by base order by m) as n from c where base || '-' || m not in (select id from b))
    select k, case when f.n = 1 then id else id || '-' || m end as name from f left join free on base = id and free.n = f.n""")
def unique_collisions(spark, sf):
    k = F.col("c_custkey")
    base = F.concat(F.lit("a"), k % 5)
    rows = table(spark, sf, "customer").select(k.alias("k"), F.when(k % 7 == 0, F.concat(base, F.lit("-"), 2 + k % 4)).otherwise(base).alias("id"))
    return W.uniquify(rows, "id", ["k"], "name").select("k", "name")


@query("""select p_partkey, (row_number() over (order by p_partkey) - 1 - (3 * 17) % 23 + 2300) % 23 as turn from part""")
def rotated_parts(spark, sf):
    return W.rotated(table(spark, sf, "part"), ["p_partkey"], 3, 23).select("p_partkey", F.col("turn").cast("long").alias("turn"))


#: Names of parts in kana, and orders' titles that hold one: after a letter of a longer name, after a word that ends, before the festival.
KANA = "アイウエオカキクコサシスセソタチツテトナニヌネノハ"
PART_NAMES = f"(select distinct translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '{KANA}') as stem from part)"


@query(f"""with n as (select stem || '基地' as name, stem from {PART_NAMES}),
    p as (select p_partkey, translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '{KANA}') as stem from part),
    o as (select o_orderkey, case o_orderkey % 5 when 0 then '北' when 1 then '航空自衛隊' when 2 then 'A' else '' end || stem || case when o_orderkey % 5 = 3 then '航空祭' when o_orderkey % 7 = 0 then '' else '基地' end || o_orderkey as t from orders join p on p_partkey = o_orderkey % (select count(*) from part)),
    h as (select o_orderkey, name, 1 as r from o join n on contains(t, name) where not regexp_matches(left(t, instr(t, name) - 1), '[一-龥ぁ-んァ-ヶ]$') or regexp_matches(left(t, instr(t, name) - 1), '(自衛隊|空自|陸自|海自|航空|海上|陸上|・)$')
        union all select o_orderkey, name, 0 from o join n on contains(t, stem || '航空祭')),
    b as (select *, row_number() over (partition by o_orderkey order by r desc, length(name) desc, name desc) as i from h)
    select o.o_orderkey, b.name from o left join b on b.o_orderkey = o.o_orderkey and b.i = 1""")
def named_facilities(spark, sf):
    stem = F.translate(F.replace("p_name", F.lit(" "), F.lit("")), "abcdefghijklmnopqrstuvwxyz", KANA)
    part = table(spark, sf, "part").select("p_partkey", stem.alias("stem"))
    k, size = F.col("o_orderkey"), part.agg(F.count("*").alias("size"))
    head = F.when(k % 5 == 0, "北").when(k % 5 == 1, "航空自衛隊").when(k % 5 == 2, "A").otherwise("")
    tail = F.when(k % 5 == 3, "航空祭").when(k % 7 == 0, "").otherwise("基地")
    orders = table(spark, sf, "orders").join(F.broadcast(size)).select("o_orderkey", (k % F.col("size")).alias("p_partkey")).join(part, "p_partkey")
    texts = orders.select("o_orderkey", F.concat(head, F.left("stem", F.lit(2)), F.lit(" "), F.substr("stem", F.lit(3)), tail, k.cast("string")).alias("t"))
    return C.longest_name(texts, part.select(F.concat("stem", F.lit("基地")).alias("name")), "o_orderkey", "t", "name")


@query("""with w as (select doc_id, regexp_replace(text, '[\\s　]+', '', 'g') as t from documents where text is not null), n as (select distinct replace(substr(t, 1 + doc_id % 50, 12 + doc_id % 9), 'ケ', 'ヶ') as name from w where doc_id % 25 = 0 and length(t) >= 80),
    h as (select doc_id, name, row_number() over (partition by doc_id order by length(name) desc, name desc) as i from w join n on contains(w.t, name) where not regexp_matches(left(w.t, instr(w.t, name) - 1), '[一-龥ぁ-んァ-ヶ]$'))
    select doc_id, name from documents left join h using (doc_id) where i = 1 or i is null""".replace("\\\\", "\\"))
def longest_passages(spark, sf):
    """Passages of a document in 25, cut from anywhere near its start, looked for in all documents without their blanks."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    t = F.regexp_replace("text", r"[\s　]+", "")
    names = d.where("doc_id % 25 = 0").where(F.char_length(t) >= 80).select(F.substr(t, (1 + F.col("doc_id") % 50).cast("int"), (12 + F.col("doc_id") % 9).cast("int")).alias("name"))
    return C.longest_name(d, names, "doc_id", "text", "name")


FACETS = {"status": "o_orderstatus = 'F'", "priority": "o_orderpriority in ('1-URGENT', '2-HIGH')", "year": "year(o_orderdate) = 1997", "price": "o_totalprice > 100000"}


@query("select 'list' as facet, '' as value, count(*) as n from orders where " + " and ".join(FACETS.values()) + "".join(
    f" union all select '{name}', cast({value} as varchar), count(*) from orders where " + " and ".join(f for n, f in FACETS.items() if n != name) + " group by 2"
    for name, value in (("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("year", "year(o_orderdate)"))))
def facets_lifted(spark, sf):
    """The list under four filters, and each facet's values with its own filter lifted, in one scan."""
    values = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")}
    return A.lifted_facets(table(spark, sf, "orders"), {n: F.expr(f) for n, f in FACETS.items()}, values)


@query("""with k as (select c_custkey, c_mktsegment, c_custkey % 5 as kanji from customer) select c_custkey, row_number() over (partition by c_mktsegment order by kanji = 0, c_custkey) as rank from k""")
def locale_ranks(spark, sf):
    """Names of customers in kana, every second one in the other script and every fifth behind a kanji, in Japanese order."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    kana = F.when(F.col("c_custkey") % 2 == 0, F.translate(digits, "0123456789", "あいうえおかきくけこ")).otherwise(F.translate(digits, "0123456789", "アイウエオカキクケコ"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("亜"), kana)).otherwise(kana).alias("name"))
    return W.locale_ranked(rows, ["c_mktsegment"], "name", ["c_custkey"]).select("c_custkey", "rank")


MISREAD = {"the": "th", "then": "than", "thi": "they", "an": "on", "ion": "ian", "tha": "the", "e": "é"}
ONCE = "list_transform(regexp_extract_all({}, '(?s)" + "|".join(sorted(MISREAD, key=len, reverse=True)) + "|.'), lambda x: coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in MISREAD.items()) + "}[x], x))"


def _again(t: str, times: int) -> str:
    return t if not times else f"array_to_string({ONCE.replace('{}', _again(t, times - 1), 1)}, '')"


@query(f"select doc_id, md5({_again('text', 3)}) as digest from documents")
def corrected_texts(spark, sf):
    """Overlapping and nested misreadings in all documents: what one round writes the next may correct."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.corrected(F.col("text"), MISREAD)).alias("digest"))


@query("""with o as (select o_orderkey as k from orders),
    n as (select k, k % 5 <> 0 as hit, k % 7 <> 0 as titled, case when k % 4 = 0 then null when k % 4 = 1 then '見学会 ' || k || 'a' when k % 4 = 2 then '新見学会' || k else '見学会 ' || k || 'A' end as t, case when k % 3 = 0 then '別館' when k % 3 = 1 then null else '本館' end as p from o),
    c as (select *, hit and titled and k % 4 in (0, 2) as ct, hit and k % 3 <> 2 as cp from n)
    select k as id, case when ct then t else '見学会 ' || k || 'A' end as title, case when cp then p else '本館' end as place, '10:00' as time,
    concat_ws(';', case when ct then 'title:' || coalesce(t, '-') end, case when cp then 'place:' || coalesce(p, '-') end) as changes from c""")
def rechecked_rows(spark, sf):
    """A second reading of four orders in five: other spelling, other values, nothing found, fields that were not read."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey")
    own = F.concat(F.lit("見学会 "), k.cast("string"), F.lit("A"))
    rows = orders.select(k.alias("id"), own.alias("title"), F.lit("本館").alias("place"), F.lit("10:00").alias("time"))
    title = F.when(k % 4 == 0, "不明").when(k % 4 == 1, F.concat(F.lit(" 見学会　"), k.cast("string"), F.lit("ａ"))).when(k % 4 == 2, F.concat(F.lit("新見学会"), k.cast("string"))).otherwise(own)
    place = F.when(k % 3 == 0, "別館 ").when(k % 3 == 1, F.lit(None)).otherwise("本 館")
    keys = F.when(k % 7 == 0, F.array(F.lit("place"))).otherwise(F.array(F.lit("title"), F.lit("place")))
    readings = orders.where("o_orderkey % 5 <> 0").select(k.alias("id"), keys.alias("keys"), title.alias("title"), place.alias("place"), F.lit("x").alias("time"))
    shown = F.transform("changes", lambda c: F.concat_ws(":", c["field"], F.coalesce(c["after"], F.lit("-"))))
    return J.rechecked(rows, readings, "id", ["title", "place", "time"]).withColumn("changes", F.array_join(shown, ";"))


@query("""select o_orderkey as id, case when o_orderkey % 2 = 0 then '自' || o_orderkey when o_orderkey % 3 = 0 then '読' || o_orderkey end as title, case when o_orderkey % 3 = 0 then '11:00' when o_orderkey % 2 = 0 then '10:00' end as time,
    case when o_orderkey % 6 = 0 then '備考' || chr(10) || '抽選' when o_orderkey % 3 = 0 then '抽選' when o_orderkey % 2 = 0 then '備考' end as notes, case when o_orderkey % 2 = 0 then 'https://a.jp/' when o_orderkey % 9 = 0 then 'https://b.jp/' end as url from orders""")
def rows_with_readings(spark, sf):
    """Orders with fields of their own (even ones) and those read from a picture (every third), by each field's own order."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey")
    even = lambda c: F.when(k % 2 == 0, c).otherwise("")
    mark = lambda s: F.concat(F.lit(s), k.cast("string"))
    rows = orders.select(k.alias("id"), even(mark("自")).alias("title"), even(F.lit("10:00")).alias("time"), even(F.lit("備考")).alias("notes"), even(F.lit("https://a.jp/")).alias("url"))
    link = F.when(k % 9 == 0, "https://b.jp/ ").otherwise("b.jp")
    readings = orders.where("o_orderkey % 3 = 0").select(k.alias("id"), mark("読").alias("title"), F.lit("11:00").alias("time"), F.lit("抽選").alias("notes"), link.alias("url"))
    return J.with_reading(rows, readings, "id", ["title"], ["time"], ["notes"], ["url"])
