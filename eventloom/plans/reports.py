"""Each operator applied to whole supplied tables, with the same result as SQL. Keys name what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import scalars as S
from eventloom.operators import aggregates as A
from eventloom.operators import entities as E
from eventloom.operators import joins as J
from eventloom.operators import windows as W
from eventloom.sources import pages as P
from eventloom.sources import sinks as K
from eventloom.sources.tables import table

TODAY = "2024-01-30"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def text_day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


@query("""select user_id, count(*) filter (d = date '2024-01-30') as d1, count(*) filter (d between date '2024-01-24' and date '2024-01-30') as d7,
    count(*) filter (d between date '2024-01-01' and date '2024-01-30') as d30, count(*) as total
    from (select user_id, cast(ts + interval 9 hour as date) d from events) group by user_id""")
def trailing_views(spark: SparkSession, sf: str) -> DataFrame:
    return W.trailing(table(spark, sf, "events"), ["user_id"], S.tokyo_day(F.col("ts")), TODAY)


@query("""select event_type, strftime(day, '%Y-%m-%d') as day, count(e.ts) as n
    from (select distinct event_type from events), (select cast(unnest(generate_series(timestamp '2023-12-25', timestamp '2024-02-05', interval 1 day)) as date) as day)
    left join (select event_type as t, ts, cast(ts + interval 9 hour as date) as d from events) e on e.t = event_type and e.d = day group by all""")
def daily_series(spark, sf):
    out = W.daily_series(table(spark, sf, "events"), "event_type", S.tokyo_day(F.col("ts")), "2023-12-25", "2024-02-05")
    return out.withColumn("day", text_day("day"))


@query("""with recursive a as (select user_id, event_type, min(ts) as ts from events group by all
    union all select a.user_id, a.event_type, min(e.ts) from a join events e on e.user_id = a.user_id and e.event_type = a.event_type and e.ts >= a.ts + interval 6 hour group by a.user_id, a.event_type, a.ts)
    select user_id, event_type, count(*) as n, max(epoch_us(ts)) as last_us from a group by all""")
def first_accept_six_hours(spark, sf):
    got = W.first_accept(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 6 * 3600)
    return got.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.unix_micros("ts")).alias("last_us"))


@query("""select user_id, begins, ends, n from (select user_id, min(event_id) as begins, max(event_id) as ends, count(*) as n from
    (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type = 'view' order by event_id) as g from events)
    where event_type = 'view' group by user_id, g)""")
def consecutive_runs(spark, sf):
    return W.runs(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type") == "view")


@query("""select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as last_user_turn from conversations""")
def carry_last_turn(spark, sf):
    rows = table(spark, sf, "conversations")
    return W.carry_last(rows, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "last_user_turn").select("conv_id", "turn", "role", "last_user_turn")


@query("""select doc_id, case when n = 1 then source else source || '-' || n end as name from (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents)""")
def unique_names(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return W.uniquify(rows, "source", ["doc_id"], "name").select("doc_id", "name")


@query("""select 'status' as facet, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2
    union all select 'in_1998', 'yes', count(*) from orders where o_orderdate between timestamp '1998-01-01' and timestamp '1998-12-31' having count(*) > 0
    union all select 'large', 'yes', count(*) from orders where o_totalprice >= 300000 having count(*) > 0""")
def order_facets(spark, sf):
    day = F.to_date("o_orderdate")
    flags = {"in_1998": day.between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")), "large": F.col("o_totalprice") >= 300000}
    return A.facets(table(spark, sf, "orders"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, flags)


@query("""with o as (select o_orderstatus as s, strftime(o_orderdate, '%Y-%m') as m, o_orderpriority as p, cast(round(o_totalprice * 100) as bigint) as c from orders)
    select 'status' as dim, s as key, count(*) as n, cast(sum(c) as bigint) as cents from o group by s union all select 'month', m, count(*), cast(sum(c) as bigint) from o group by m
    union all select 'priority', p, count(*), cast(sum(c) as bigint) from o group by p union all select 'total', '', count(*), cast(sum(c) as bigint) from o""")
def order_summary(spark, sf):
    groups = {"status": F.col("o_orderstatus"), "month": F.date_format("o_orderdate", "yyyy-MM"), "priority": F.col("o_orderpriority")}
    return A.summary(table(spark, sf, "orders"), groups, {"cents": cents("o_totalprice")})


@query("""select coalesce(r_name, 'all') as region, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal >= 0 group by rollup (r_name)""")
def region_rollup(spark, sf):
    rows = table(spark, sf, "customer").where("c_acctbal >= 0").join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))
    return rows.rollup("r_name").agg(F.count("*").alias("n")).select(F.coalesce("r_name", F.lit("all")).alias("region"), "n")


@query("""select n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and c_acctbal < -900 group by n_name""")
def zero_filled_nations(spark, sf):
    dim = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("c_nationkey"))
    return A.zero_filled(table(spark, sf, "customer"), dim, "c_nationkey", F.col("c_acctbal") < -900).select("n_name", "n")


@query("""with s as (select o_orderkey, min(cast(o_orderdate as date)) as a, max(cast(l_shipdate as date)) as b from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey),
    p as (select * from (values ('day', date '1998-06-15', date '1998-06-15'), ('week', date '1998-06-15', date '1998-06-21'), ('month', date '1998-06-01', date '1998-06-30')) t(period, f, t))
    select period, count(*) as n from s join p on a <= t and b >= f group by period""")
def overlapping_periods(spark, sf):
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("b"))
    spans = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a")).join(ships, "o_orderkey")
    return A.overlaps(spans, F.col("a"), F.col("b"), {"day": ("1998-06-15", "1998-06-15"), "week": ("1998-06-15", "1998-06-21"), "month": ("1998-06-01", "1998-06-30")})


@query("""with s as (select cast(o_orderdate as date) as a, max(cast(l_shipdate as date)) as b from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate)
    select strftime(d, '%Y-%m-%d') as day, count(*) as n from (select cast(unnest(generate_series(cast(a as timestamp), cast(greatest(a, least(b, a + 59)) as timestamp), interval 1 day)) as date) as d from s) group by 1""")
def open_orders_by_day(spark, sf):
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("b"))
    spans = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a")).join(ships, "o_orderkey")
    return A.by_day(spans, F.col("a"), F.col("b")).withColumn("day", text_day("day"))


@query("""select p_partkey, p_name, p_brand from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring') order by p_name desc, p_partkey limit 50 offset 5""")
def search_page(spark, sf):
    rows = table(spark, sf, "part")
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.lower(c).contains("ring")
    return W.page(rows.where(hit), [F.col("p_name").desc(), F.col("p_partkey")], 5, 50).select("p_partkey", "p_name", "p_brand")


@query("""select o_custkey, o_orderkey, rk from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate, o_orderkey) as rk from orders) where rk <= 3""")
def top_orders(spark, sf):
    order = [F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")]
    return W.top(table(spark, sf, "orders"), ["o_custkey"], order, 3).select("o_custkey", "o_orderkey", "rk")


@query("""with nxt as (select * from orders where o_orderstatus <> 'P')
    select o_orderkey, case when o_totalprice > 400000 then 'quarantined' when exists (select 1 from nxt where nxt.o_custkey = orders.o_custkey and nxt.o_orderpriority = orders.o_orderpriority) then 'merged' else 'unexplained' end as reason
    from orders where o_orderstatus = 'P'""")
def missing_with_reason(spark, sf):
    before = table(spark, sf, "orders")
    now = before.where("o_orderstatus <> 'P'")
    reasons = [("quarantined", before.where("o_totalprice > 400000"), ["o_orderkey"]), ("merged", now, ["o_custkey", "o_orderpriority"])]
    return J.missing(before, now, "o_orderkey", reasons).select("o_orderkey", "reason")


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice >= 100000 then o_orderpriority when o_orderstatus = 'F' then '' else o_orderpriority end as o_orderpriority,
    case when o_orderstatus = 'F' and o_totalprice >= 100000 then 'o_orderpriority' else '' end as carried from orders""")
def carried_fields(spark, sf):
    before = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    lost = F.col("o_orderstatus") == "F"
    now = before.withColumn("o_orderpriority", F.when(lost, "").otherwise(F.col("o_orderpriority"))).withColumn("o_custkey", F.when(F.col("o_totalprice") < 100000, -1).otherwise(F.col("o_custkey")))
    out = J.carry_forward(now, before, "o_orderkey", ["o_orderpriority"], ["o_custkey"])
    return out.select("o_orderkey", "o_orderpriority", F.array_join("carried", ",").alias("carried"))


@query("""select o_orderkey, case when o_totalprice > 250000 and o_orderstatus = 'O' then null when o_totalprice > 250000 then 'HELD' else o_orderstatus end as o_orderstatus from orders""")
def overlaid_patches(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    patches = rows.where("o_totalprice > 250000").select("o_orderkey", F.array(F.lit("o_orderstatus")).alias("keys"), F.when(F.col("o_orderstatus") != "O", "HELD").alias("o_orderstatus"))
    return J.overlay(rows, patches, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query("""select o_orderkey, concat_ws(',', case when o_orderstatus = 'P' then 'o_orderstatus' end, case when o_totalprice < 50000 then 'o_totalprice' end) as changed from orders where o_orderstatus = 'P' or o_totalprice < 50000""")
def changed_fields(spark, sf):
    before = table(spark, sf, "orders")
    now = before.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_totalprice") < 50000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return J.changed_fields(before, now, "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("""select s_suppkey from supplier s where not exists (select 1 from customer where c_custkey = s_suppkey and c_nationkey = s_nationkey)
    and not exists (select 1 from customer where cast(floor(c_acctbal) as bigint) = cast(floor(s_acctbal) as bigint)) and not exists (select 1 from customer where substr(c_name, 1, 8) = substr(s_name, 1, 8))""")
def without_twins(spark, sf):
    keys = [(F.struct("s_suppkey", "s_nationkey"), F.struct("c_custkey", "c_nationkey")), (F.floor("s_acctbal"), F.floor("c_acctbal")), (F.substring("s_name", 1, 8), F.substring("c_name", 1, 8))]
    return J.without_twins(table(spark, sf, "supplier"), table(spark, sf, "customer"), keys).select("s_suppkey")


@query("""with c as (select c_custkey, 35 + (c_custkey * 37 % 1000) / 800.0 as lat, 139 + (c_custkey * 53 % 1000) / 800.0 as lon from customer), s as (select s_suppkey, 35 + (s_suppkey * 91 % 1000) / 800.0 as la, 139 + (s_suppkey * 67 % 1000) / 800.0 as lo from supplier),
    d as (select c_custkey, s_suppkey, cast(round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2))))) as bigint) as metres from c, s where abs(la - lat) < 0.1)
    select * from (select *, row_number() over (partition by c_custkey order by metres, s_suppkey) as rk from d where metres <= 5000) where rk <= 5""")
def nearest_suppliers(spark, sf):
    place = lambda t, k, a, b: table(spark, sf, t).select(k, (35 + (F.col(k) * a % 1000) / 800.0).alias("lat"), (139 + (F.col(k) * b % 1000) / 800.0).alias("lon"))
    return J.nearest(place("customer", "c_custkey", 37, 53), place("supplier", "s_suppkey", 91, 67), 5000, 5, "c_custkey", "s_suppkey")


@query("""with names as (select distinct p_name as name from part where p_type = 'PROMO' union select distinct split_part(p_name, ' ', 2) from part), hits as (select p_partkey, name, row_number() over (partition by p_partkey order by length(name) desc, name desc) as r
    from part join names on contains(' ' || p_name || ' ', ' ' || name || ' ')) select part.p_partkey, name from part left join (select * from hits where r = 1) h on h.p_partkey = part.p_partkey""")
def longest_contained_name(spark, sf):
    parts = table(spark, sf, "part")
    names = parts.where("p_type = 'PROMO'").select(F.col("p_name").alias("name")).union(parts.select(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return J.longest_contained(parts, names, "p_partkey", "p_name", "name", 3)


@query("""select coalesce(a.k, b.k) as nation, coalesce(a.n, 0) as customers, coalesce(b.n, 0) as suppliers from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by 1) a full join (select s_nationkey as k, count(*) as n from supplier where s_acctbal < 2000 group by 1) b on a.k = b.k""")
def full_outer_counts(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal < 2000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").fillna(0, ["customers", "suppliers"])


@query("""with a as (select distinct user_id from events where ts < timestamp '2024-01-04'), b as (select distinct user_id from events where ts >= timestamp '2024-01-28')
    select coalesce(a.user_id, b.user_id) as user_id, case when a.user_id is null then 'entered' when b.user_id is null then 'left' else 'stayed' end as state from a full join b on a.user_id = b.user_id""")
def user_transitions(spark, sf):
    e = table(spark, sf, "events")
    return J.transitions(e.where("ts < timestamp'2024-01-04'"), e.where("ts >= timestamp'2024-01-28'"), "user_id")


@query("""select c_custkey as id, coalesce(case when c_custkey <> s_suppkey then null else s_name end, n_name, r_name) as name, case when s_suppkey is not null then 'supplier' when n_nationkey is not null then 'nation' end as found_by
    from (select c_custkey, c_nationkey from customer) left join supplier on s_suppkey = c_custkey left join nation on n_nationkey = c_nationkey left join region on false""")
def fallback_chain(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("supplier"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"))
    known = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"))
    known = known.union(table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name"))
    return J.fallback(rows, "id", ["supplier", "nation"], known, "key", "name")


@query("""select p_partkey, case when p_size > 40 then 'XL' when p_type = 'PROMO' then 'SALE' else p_type end as p_type, case when p_type = 'PROMO' then 'none' else p_brand end as p_brand from part""")
def overridden_parts(spark, sf):
    rules = [(F.col("p_type") == "PROMO", {"p_type": "SALE", "p_brand": "none"}), (F.col("p_size") > 40, {"p_type": "XL"}), (F.col("p_type") == "SALE", {"p_brand": "never"})]
    return J.overridden(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size"), rules).drop("p_size")


@query("""with u as (select o_orderkey, 'old' as origin, 0 as p from orders where o_orderdate < timestamp '1998-01-01' union all select o_orderkey, 'read', 1 from orders where o_orderstatus <> 'F' union all select o_orderkey, 'manual', 2 from orders where o_totalprice > 400000)
    select o_orderkey, arg_max(origin, p) as origin from u group by o_orderkey""")
def priority_union(spark, sf):
    o = table(spark, sf, "orders")
    parts = [o.where(w).select("o_orderkey", F.lit(n).alias("origin")) for n, w in (("old", "o_orderdate < timestamp'1998-01-01'"), ("read", "o_orderstatus <> 'F'"), ("manual", "o_totalprice > 400000"))]
    return E.priority_union(parts, "o_orderkey")


@query("""select user_id, strftime(ts, '%Y-%m-%d') as day, event_type, event_id from (select *, row_number() over (partition by user_id, cast(ts as date), event_type order by value desc, event_id) as r from events) where r = 1""")
def ordered_leaders(spark, sf):
    rows = table(spark, sf, "events").select("user_id", text_day("ts").alias("day"), "event_type", "event_id", "value")
    return E.leaders(rows, ["user_id", "day"], "event_type", "value", ["event_id"]).drop("value")


@query("""with d as (select o_orderpriority as p, strftime(o_orderdate, '%Y') as y, count(*) as n from orders group by all), b as (select p, sum(n) as n from d where y <= '1997' group by p), a as (select p, sum(n) as n from d where y >= '1999' group by p)
    select coalesce(a.p, b.p) as o_orderpriority, cast(coalesce(b.n, 0) as bigint) as before, cast(coalesce(a.n, 0) as bigint) as now, case when coalesce(a.n, 0) = 0 and coalesce(b.n, 0) >= 2 then 'error' when coalesce(b.n, 0) >= 5 and coalesce(a.n, 0) * 10 < b.n * 4 then 'error' when coalesce(b.n, 0) >= 3 and coalesce(a.n, 0) * 10 < b.n * 7 then 'warn' else 'ok' end as level from a full join b on a.p = b.p""")
def partition_drops(spark, sf):
    o = table(spark, sf, "orders")
    return A.drops(o.where("o_orderdate < timestamp'1998-01-01'"), o.where("o_orderdate >= timestamp'1999-01-01'"), "o_orderpriority")


@query("""select rule, level, count(*) as n from (select unnest([case when l_shipdate < timestamp '1996-01-01' then {'rule': 'early', 'level': 'warn'} end, case when l_discount > 0.09 then {'rule': 'discount', 'level': 'error'} end, case when l_quantity <= 0 or l_quantity is null then {'rule': 'quantity', 'level': 'error'} end], recursive := false) as b from lineitem) t, lateral (select b.rule, b.level) where b is not null group by rule, level""")
def quality_violations(spark, sf):
    rules = [("early", "warn", F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")), ("discount", "error", F.col("l_discount") > 0.09), ("quantity", "error", (F.col("l_quantity") <= 0) | F.col("l_quantity").isNull())]
    return A.violations(table(spark, sf, "lineitem"), rules)


@query("""select case when o_totalprice is null then 'dropped' when o_totalprice > 450000 then 'quarantined' when o_orderdate < timestamp '1996-01-01' then 'past' else 'published' end as disposition, count(*) as n from orders group by 1""")
def publish_gate(spark, sf):
    gates = [("dropped", F.col("o_totalprice").isNull()), ("quarantined", F.col("o_totalprice") > 450000), ("past", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))]
    return A.disposition(table(spark, sf, "orders"), gates).groupBy("disposition").agg(F.count("*").alias("n"))


@query("""select o_orderkey, substr('日月火水木金土', cast(dayofweek(o_orderdate) as int) + 1, 1) as weekday, (cast(substr(d, 1, 4) as int) - 1) || substr(d, 5) as year_before, strftime(case when dayofweek(o_orderdate) = 0 then cast(o_orderdate as date) - 1 else cast(o_orderdate as date) + 6 - cast(dayofweek(o_orderdate) as int) end, '%Y-%m-%d') as weekend, date '2001-08-01' - cast(o_orderdate as date) as days
    from (select *, strftime(o_orderdate, '%Y-%m-%d') as d from orders)""")
def order_dates(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", S.weekday(d).alias("weekday"), S.year_before(text_day("o_orderdate")).alias("year_before"), F.date_format(S.weekend_start(d), "yyyy-MM-dd").alias("weekend"), F.datediff(F.lit("2001-08-01").cast("date"), d).cast("long").alias("days"))


@query(r"""select page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', ''), '/+$', '') as base, case when regexp_matches(url, '(?i)^https?://') then lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)) else '' end as host, case when regexp_matches(url, '(?i)^https?://') then url else '' end as safe from pages""")
def page_urls(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.substring_index(S.normal_url(u), "?", 1).alias("base"), F.substring_index(S.compare_url(u), "/", 1).alias("host"), S.safe_url(u).alias("safe"))


@query(r"""select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>', '', 'gis'), '<!--.*?-->', '', 'gs'), '\s+', ' ', 'g'), ' ')) as digest from pages""")
def page_digests(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.html_digest(F.col("html")).alias("digest"))


@query("""select page_id, ('00000' || lower(to_base(list_reduce(list_transform(string_split(url, ''), lambda c: cast(ord(c) as bigint)), lambda a, x: xor((a * 33) % 4294967296, x), cast(5381 as bigint)), 36)))[-5:] as hash from pages""")
def short_hashes(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.short_hash(F.col("url")).alias("hash"))


@query("""select page_id, kind, count(*) as n from (select page_id, case when regexp_matches(h, '(?i)\\.(?:pdf|jpe?g|png|gif|webp)(?:[?#]|$)') then 'asset' when starts_with(h, '#') then 'anchor' when regexp_matches(h, '(?i)^(mailto|tel|javascript):') then 'other' else 'page' end as kind
    from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) as h from pages)) group by all""".replace("\\\\", "\\"))
def page_links(spark, sf):
    return P.links(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("""select event_type, sum(cast(props ->> '$.k' as bigint))::bigint as k, count(*) as n from events group by event_type""")
def loose_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("""select page_id, case when url like '%/en/%' then 'baseline' when contains(html, '<table') then 'changed' else 'unchanged' end as state from pages""")
def snapshot_states(spark, sf):
    now = table(spark, sf, "pages").select("page_id", "url", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    old = now.where("url not like '%/en/%'").withColumn("digest", F.when(F.col("html").contains("<table"), "other").otherwise(F.col("digest")))
    return J.classified(old, now, "page_id", "digest")


@query("""select c_custkey, case when substr(c, 1, 1) in ('=', '+', '-', '@') then chr(39) || c else c end || ',' || chr(34) || c_name || ', ' || repeat(chr(34), 2) || c_mktsegment || repeat(chr(34), 3) as line
    from (select *, cast(cast(floor(c_acctbal) as bigint) as varchar) as c from customer)""")
def csv_cells(spark, sf):
    rows = table(spark, sf, "customer").withColumn("c", F.floor("c_acctbal").cast("string")).withColumn("t", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')))
    key = F.col("c_custkey")
    return rows.select(key, *[F.col(c) for c in ("c", "t")]).select(key, K.csv_cell("c").alias("a"), K.csv_cell("t").alias("b")).select(key, F.concat_ws(",", "a", "b").alias("line"))


@query("""select o_orderkey, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || o_orderkey, 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(o_orderdate + interval 1 day, '%Y%m%d'), 'SUMMARY:' || o_orderpriority, 'LOCATION:' || o_orderstatus, 'END:VEVENT') as ics from orders""")
def calendar_entries(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", K.ics(F.col("o_orderkey").cast("string"), d, F.lit(None).cast("date"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("ics"))
