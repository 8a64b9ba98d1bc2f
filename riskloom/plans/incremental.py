"""Cursors, dead letters, windows of time, freshness and budgets over the driver's events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.lists import columns
from riskloom.session import table
from riskloom.streaming import budget, cursors


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("feed"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))


def cursor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each feed gets that works off groups of equal time, stops at the first with a failure and begins none after
    thirty rows."""
    out = cursors.group_cursor(_events(spark, sf_dir), "feed", "ts", F.col("event_id") % 61 != 0, cap=30)
    return out.withColumn("cursor", F.col("cursor").cast("timestamp_ntz"))


GROUPS_SQL = """
with e as (select user_id as feed, date_trunc('hour', ts) as ts, event_id % 61 <> 0 as ok from events), g as (select feed, ts, bool_and(ok) as good, count(*) as n from e group by 1, 2),
w as (select *, bool_and(good) over (partition by feed order by ts) and coalesce(sum(n) over (partition by feed order by ts rows between unbounded preceding and 1 preceding), 0) < 30 as passed from g)
select feed, max(case when passed then ts end)::timestamp as cursor, count(*) filter (where passed) as n_groups, coalesce(sum(n) filter (where passed), 0)::bigint as n_rows from w group by 1
"""


def frozen_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is tried, but a feed's cursor stays before its first failure that is no dead letter."""
    out = cursors.frozen_cursor(_events(spark, sf_dir), "feed", "ts", F.col("event_id") % 37 != 0, F.col("event_id") % 2 == 0)
    return out.withColumn("cursor", F.col("cursor").cast("timestamp_ntz"))


FROZEN_SQL = """
with e as (select user_id as feed, date_trunc('hour', ts) as ts, event_id % 37 <> 0 as ok, event_id % 37 <> 0 or event_id % 2 = 0 as passes from events), s as (select feed, min(case when not passes then ts end) as stop from e group by 1)
select feed, max(case when stop is null or ts < stop then ts end)::timestamp as cursor, count(*) filter (where ok) as n_ok, count(*) filter (where not ok) as n_failed from e join s using (feed) group by 1
"""


def due_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events later than their feed's cursor less two hours; all of those of feeds without one."""
    e = _events(spark, sf_dir)
    state = e.where("feed % 3 > 0").groupBy("feed").agg((F.min("ts") + F.expr("INTERVAL 9 HOURS")).alias("cursor"))
    return cursors.due(e, state, "feed", "ts", "INTERVAL 2 HOURS").groupBy("feed").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first"))


DUE_SQL = """
with e as (select user_id as feed, date_trunc('hour', ts) as ts from events), c as (select feed, min(ts) + interval 9 hours as cursor from e where feed % 3 > 0 group by 1)
select feed, count(*) as n, min(ts)::timestamp as first from e left join c using (feed) where cursor is null or ts > cursor - interval 2 hours group by 1
"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row of each document after three runs; success forgets them."""
    t = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    state = t.where("p_size < 0").selectExpr("p_partkey", "cast(0 as int) as failures", "false as dead")
    for run in (2, 3, 5):
        state = cursors.dead_letters(state, t.where(f"p_partkey % 7 <> {run}"), "p_partkey", F.col("p_size") % run != 0)
    return state


DEAD_SQL = """
with f as (select p_partkey, case when p_partkey % 7 = 2 then 0 when p_size % 2 = 0 then 1 else 0 end as a, p_size from part), g as (select p_partkey, p_size, case when p_partkey % 7 = 3 then a when p_size % 3 = 0 then a + 1 else 0 end as b from f),
h as (select p_partkey, case when p_partkey % 7 = 5 then b when p_size % 5 = 0 then b + 1 else 0 end as failures from g) select p_partkey, failures::int as failures, failures >= 3 as dead from h where failures > 0
"""


_BOUNDS = "min(ts) - interval '40' day as start, max(ts) + interval '30' day as end"


def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 days around the events, those with many events cut in half once."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    w = cursors.windows(e.selectExpr(*columns(_BOUNDS)), 20)
    moments = e.groupBy("ts").agg(F.count("*").alias("m")).withColumn("day", F.to_date("ts"))
    held = w.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("end")))).join(moments, "day").where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    counted = w.join(held.groupBy("start", "end").agg(F.sum("m").alias("n")), ["start", "end"], "left").select("start", "end", F.coalesce("n", F.lit(0)).alias("n"))
    at = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    return cursors.split(counted, 200).select(at("start", "begins"), at("end", "ends"), "settled")


_WINDOWS = "b as (select min(ts) - interval 40 days as s, max(ts) + interval 30 days as e from events), w as (select s + to_days({days} * i::int) as s, least(s + to_days({days} * (i::int + 1)), e) as e from b, range(0, 400) t(i) where s + to_days({days} * i::int) < e)"
WINDOWS_SQL = f"""
with {_WINDOWS.format(days=20)}, l as (select w.s, w.e, count(ts) > 200 and w.e > w.s + interval 1 day as large from w left join events on ts >= w.s and ts < w.e group by 1, 2)
select s as begins, e as ends, true as settled from l where not large union all select s, s + (e - s) / 2, false from l where large union all select s + (e - s) / 2, e, false from l where large
"""


def settled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten days around the events, halved until none holds more than forty of them or is no longer than a day: each
    window's number of events."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    w = cursors.settled_windows(e.selectExpr(*columns(_BOUNDS)), e, "ts", 40, 10)
    return w.select(F.col("start").cast("timestamp_ntz").alias("begins"), F.col("end").cast("timestamp_ntz").alias("ends"), "n")


# Times as microseconds, so that halves are exact; each round halves what holds too many.
SETTLED_SQL = f"""
with recursive {_WINDOWS.format(days=10)}, ev as (select epoch_us(ts) as t from events),
tree as (select epoch_us(s) as s, epoch_us(e) as e, (select count(*) from ev where t >= epoch_us(s) and t < epoch_us(e)) as n from w
  union all select h.s, h.e, (select count(*) from ev where t >= h.s and t < h.e) from (select unnest([{{'s': s, 'e': (s + e) // 2}}, {{'s': (s + e) // 2, 'e': e}}]) as h from tree where n > 40 and e > s + 86400000000))
select make_timestamp(s) as begins, make_timestamp(e) as ends, n from tree where n <= 40 or e <= s + 86400000000
"""


def freshness_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of mirrors that cannot be relied on."""
    t = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as mirror", "s_suppkey % 7 > 0 as baseline_loaded", "case when s_suppkey % 5 = 0 then 'x' end as last_error", "case when s_suppkey % 11 > 0 then make_timestamp(2024, 1, 1 + cast(s_suppkey % 20 as int), 0, 0, 0) end as last_synced_at", "case when s_suppkey % 2 = 0 then 2 else 9 end as stale_after_days")
    return cursors.freshness(t, F.expr("timestamp'2024-01-15 12:00:00'"))


FRESHNESS_SQL = """
select mirror, warning from (select s_suppkey as mirror, case when s_suppkey % 7 = 0 then 'baseline_missing' when s_suppkey % 5 = 0 then 'last_run_failed' when s_suppkey % 11 = 0 then 'never_synced'
  when timestamp '2024-01-15 12:00:00' - (timestamp '2024-01-01' + to_days((s_suppkey % 20)::int)) > to_days(case when s_suppkey % 2 = 0 then 2 else 9 end) then 'stale' end as warning from supplier) where warning is not null
"""


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's requests cost, nothing where there are none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), budget.cost(F.col("o_orderkey") % 5000, F.floor(F.col("o_totalprice")).cast("long") % 700, F.col("o_orderkey") % 3).alias("cost"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o.groupBy("c_custkey").agg(F.sum("cost").alias("cost"), F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce(F.col("cost"), F.lit(0)).cast("double").alias("cost"), F.coalesce("n", F.lit(0)).alias("n"))


COST_SQL = """
select c_custkey, coalesce(sum((o_orderkey % 5000) * 0.000001 + (floor(o_totalprice)::bigint % 700) * 0.000005 + (o_orderkey % 3) * 0.01), 0)::double as cost, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1
"""


def budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of each customer's requests its budget admits, in order; a part is kept for tier 2."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as job", "o_orderkey as seq", "o_orderkey % 3 = 0 as tier2", "0.001 * (1 + o_orderkey % 5) as estimate", "0.001 * (o_orderkey % 7) as actual")
    jobs = o.groupBy("job").agg(F.count("*").alias("n_items"))
    return budget.admitted(o, jobs, "0.002", "0.0005").withColumn("spent", F.col("spent").cast("double"))


# One step of the fold for each request; decimals as in the fold.
BUDGET_SQL = """
with recursive r as (select o_custkey as job, o_orderkey as seq, o_orderkey % 3 = 0 as tier2, (0.001 * (1 + o_orderkey % 5))::decimal(18,6) as est, (0.001 * (o_orderkey % 7))::decimal(18,6) as act, row_number() over (partition by o_custkey order by o_orderkey) as i,
  least((count(*) over (partition by o_custkey) * 0.0005)::decimal(18,6), (count(*) over (partition by o_custkey) * 0.002)::decimal(18,6)) as fl, (count(*) over (partition by o_custkey) * 0.002)::decimal(18,6) as total from orders),
f as (select job, 0::bigint as i, 0::decimal(18,6) as s, 0::decimal(18,6) as fs, null::bigint as seq, false as admitted, null::varchar as pool from r where i = 1
  union all select job, i, case when pool = 'general' then greatest(s + act, 0)::decimal(18,6) else s end, case when pool = 'floor' then greatest(fs + act, 0)::decimal(18,6) else fs end, seq, pool is not null, pool
  from (select f.job, r.i, f.s, f.fs, r.seq, r.act, case when r.tier2 and f.fs + r.est <= r.fl then 'floor' when f.s + r.est <= r.total - r.fl then 'general' end as pool from f join r on r.job = f.job and r.i = f.i + 1))
select job, seq, admitted, pool, (s + fs)::double as spent from f where i > 0
"""

#: name -> (query, DuckDB SQL)
INCREMENTAL = {
    "cursor_groups": (cursor_groups, GROUPS_SQL), "frozen_cursor": (frozen_cursor, FROZEN_SQL), "due_changes": (due_changes, DUE_SQL), "dead_letters": (dead_letters, DEAD_SQL), "time_windows": (time_windows, WINDOWS_SQL), "settled_windows": (settled_windows, SETTLED_SQL),
    "freshness_age": (freshness_age, FRESHNESS_SQL), "cost_rollup": (cost_rollup, COST_SQL), "budget_fold": (budget_fold, BUDGET_SQL),
}
