"""All queries over the driver's tables, by name, each with its equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators import rank
from riskloom.plans import searches, versioning
from riskloom.plans.incremental import INCREMENTAL
from riskloom.plans.merges import MERGES
from riskloom.plans.relational import RELATIONAL
from riskloom.plans.reports import REPORTS
from riskloom.plans.scalars import SCALARS
from riskloom.session import table


def capped_ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as findings, ranked by score and capped at three: open ones are the customer's own, others belong to
    a component (their status), urgent ones are of an advisory and always stay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    severity = F.substr("o_orderpriority", F.lit(3))
    score = F.coalesce(F.when(F.col("o_totalprice") > 100000, F.lit(9.5)), rank.severity_score(severity, {"URGENT": 9.0, "HIGH": 7.5, "MEDIUM": 5.0, "NOT SPECIFIED": 2.0}))
    component = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumns({"component": component, "version": F.lit(None).cast("string"), "advisory": F.when(severity == "URGENT", "a")})
    return rank.capped_view(rows, "o_custkey", "component", "version", "advisory", score, "o_orderkey", 3).select("o_custkey", "c_name", "o_orderkey", "o_orderstatus", "score", "total_count", "rn", "component_rank")


CAPPED_SQL = """
with r as (
  select o_custkey, c_name, o_orderkey, o_orderstatus, case when o_orderstatus <> 'O' then o_orderstatus end as component, o_orderpriority = '1-URGENT' as advisory,
    coalesce(case when o_totalprice > 100000 then 9.5 end,
      case o_orderpriority when '1-URGENT' then 9.0 when '2-HIGH' then 7.5 when '3-MEDIUM' then 5.0
        when '4-NOT SPECIFIED' then 2.0 else 5.0 end)::double as score
  from orders join customer on o_custkey = c_custkey),
w as (
  select *, count(*) over (partition by o_custkey, component is null) as total_count,
    row_number() over (partition by o_custkey, component is null order by score desc, o_orderkey) as rn,
    dense_rank() over (partition by o_custkey order by component nulls last) as component_rank
  from r)
select o_custkey, c_name, o_orderkey, o_orderstatus, score, total_count, rn, component_rank from w
where (component is null and rn <= 3) or (component is not null and component_rank <= 3) or advisory
"""


def top_n_ranked_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best lines of each order by a severity score, ties by line number."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    score = F.coalesce(F.when(F.col("l_quantity") > 40, 9.5), F.when(F.col("l_returnflag") == "R", 9.0).when(F.col("l_returnflag") == "A", 7.5).otherwise(5.0))
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("score"), F.asc("l_linenumber")))
    return t.withColumn("score", score).withColumn("rn", rn).where("rn <= 3").select("l_orderkey", "l_linenumber", "score", "rn")


TOP_N_SQL = """
select l_orderkey, l_linenumber, score, rn from (
  select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber) as rn from (
    select l_orderkey, l_linenumber, coalesce(case when l_quantity > 40 then 9.5 end,
      case l_returnflag when 'R' then 9.0 when 'A' then 7.5 else 5.0 end)::double as score from lineitem))
where rn <= 3
"""


def distinct_on_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest part of each brand and type; the smaller key of equal ones."""
    t = table(spark, sf_dir, "part")
    best = F.max_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", -F.col("p_partkey"))).alias("b")
    return t.groupBy("p_brand", "p_type").agg(best).select("p_brand", "p_type", "b.p_partkey", "b.p_retailprice")


DISTINCT_ON_SQL = "select distinct on (p_brand, p_type) p_brand, p_type, p_partkey, p_retailprice from part order by p_brand, p_type, p_retailprice desc, p_partkey"


OUTLIER_SQL = """
with t as (select p_brand, case when p_partkey % 50 != 0 then p_size else p_size * 100 end as major from part),
g as (select p_brand, count(*) as cataloged, count(major) as r, count(distinct major) as d, max(major) as m, quantile_disc(major, 0.99) as p,
  count(*) filter (where major >= 1000) as w, count(*) filter (where major < 1000) as nr, count(distinct major) filter (where major < 1000) as nd,
  max(major) filter (where major < 1000) as nm, quantile_disc(major, 0.99) filter (where major < 1000) as np from t group by p_brand),
c as (select p_brand, cataloged, w > 0 and w * 10 < r and nr > 0 as n, * exclude (p_brand, cataloged) from g),
u as (select p_brand, cataloged, case when n then nr else r end as r, case when n then nd else d end as d, case when n then nm else m end as m, case when n then np else p end as p from c)
select p_brand, cataloged, (case when r >= 20 and d >= 3 and p >= 4 and m > 4 * p then p else m end)::bigint as max_major from u
"""


def coalesce_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge that never replaces a value by null: new values win where there are any."""
    t = table(spark, sf_dir, "supplier")
    old = t.where("s_suppkey % 3 != 0").select("s_suppkey", F.col("s_name").alias("old_name"), F.col("s_acctbal").alias("old_bal"))
    new = t.where("s_suppkey % 2 = 0").select("s_suppkey", F.upper("s_name").alias("new_name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 2).alias("new_bal"))
    return old.join(new, "s_suppkey", "full").select("s_suppkey", F.coalesce("new_name", "old_name").alias("s_name"), F.coalesce("new_bal", "old_bal").alias("s_acctbal"))


COALESCE_SQL = """
with o as (select * from supplier where s_suppkey % 3 != 0),
n as (select s_suppkey, upper(s_name) as s_name, case when s_acctbal > 0 then s_acctbal * 2 end as s_acctbal from supplier where s_suppkey % 2 = 0)
select s_suppkey, coalesce(n.s_name, o.s_name) as s_name, coalesce(n.s_acctbal, o.s_acctbal) as s_acctbal from o full join n using (s_suppkey)
"""


def changed_only_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge that rewrites only rows that differ, null-safely."""
    t = table(spark, sf_dir, "part")
    old = t.where("p_partkey % 5 != 0").select("p_partkey", F.col("p_brand").alias("old"))
    new = t.where("p_partkey % 4 = 0").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("new"), F.lit(True).alias("has_new"))
    both = old.withColumn("has_old", F.lit(True)).join(new, "p_partkey", "full")
    changed = F.col("has_new").isNotNull() & (F.col("has_old").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select("p_partkey", F.when(F.col("has_new").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("p_brand"), changed.alias("changed"))


CHANGED_SQL = """
with o as (select p_partkey, p_brand as old, true as has_old from part where p_partkey % 5 != 0),
n as (select p_partkey, case when p_size > 20 then p_brand end as new, true as has_new from part where p_partkey % 4 = 0)
select p_partkey, case when has_new then new else old end as p_brand,
  coalesce(has_new, false) and (has_old is null or old is distinct from new) as changed from o full join n using (p_partkey)
"""


def dedup_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each user and type: the best-placed source wins, then the smaller id."""
    t = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 5).alias("source_rank"))
    return t.groupBy("user_id", "event_type").agg(F.min(F.struct("source_rank", "event_id")).alias("m")).select("user_id", "event_type", "m.source_rank", "m.event_id")


DEDUP_SQL = """
select user_id, event_type, source_rank, event_id from (select user_id, event_type, event_id, event_id % 5 as source_rank,
  row_number() over (partition by user_id, event_type order by event_id % 5, event_id) as rn from events) where rn = 1
"""


TRIGRAM_SQL = r"""
with n as (select p_partkey as id, p_name as name from part where p_partkey % 100 = 0),
c as (select name, min(id) as id from (select p_type as name, p_partkey as id from part union all select p_name, p_partkey from part) group by name),
ln as (select distinct n.id, substr('  ' || w || ' ', k::int, 3) as g from n, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as x(w), unnest(range(1, length(w) + 2)) as y(k)),
rn as (select distinct name, id, substr('  ' || w || ' ', k::int, 3) as g from c, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as x(w), unnest(range(1, length(w) + 2)) as y(k)),
lc as (select id, count(*) as n from ln group by id), rc as (select name, id, count(*) as n from rn group by name, id),
s as (select ln.id as left_id, rn.id as right_id, rn.name, count(*) as shared from ln join rn using (g) group by ln.id, rn.id, rn.name)
select left_id, right_id, shared, lc.n + rc.n - shared as total from s join lc on lc.id = left_id join rc on rc.id = right_id and rc.name = s.name
where (shared::double / (lc.n + rc.n - shared))::float >= 0.3::float
"""


def json_property_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts of events by their JSON property, missing and malformed ones as null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint").alias("k")
    return table(spark, sf_dir, "events").select(k, "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


JSON_SQL = "select try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n, round(sum(value), 2) as total from events group by 1"


def prefix_ok_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's cursor moves: to the last time before which no event failed."""
    t = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 11 != 0).alias("ok"))
    ok = F.min("ok").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("ok", ok).groupBy("user_id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("cursor"), F.count_if("ok").alias("passed"))


CURSOR_SQL = """
select user_id, max(case when good then ts end) as cursor, count(*) filter (where good) as passed from (select user_id, ts,
  min((event_id % 11 != 0)::int) over (partition by user_id order by ts, event_id rows unbounded preceding) = 1 as good from events) group by user_id
"""


def string_agg_cap_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three order keys of each customer in one cell, with a notice of how many are hidden."""
    t = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    keys = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", F.col("o_orderkey").cast("string").alias("k")))))
    hidden = F.count("*") - 3
    cell = F.concat(F.array_join(F.transform(keys, lambda x: x.k), "; "), F.when(hidden > 0, F.concat(F.lit(" and "), hidden.cast("string"), F.lit(" more"))).otherwise(""))
    return t.groupBy("o_custkey").agg(cell.alias("cell"))


CAP_NOTICE_SQL = """
select o_custkey, string_agg(o_orderkey::varchar, '; ' order by rn) filter (where rn <= 3) || case when count(*) > 3 then ' and ' || (count(*) - 3) || ' more' else '' end as cell
from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) group by o_custkey
"""


def confirmed_rate_warning(spark: SparkSession, sf_dir: str, least: int = 30, share: float = 0.5) -> DataFrame:
    """Nations with at least ``least`` resolved orders of which less than a ``share`` is confirmed; an unknown one is not confirmed."""
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    t = table(spark, sf_dir, "orders").join(n, "o_custkey").select("c_nationkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("confirmed"))
    g = t.groupBy("c_nationkey").agg(F.count("*").alias("resolved"), F.count_if(F.col("confirmed")).alias("confirmed"))
    return g.withColumn("warning", (F.col("resolved") >= least) & (F.col("confirmed") < F.col("resolved") * share))


CONFIRMED_SQL = "select c_nationkey, count(*) as resolved, count(*) filter (where o_orderstatus = 'F') as confirmed, count(*) >= 30 and count(*) filter (where o_orderstatus = 'F') * 2 < count(*) as warning from orders join customer on o_custkey = c_custkey group by 1"


def fresh_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that no returned line of great quantity names."""
    t = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(t, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


ANTI_SQL = "select s_suppkey, s_name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)"

#: name -> (query, DuckDB SQL)
CATALOGUE = {
    "capped_ranked_findings": (capped_ranked_findings, CAPPED_SQL),
    "top_n_ranked_cap": (top_n_ranked_cap, TOP_N_SQL),
    "distinct_on_best": (distinct_on_best, DISTINCT_ON_SQL),
    "outlier_guarded_max": (versioning.outlier_guarded_max, OUTLIER_SQL),
    "coalesce_upsert": (coalesce_upsert, COALESCE_SQL),
    "changed_only_upsert": (changed_only_upsert, CHANGED_SQL),
    "dedup_first_source": (dedup_first_source, DEDUP_SQL),
    "trigram_similarity": (searches.trigram_similarity, TRIGRAM_SQL),
    "json_property_totals": (json_property_totals, JSON_SQL),
    "prefix_ok_cursor": (prefix_ok_cursor, CURSOR_SQL),
    "string_agg_cap_notice": (string_agg_cap_notice, CAP_NOTICE_SQL),
    "confirmed_rate_warning": (confirmed_rate_warning, CONFIRMED_SQL),
    "fresh_anti_join": (fresh_anti_join, ANTI_SQL),
    **MERGES,
    **SCALARS,
    **versioning.VERSIONING,
    **RELATIONAL,
    **searches.SEARCHES,
    **INCREMENTAL,
    **REPORTS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOGUE.items() if sql}
