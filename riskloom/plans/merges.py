"""Merges, cascades, semi joins and roll-ups over the driver's tables, each with its DuckDB SQL.

Every query is one declarative plan: filters and columns reach the scans, aggregates are summed before they are joined,
and no side is broadcast by hand (adaptive execution decides by measured size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import table


def money(column: str):
    return F.sum(F.col(column).cast("decimal(15,2)")).cast("double")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored parts (even keys) and those incoming ones (sizes to 25) whose key is not stored."""
    t = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    stored, incoming = t.where("p_partkey % 2 = 0").withColumn("origin", F.lit("stored")), t.where("p_size <= 25").withColumn("origin", F.lit("incoming"))
    return stored.unionByName(incoming.join(stored, "p_partkey", "left_anti"))


INSERT_SQL = """
select p_partkey, p_size, 'stored' as origin from part where p_partkey % 2 = 0 union all
select p_partkey, p_size, 'incoming' from part where p_size <= 25 and p_partkey not in (select p_partkey from part where p_partkey % 2 = 0)
"""


def overwrite_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming values replace the stored ones of their key, nulls too."""
    t = table(spark, sf_dir, "part")
    old = t.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_size").alias("old"))
    new = t.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size") + 100).alias("new"), F.lit(True).alias("came"))
    both = old.join(new, "p_partkey", "full")
    return both.select("p_partkey", F.when(F.col("came"), F.col("new")).otherwise(F.col("old")).cast("long").alias("size"))


OVERWRITE_SQL = """
select coalesce(o.p_partkey, n.p_partkey) as p_partkey, (case when n.came then n.new else o.old end)::bigint as size
from (select p_partkey, p_size as old from part where p_partkey % 3 <> 0) o
full join (select p_partkey, case when p_size > 10 then p_size + 100 end as new, true as came from part where p_partkey % 2 = 0) n on o.p_partkey = n.p_partkey
"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are left, counted by order, once the pending orders and with them their lines are deleted."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


CASCADE_SQL = "select l_orderkey, count(*) as n_lines from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P') group by 1"


def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the sum of its lines where it has lines, else with its own total."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(money("l_extendedprice").alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.join(sums, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.col("o_totalprice").cast("double")).alias("total"))


UPDATE_SQL = """
select o_orderkey, coalesce(s.lines, o_totalprice::double) as total from orders
left join (select l_orderkey, sum(l_extendedprice::decimal(15,2))::double as lines from lineitem group by 1) s on l_orderkey = o_orderkey
"""


def tuple_in_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part and supplier together occur in a returned line of great quantity."""
    t = table(spark, sf_dir, "lineitem")
    named = t.where("l_returnflag = 'R' and l_quantity > 45").select("l_partkey", "l_suppkey")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(named, ["l_partkey", "l_suppkey"], "left_semi")


TUPLE_SQL = "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where (l_partkey, l_suppkey) in (select (l_partkey, l_suppkey) from lineitem where l_returnflag = 'R' and l_quantity > 45)"


def left_enrich_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the name of their nation and region; nations of odd key count as unknown."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    both = s.join(n, "s_nationkey", "left").join(r, "r_regionkey", "left")
    return both.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


ENRICH_SQL = """
select s_suppkey, coalesce(n_name, 'unknown') as nation, coalesce(r_name, 'unknown') as region from supplier
left join (select * from nation where n_nationkey % 2 = 0) n on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
"""


def avg_without_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the orders, their lines, the sum of the orders' totals and what a line costs on average: lines are
    counted before the join, so that no order counts as often as it has lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(lines, "o_orderkey", "left")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), money("o_totalprice").alias("total")).withColumn("average", F.try_divide("total", "n_lines"))


FANOUT_SQL = """
select o_custkey, count(*) as n_orders, coalesce(sum(n), 0)::bigint as n_lines, sum(o_totalprice::decimal(15,2))::double as total, sum(o_totalprice::decimal(15,2))::double / nullif(sum(n), 0) as average from orders
left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey group by 1
"""


def having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part and supplier that occur on more than one line."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


DUPLICATES_SQL = "select l_partkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1"

#: name -> (query, DuckDB SQL)
MERGES = {
    "insert_if_absent": (insert_if_absent, INSERT_SQL),
    "overwrite_upsert": (overwrite_upsert, OVERWRITE_SQL),
    "cascade_delete": (cascade_delete, CASCADE_SQL),
    "update_from_join": (update_from_join, UPDATE_SQL),
    "tuple_in_semi": (tuple_in_semi, TUPLE_SQL),
    "left_enrich_coalesce": (left_enrich_coalesce, ENRICH_SQL),
    "avg_without_fanout": (avg_without_fanout, FANOUT_SQL),
    "having_duplicates": (having_duplicates, DUPLICATES_SQL),
}
