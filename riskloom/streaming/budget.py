"""Cost budgets of jobs: what requests cost, and which a job's budget admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices in dollars.
PER_INPUT_TOKEN, PER_OUTPUT_TOKEN, PER_SEARCH = "0.000001", "0.000005", "0.01"
MONEY = "decimal(18,6)"


def cost(input_tokens: Column, output_tokens: Column, searches: Column) -> Column:
    return (input_tokens * F.lit(PER_INPUT_TOKEN).cast(MONEY) + output_tokens * F.lit(PER_OUTPUT_TOKEN).cast(MONEY) + searches * F.lit(PER_SEARCH).cast(MONEY)).cast(MONEY)


def admitted(requests: DataFrame, jobs: DataFrame, per_item: str, floor_per_item: str) -> DataFrame:
    """(job, seq, admitted, pool, spent): the requests (job, seq, tier2, estimate, actual) that each job's budget admits, in
    order.

    A request is admitted if its estimate still fits; then its actual cost counts, and never less than nothing is spent. A
    part of the budget is kept for tier 2, whose requests take it first. A rejected request consumes nothing, so no
    running sum can stand for this: the requests of a job are folded in order within the JVM. A job has as many requests as
    items at most times the calls of an item; jobs (job, n_items) are independent.
    """
    money = lambda x: x.cast(MONEY)
    total = money(F.col("n_items") * F.lit(per_item).cast(MONEY))
    floor = money(F.least(F.col("n_items") * F.lit(floor_per_item).cast(MONEY), total))
    entry = F.struct("seq", "tier2", money(F.col("estimate")).alias("estimate"), money(F.col("actual")).alias("actual"))
    rows = requests.groupBy("job").agg(F.array_sort(F.collect_list(entry)).alias("requests")).join(jobs.select("job", total.alias("total"), floor.alias("floor")), "job")
    cap = money(F.col("total") - F.col("floor"))
    zero = F.lit(0).cast(MONEY)
    row = "struct<seq:bigint,admitted:boolean,pool:string,spent:decimal(18,6)>"
    start = F.struct(zero.alias("spent"), zero.alias("floor_spent"), F.array().cast(f"array<{row}>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        from_floor = r["tier2"] & (s["floor_spent"] + r["estimate"] <= F.col("floor"))
        from_cap = ~from_floor & (s["spent"] + r["estimate"] <= cap)
        spent = F.when(from_cap, money(F.greatest(s["spent"] + r["actual"], zero))).otherwise(s["spent"])
        floor_spent = F.when(from_floor, money(F.greatest(s["floor_spent"] + r["actual"], zero))).otherwise(s["floor_spent"])
        told = F.struct(r["seq"].cast("bigint").alias("seq"), (from_floor | from_cap).alias("admitted"), F.when(from_floor, "floor").when(from_cap, "general").alias("pool"), money(spent + floor_spent).alias("spent"))
        return F.struct(spent.alias("spent"), floor_spent.alias("floor_spent"), F.concat(s["out"], F.array(told)).alias("out"))

    folded = rows.select("job", F.explode(F.aggregate("requests", start, step, lambda s: s["out"])).alias("r"))
    return folded.select("job", "r.seq", "r.admitted", "r.pool", "r.spent")
