"""Joins whose results are many rows for each row that is read: what is exchanged stays in proportion to what is read."""

from pyspark.sql import functions as F

from riskloom.operators import findings, identify
from riskloom.plans import catalogue


def exchanged(df):
    """(rows of the result, rows that the executed plan exchanged)."""
    n, todo, rows = len(df.collect()), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            written = p.metrics().get("shuffleRecordsWritten")
            rows += written.get().value() if written.isDefined() else 0
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return n, rows


def parts(spark, folder, n=1500):
    """One brand and type: each part meets a share of all."""
    rows = spark.range(n).selectExpr("id as p_partkey", "'blue ring' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "cast(id % 50 as int) as p_size", "1.0D as p_retailprice")
    rows.write.parquet(f"{folder}/part.parquet")
    return str(folder)


def without_broadcasts(spark, run):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_aliases_are_looked_up_before_items_meet(spark, tmp_path):
    folder = parts(spark, tmp_path)
    n, rows = without_broadcasts(spark, lambda: exchanged(catalogue.queries()["three_way_inner"](spark, folder)))
    assert n > 200_000 and rows < 100_000


def test_later_stages_are_asked_for_the_rest_only(spark):
    items, asked = spark.range(6).withColumnRenamed("id", "item"), []

    def stage(least):
        def run(rest):
            asked.append(sorted(r["item"] for r in rest.collect()))
            return rest.where(F.col("item") >= least).select("item", F.lit(least).alias("id"))

        return run

    got = sorted(tuple(r) for r in identify.cascade(items, [stage(4), stage(2), stage(1)], ["item"]).select("item", "id", "stage").collect())
    assert asked == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3], [0, 1]]
    assert got == [(1, 1, 2), (2, 2, 1), (3, 2, 1), (4, 4, 0), (5, 4, 0)]


def test_records_meet_by_plausible_names(spark):
    v = "array<struct<version:string,status:string,lessThan:string,lessThanOrEqual:string>>"
    records = [
        ("a", 1, [("acme", "ring", None, [("1", "affected", "5", None)]), ("", "ring", None, [("1", "affected", None, "9")])]),
        ("b", 1, [("", "", None, [("0", "affected", "*", None)])]),  # no name: means nothing
        ("c", 1, [("other", "thing", None, [("0", "affected", "*", None)]), ("", "ring", None, [("2", "affected", "*", None)])]),
        ("d", 2, [("acme", "ring", None, [("1", "affected", "5", None)])]),
        ("e", 1, []), ("f", 1, None),
    ]
    items = [(1, 1, "ring", "acme", "3"), (2, 1, "ring", None, "7"), (3, 1, "bolt", None, "3"), (4, 1, "ring", None, None), (5, 3, "ring", None, "3")]
    df = spark.createDataFrame(records, f"record string, k int, affected array<struct<vendor:string,product:string,package_name:string,versions:{v}>>")
    got = findings.record_matches(spark.createDataFrame(items, "item int, k int, name string, vendor string, version string"), df, ["k"])
    # A version that is not known is equal to every bound, as in the comparison of versions.
    assert sorted(map(tuple, got.collect())) == [(1, "a", "5"), (1, "c", None), (2, "a", "9"), (2, "c", None), (4, "a", "9"), (4, "c", None)]
