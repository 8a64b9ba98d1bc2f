"""What a task holds where the tables are too large to be broadcast."""

from riskloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_children_are_not_sorted(spark):
    """Replaced lines pass a hash table of their orders."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(tuple(r) for r in catalogue.queries()["replace_children"](spark, SF).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalogue.queries()["replace_children"](spark, SF)
        assert sorted(tuple(r) for r in df.collect()) == want and want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
