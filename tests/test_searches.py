"""Searches over many copies of few names: the work is that of the names, the lists are those of the rows."""

from pyspark.sql import functions as F

from riskloom.functions import trigrams
from riskloom.operators import cascade, fuzzy


def most_rows(df):
    """The greatest number of rows that a step of the executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            rows = p.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def items(spark, n=300, name="blue ring"):
    return spark.range(n).selectExpr("id as item", f"'{name}' as name")


def test_similar_names_meet_once(spark):
    left, right = items(spark), spark.range(900).selectExpr("case when id % 3 = 0 then 'blue rings' else 'blue ring' end as name")
    met = trigrams.similar_names(left, right, 0.3)
    assert sorted((r["left_name"], r["right_name"]) for r in met.collect()) == [("blue ring", "blue ring"), ("blue ring", "blue rings")]


def test_records_of_copies(spark):
    products = spark.range(900).selectExpr("1000 - id as id", "case when id < 10 then 'blue ring' else 'blue rings' end as product", "cast(null as string) as package_name", "cast(id % 50 as string) as record")
    found = fuzzy.record_search(items(spark), products)
    assert most_rows(found) < 20_000  # 300 items and 900 rows, not their product
    best = {r["record"]: round(r["score"], 3) for r in found.where("item = 7").collect()}
    # Ten rows of the very name, then the ten least ids (101 to 110) of the other.
    assert best == {str(k): 1.0 for k in range(10)} | {str(k): round(best["45"], 3) for k in range(40, 50)}


def test_advisories_of_copies(spark):
    rows = spark.range(900).selectExpr("id", "case when id % 2 = 0 then 'blue-ring' else 'blue rings' end as component", "id % 7 as updated")
    both = items(spark).unionByName(spark.range(300, 600).selectExpr("id as item", "'the blue rings' as name"))
    found = fuzzy.advisory_search(both, rows)
    assert most_rows(found) < 40_000
    exact = [r["id"] for r in found.where("item = 7").orderBy("rn").collect()]
    assert exact == sorted(range(0, 900, 2), key=lambda i: (-(i % 7), i))[:30]
    near = found.where("item = 500").orderBy("rn").collect()
    assert [r["id"] for r in near] == sorted(range(1, 900, 2), key=lambda i: (-(i % 7), i))[:30] and {r["path"] for r in near} == {"similar"}


def test_two_columns_of_copies(spark):
    rows = spark.range(900).selectExpr("1000 - id as id", "cast(id % 2 as string) as vendor", "'blue ring' as product", "'x' as title", "'cpe:2.3:a:v:p:' || (id % 5) || ':*:*:*:*:' || case when id % 4 = 0 then 'node.js' else '*' end || ':*:*' as cpe")
    got = sorted(tuple(r) for r in fuzzy.two_column_search(items(spark, 3), rows).select("item", "id", "rn", "targets", "cataloged_row_count", "max_major").collect())
    assert got == [(i, *x) for i in range(3) for x in ((101, 1, ["*"], 450, 4), (102, 2, ["*", "node.js"], 450, 4))]


def test_initialisms_and_keywords_of_copies(spark):
    rows = spark.range(900).selectExpr("id + 5 as id", "'v' as vendor", "'blue_ring_small_unit' as product", "'Small Unit' as title")
    found = fuzzy.initialism_search(items(spark, name="BR small unit"), rows)
    assert most_rows(found) < 5_000 and {tuple(r) for r in found.select("id", "rn").collect()} == {(5, 1)}
    asked = spark.range(300).selectExpr("id as item", "0 as attempt", "'small unit' as query")
    met = cascade.keyword_rows(asked, rows)
    assert most_rows(met) < 20_000 and {r["id"] for r in met.where("item = 3").collect()} == set(range(5, 25))


def test_two_columns_read_titles_once(spark):
    """Their rows are told apart once, whatever the search does with them; names are not cut into trigrams for every row."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(900).selectExpr("id", "cast(id % 2 as string) as vendor", "'blue ring' as product", "'blue rings' as title", "'cpe:2.3:a:v:p:1:*:*:*:*:*:*:*' as cpe")
    rows = rows.withColumn("title", F.udf(counted, "string")("title"))
    assert fuzzy.two_column_search(items(spark, 3), rows).count() == 6 and seen.value == 900
