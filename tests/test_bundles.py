"""Joins by way of bundles against plain joins, and queries of which every row is asked for."""

from test_expansion import exchanged, parts, without_broadcasts

from riskloom.operators import bundles, findings
from riskloom.plans import catalogue


def test_bundles_join_like_rows(spark):
    left = spark.range(900).selectExpr("case when id % 50 > 0 then if(id < 600, 'hot', string(id % 9)) end as k", "id % 2 as l", "if(id % 3 > 0, id, null) as item", "string(id) as word")
    right = spark.range(200).selectExpr("case when id % 40 > 0 then if(id < 150, 'hot', string(id % 9)) end as k", "id % 2 as l", "if(id % 7 > 0, id, null) as other")
    for keys in (["k"], ["k", "l"]):
        rows = lambda df: sorted(map(repr, df.select("k", "item", "word", "other").collect()))  # noqa: E731, B023
        a, b = (left, right) if "l" in keys else (left.drop("l"), right.drop("l"))
        want = rows(a.join(b, keys))
        assert rows(bundles.join(a, b, keys)) == want and len(want) > 40_000
    assert bundles.join(left.where("false"), right, ["k", "l"]).count() == 0
    assert bundles.bundled(left, ["k"], "_").selectExpr("max(size(_item)) as n").first()["n"] == bundles.MOST


def test_first_stage_asks_for_every_part(spark, tmp_path):
    parts = [(i, "blue ring", f"Brand#{b}", t, s, 1.0) for i, (b, t, s) in enumerate([(1, "SMALL", 1), (1, "SMALL", 1), (1, "LARGE", 2), (1, "LARGE", 3), (2, "LARGE", 2), (3, "ECONOMY", 9), (4, "SMALL", 7), (5, "SMALL", 7)])]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r["item"], r["id"], r["stage"]) for r in catalogue.queries()["first_stage"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 0), (1, 0, 0), (2, 3, 1), (3, 2, 1), (4, 2, 2), (6, 7, 2), (7, 6, 2)]


def test_ranges_meet_as_bundles(spark, tmp_path):
    folder = parts(spark, tmp_path, 6000)
    n, rows = without_broadcasts(spark, lambda: exchanged(catalogue.queries()["version_range_join"](spark, folder)))
    assert n > 5_000_000 // 4 and rows < 30_000


def test_catalogue_entries_meet_as_bundles(spark, tmp_path):
    folder = parts(spark, tmp_path, 3000)
    n, rows = without_broadcasts(spark, lambda: exchanged(catalogue.queries()["cpe_range_match"](spark, folder)))
    assert n > 300_000 and rows < 40_000


def test_advisories_meet_as_bundles(spark, tmp_path):
    folder = parts(spark, tmp_path)
    n, rows = without_broadcasts(spark, lambda: exchanged(catalogue.queries()["three_way_inner"](spark, folder)))
    assert n == 230_555 and rows < 25_000


def test_records_of_many_entries_and_alike_rows(spark):
    v = "array<struct<version:string,status:string,lessThan:string,lessThanOrEqual:string>>"
    entry = lambda i, product: ("", product, None, [("1", "affected", str(i), None)])
    long = [entry(i, "thing" if i < 70 else "ring") for i in range(1, 73)]  # the first plausible entry is the 70th
    records = [("a", 1, long)] + [(f"b{i}", 1, [entry(9, "ring")]) for i in range(700)]
    items = [(i, 1, "ring", None, "3") for i in range(3)] + [(3, 1, "ring", None, "71"), (4, 2, "ring", None, "3")]
    df = spark.createDataFrame(records, f"record string, k int, affected array<struct<vendor:string,product:string,package_name:string,versions:{v}>>")
    got = findings.record_matches(spark.createDataFrame(items, "item int, k int, name string, vendor string, version string"), df, ["k"])
    want = [(i, r, b) for i in range(3) for r, b in [("a", "70"), *((f"b{j}", "9") for j in range(700))]] + [(3, "a", "72")]
    n, rows = without_broadcasts(spark, lambda: exchanged(got))
    assert sorted(map(tuple, got.collect())) == sorted(want) and n == len(want) and rows < 100
