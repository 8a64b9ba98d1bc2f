"""Rules on versions and names by hand-made cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import cpe, text, versions
from riskloom.operators import identify


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lit(x):
    return F.lit(x).cast("string")


def test_general_comparison(spark):
    cases = [("1.0", "1", 0), ("1.2", "1.10", -1), ("1.0.0-rc1", "1.0.0", 1), ("9", "10", -1), ("10", "1a", -1), ("1a", "9", -1), (None, "1", 0), ("1.0_b", "1.0", 1), ("", "0", -1), ("...", "0", 0), ("123456789012345678", "5", -1)]
    assert one(spark, *(versions.compare(lit(a), lit(b)) for a, b, _ in cases)) == [w for *_, w in cases]
    assert one(spark, *(versions.compare(lit(b), lit(a)) for a, b, _ in cases)) == [-w for *_, w in cases]


def test_rpm_comparison(spark):
    cases = [("1.0", "1.0", 0), ("1.0~rc1", "1.0", -1), ("1.0^git1", "1.0", 1), ("1.0^git1", "1.0.1", -1), ("1.0a", "1.0", 1), ("1.0a", "1.0.1", -1), ("1.010", "1.10", 0), ("0:2.0", "1:1.0", -1), ("2.0-1.el8", "2.0-10.el8", -1), ("2.0", "2.0-1", -1), ("1..0", "1.0", 0), ("a:1", "1", -1), ("", "0", -1), ("1.0~~", "1.0~", -1)]
    assert one(spark, *(versions.rpm_compare(lit(a), lit(b)) for a, b, _ in cases)) == [w for *_, w in cases]
    assert one(spark, *(versions.not_yet_fixed(lit(a), lit(b)) for a, b in (("1-1", "1-2"), ("1-2", "1-2"), (None, "1"), ("1", " ")))) == [True, False, True, True]


def test_ranges(spark):
    cases = [("SEMVER", None, None, None, "1", True), ("SEMVER", "1.0", "2.0", None, "2.0.0", False), ("SEMVER", "1.0", "2.0", None, "1", True), ("ECOSYSTEM", None, None, "2", "2.0", True), ("ECOSYSTEM", None, None, "2", "2.1", False), ("GIT", None, None, None, "1", False), ("SEMVER", "1.0-rc", None, None, "2", False), ("SEMVER", None, "2", None, "1a", False), ("SEMVER", None, None, None, None, False)]
    assert one(spark, *(versions.in_range(*map(lit, c[:5])) for c in cases)) == [c[5] for c in cases]
    catalogue = [("1", "-", None, None, None, None, False), ("1.X", "1.x", "5", None, None, None, True), ("1", "*", None, None, None, None, True), ("1", "*", "1", None, None, None, True), ("1", "*", None, "1", None, None, False), ("2", "*", None, None, "2.0", None, True), ("2", "*", None, None, None, "2.0", False)]
    assert one(spark, *(versions.in_catalogue_range(*map(lit, c[:6])) for c in catalogue)) == [c[6] for c in catalogue]
    specs = [(None, "1", True), ("All versions", "1", True), ("All versions < V2.0", "1", True), ("All versions < V2.0", "2", False), (">= V1.0 < V2.0", "1.5", True), (">= V1.0 < V2.0", "2.0", False), ("< 1, > 3", "2", True), (">=1 <2 >=3 <4", "3.5", True), (">=1 <2 >=3 <4", "2.5", False), ("> 1 < 2 > 3", "9", True), ("V3.*", "9", True), ("no bound", "9", True), ("< 2", " ", True)]
    assert one(spark, *(versions.in_comparators(lit(a), lit(b)) for a, b, _ in specs)) == [w for *_, w in specs]


numeric = st.lists(st.integers(0, 30), min_size=1, max_size=4).map(lambda x: ".".join(map(str, x)))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(numeric, numeric), min_size=20, max_size=60))
def test_keys_agree_with_the_comparison(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    x, y = versions.key(a), versions.key(b)
    by_key = F.when(x == y, 0).when(x < y, -1).otherwise(1)
    assert df.where((by_key != versions.compare(a, b)) | (versions.compare(a, b) != -versions.compare(b, a))).isEmpty()


def test_catalogue_names(spark):
    c = lit("cpe:2.3:a:ht\\:tp:x\\\\:1.0:u:*:*:*:*:*:*")
    assert one(spark, cpe.vendor(c), cpe.product(c), cpe.version(c), cpe.with_version(c, lit("2")), cpe.part(lit("cpe:2.3::x")), cpe.vendor(lit("cpe:2.3:a:v")), cpe.version(lit("a"))) == ["ht\\:tp", "x\\\\", "1.0", "cpe:2.3:a:ht\\:tp:x\\\\:2:*:*:*:*:*:*:*", "a", None, "*"]
    assert one(spark, F.array_join(cpe.segments(lit("a:b\\")), "|"), cpe.query_name(lit("a b+c:\\d"))) == ["a|b\\", "a%20b%2Bc:%5Cd"]


@pytest.mark.parametrize(
    ("item_vendor", "name", "vendor", "product", "title", "strict", "relaxed"),
    [
        ("", "visual studio code", "microsoft", "visual_studio_code", "", True, True),
        ("", "visualstudio code", "microsoft", "visual_studio_code", "", True, True),
        ("", "visual stud", "microsoft", "visual_studio_code", "", False, False),
        ("", "android studio", "google", "android", "", False, True),
        ("google", "android studio", "motorola", "android", "", False, False),
        ("apache", "tomcat", "apache", "tomcat_native", "", False, False),
        ("", "tomcat", "apache", "tomcat_native", "", True, True),
        ("apache", "log4j core", "apache", "apache_log4j_core", "", True, True),
        ("", "microsoft", "microsoft", "other", "microsoft word", False, False),
        ("", "org.apache.tomcat:tomcat-core", "apache", "tomcat", "", True, True),
        ("", "", "a", "b", "", False, False),
    ],
)
def test_explained_names(spark, item_vendor, name, vendor, product, title, strict, relaxed):
    form = text.containment_form
    q, iv, cv = form(lit(name)), form(lit(item_vendor)), form(lit(vendor))
    of = lambda s: identify.explains(iv, q, cv, form(lit(product)), False, s) | identify.explains(iv, q, cv, form(lit(title)), True, s)
    assert one(spark, of(True), of(False)) == [strict, relaxed]


def test_forms_as_columns(spark):
    """A table's candidates pass by the same rule as single names, and no column of the forms is left."""
    form = text.containment_form
    names = [("", "visual studio code"), ("google", "android studio"), (None, "org.apache.tomcat:tomcat-core"), ("apache", "log4j core"), ("", ""), ("microsoft", "word"), ("", "android studio")]
    products = [("microsoft", "visual_studio_code", ""), ("google", "android", None), ("apache", "tomcat", "apache tomcat"), ("apache", "apache_log4j_core", ""), ("microsoft", "other", "microsoft word"), (None, None, None)]
    items = [(10 * i + j, n, v, j, *p) for i, (v, n) in enumerate(names) for j, p in enumerate(products)]  # one candidate an item
    pool = spark.createDataFrame(items, "item int, name string, item_vendor string, id int, vendor string, product string, title string")
    rule = lambda s: identify.explains(form("item_vendor"), form(text.without_host(F.col("name"))), form("vendor"), form("product"), False, s) | identify.explains(form("item_vendor"), form(text.without_host(F.col("name"))), form("vendor"), form("title"), True, s)
    want = {(r["item"], not r["a"]) for r in pool.select("item", rule(True).alias("a"), rule(False).alias("b")).collect() if r["a"] or r["b"]}
    got = identify.explained_candidates(pool)
    assert got.columns == [*pool.columns, "relaxed"] and {(r["item"], r["relaxed"]) for r in got.collect()} == want and len(want) > 4


def brute_prefix(query, candidate):
    spelled = ""
    for i, w in enumerate(candidate):
        spelled += w
        if spelled == "".join(query):
            return i + 1
    return -1


word = st.text("ab", min_size=1, max_size=3)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.lists(word, min_size=1, max_size=3), st.lists(word, min_size=1, max_size=4)), min_size=30, max_size=60))
def test_alignment_like_brute_force(spark, cases):
    df = spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(cases)], "i int, q array<string>, c array<string>")
    got = {r["i"]: (r["n"], r["p"]) for r in df.select("i", identify.aligned_words(F.col("q"), F.col("c")).alias("n"), text.run_at(F.col("c"), F.col("q")).alias("p")).collect()}
    for i, (q, c) in enumerate(cases):
        assert got[i] == (brute_prefix(q, c), next((k + 1 for k in range(len(c) - len(q) + 1) if c[k : k + len(q)] == q), 0))


def test_ranked_and_rescued(spark):
    rows = [(1, "foo bar", "acme", 10, "acme", "foo"), (1, "foo bar", "acme", 11, "acme", "foo_bar"), (1, "foo bar", "acme", 12, "acme", "foo_bar_pro"), (1, "foo bar", "acme", 13, "other", "foo_bar"), (2, "solo", "", 20, "x", "nothing")]
    pool = spark.createDataFrame(rows, "item int, name string, item_vendor string, id int, vendor string, product string").withColumn("title", F.lit(""))
    kept = sorted((r["id"], r["relaxed"]) for r in identify.explained_candidates(pool).collect())
    assert kept == [(11, False), (12, False), (13, False)]
    wide = pool.where("item = 1").selectExpr("*", "'1.0' as item_version", "'npm' as ecosystem", "'a' as part", "array('node.js') as targets", "5 as max_major", "case when id = 13 then 9 else 1 end as cataloged_row_count")
    assert [r["id"] for r in identify.ranked_candidates(wide).orderBy("rn").collect()] == [11, 13, 12, 10]


def test_display_order_and_quoting(spark):
    from riskloom.operators import rank

    rows = spark.createDataFrame([(1, "b", 1), (1, None, 2), (1, None, 1), (0, "a", 5), (1, "a", 9)], "item int, component string, rn int")
    assert [tuple(r) for r in rows.orderBy(*rank.display_order("item", "component")).collect()] == [(0, "a", 5), (1, None, 1), (1, None, 2), (1, "a", 9), (1, "b", 1)]
    assert one(spark, text.escaped_query(lit('a+b "c" && d:/')), text.cut_text(lit("ab"), 1), text.tracking_id(lit("2024/rhsa-1_2_3.json")), text.tracking_id(lit("x.txt"))) == ['a\\+b \\"c\\" \\&& d\\:\\/', "a", "RHSA-1:2_3", None]


def test_items_that_say_the_same(spark):
    """Rules look at one of equal items, nulls being equal, and at all of a pool's items in as many tasks as a shuffle has."""
    rows = [(5, "a", None), (3, "a", None), (4, "a", "v"), (7, "b", None)]
    first, every = identify.asked_once(spark.createDataFrame(rows, "item int, name string, item_vendor string"), ["name", "item_vendor"])
    assert sorted(r["item"] for r in first.collect()) == [3, 4, 7]
    assert sorted(tuple(r) for r in every.collect()) == [(3, 3), (4, 4), (5, 3), (7, 7)]
    pool = spark.range(500).selectExpr("cast(id as int) as item", "'foo' as name", "'acme' as item_vendor", "id", "'acme' as vendor", "'foo' as product", "'' as title")
    found = identify.explained_candidates(pool)
    assert found.rdd.getNumPartitions() == 8 and found.count() == 500
