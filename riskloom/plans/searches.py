"""Searches for similar names and the identification rules on what they find, over names made from the driver's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import trigrams
from riskloom.operators import cascade, fuzzy, identify
from riskloom.plans.lists import columns
from riskloom.session import table


#: Versions and targets of the catalogue's names, in SQL that both engines read: some of a year, some none.
_NAMED = "case p_partkey % 11 when 0 then '2019' when 1 then '-' else p_size || '.' || (p_partkey % 7) end as number, case p_partkey % 3 when 0 then 'node.js' when 1 then '*' else 'wordpress' end as target"


def _named(rows: DataFrame) -> DataFrame:
    """Adds the catalogue name of each row, whose vendor holds an escaped colon where its id is divisible by five."""
    vendor = F.when(F.col("id") % 5 == 0, F.concat(F.col("vendor"), F.lit(r"\:x"))).otherwise(F.col("vendor"))
    return rows.withColumn("cpe", F.concat_ws(":", F.lit("cpe:2.3:a"), vendor, "product", "number", F.lit("*:*:*:*"), "target", F.lit("*:*"))).drop("number", "target")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return _named(t.selectExpr("p_partkey as id", "lower(replace(p_brand, '#', '_')) as vendor", "replace(p_name, ' ', '_') || case when p_size % 3 = 0 then '_' || lower(p_type) else '' end as product", "p_brand || ' ' || p_name as title", *columns(_NAMED)))


_CATALOGUE = f"select p_partkey as id, lower(replace(p_brand, '#', '_')) as vendor, replace(p_name, ' ', '_') || case when p_size % 3 = 0 then '_' || lower(p_type) else '' end as product, p_brand || ' ' || p_name as title, {_NAMED} from part"


def majors_sql(rows: str) -> str:
    """Statistics of each vendor and product of ``rows`` (vendor, product, number, target), for all of them."""
    return f"""
select vendor, product, n as cataloged_row_count, all_targets, (case when r >= 20 and d >= 3 and p >= 4 and m > 4 * p then p else m end)::bigint as max_major from (
  select vendor, product, n, all_targets, case when k then nr else r end as r, case when k then nd else d end as d, case when k then nm else m end as m, case when k then np else p end as p from (
    select *, r > nr and (r - nr) * 10 < r and nr > 0 as k from (
      select vendor, product, count(*) as n, list_sort(list_distinct(list(target))) as all_targets, count(j) as r, count(distinct j) as d, max(j) as m, quantile_disc(j, 0.99) as p,
        count(j) filter (where j < 1000) as nr, count(distinct j) filter (where j < 1000) as nd, max(j) filter (where j < 1000) as nm, quantile_disc(j, 0.99) filter (where j < 1000) as np
      from (select *, try_cast(regexp_extract(number, '^[0-9]{{1,9}}', 0) as int) as j from {rows}) group by 1, 2)))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 100 = 0").selectExpr("p_partkey as item", "p_name || case when p_size % 2 = 0 then ' ' || p_type else '' end as name", "replace(p_brand, '#', ' ') as vendor")


_ITEMS = "select p_partkey as item, p_name || case when p_size % 2 = 0 then ' ' || p_type else '' end as name, replace(p_brand, '#', ' ') as vendor from part where p_partkey % 100 = 0"


def grams_sql(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\pL\\p{{Nd}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


def score_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))::float"


def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types that share at least three tenths of their trigrams."""
    p = table(spark, sf_dir, "part")
    left = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    names = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")).unionByName(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    found = trigrams.similar(left, names.groupBy("name").agg(F.min("id").alias("id")), 0.3)
    return found.select("left_id", "right_id", "shared", "total")


def trigram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the 20 most similar records by product or title, a record's better score counting; brands are records."""
    products = _catalogue(spark, sf_dir).select("id", "product", F.col("title").alias("package_name"), F.col("vendor").alias("record"))
    return fuzzy.record_search(_items(spark, sf_dir), products).withColumn("score", F.col("score").cast("double"))


TOP_K_SQL = f"""
with i as (select *, {grams_sql("name")} as g from ({_ITEMS})), c as (select *, {grams_sql("product")} as gp, {grams_sql("title")} as gt from ({_CATALOGUE})),
s as (select item, id, c.vendor, {score_sql("g", "gp")} as score, 1 as l from i, c union all select item, id, c.vendor, {score_sql("g", "gt")}, 2 from i, c),
t as (select *, row_number() over (partition by item, l order by score desc, id) as rn from s where score >= 0.4::float)
select item, vendor as record, max(score)::double as score from t where rn <= 20 group by 1, 2
"""


def two_column_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the 40 best catalogue rows by product or title, one of each vendor and product."""
    return fuzzy.two_column_search(_items(spark, sf_dir), _catalogue(spark, sf_dir)).withColumn("score", F.col("score").cast("double"))


_POOL_SQL = f"""i as (select *, {grams_sql("name")} as g from ({_ITEMS})), c as (select *, {grams_sql("product")} as gp, {grams_sql("title")} as gt from ({_CATALOGUE})), stats as ({majors_sql("c")}),
s as (select item, id, c.vendor, product, target, {score_sql("g", "gp")} as score, 1 as l, 0.3 as t from i, c union all select item, id, c.vendor, product, target, {score_sql("g", "gt")}, 2, 0.6 from i, c),
f as (select * from s where score >= t::float and score::double > t::double),
d as (select distinct on (item, l, vendor, product) * exclude (target) from f order by item, l, vendor, product, score desc, id), tg as (select item, l, vendor, product, list_sort(list_distinct(list(target))) as targets from f group by all),
r as (select * from (select *, row_number() over (partition by item, l order by score desc, id) as rn from d) where rn <= 40),
b as (select distinct on (item, id) item, id, vendor, product, score, targets from r join tg using (item, l, vendor, product) order by item, id, score desc, l),
pool as (select item, id, vendor, product, score::double as score, rn, targets, cataloged_row_count, max_major from (select *, row_number() over (partition by item order by score desc, id) as rn from b) join stats using (vendor, product) where rn <= 40)"""
TWO_COLUMN_SQL = f"with {_POOL_SQL} select item, id, score, rn, targets, cataloged_row_count, max_major from pool"


def exact_then_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the very name, the newest first, else similar ones of one brand's rows."""
    items = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").selectExpr("p_partkey as item", "case when p_size % 3 = 0 then upper(p_name) else p_name || ' x' end as name")
    products = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "replace(p_name, ' ', '-') as component", "p_size as updated", "p_partkey % 2 as vendor")
    return fuzzy.advisory_search(items, products, fallback=F.col("vendor") == 1).withColumn("score", F.col("score").cast("double"))


EXACT_SQL = f"""
with i as (select p_partkey as item, case when p_size % 3 = 0 then upper(p_name) else p_name || ' x' end as name from part where p_partkey % 100 = 0), p as (select p_partkey as id, replace(p_name, ' ', '-') as component, p_size as updated, p_partkey % 2 as vendor from part),
e as (select item, id, 'exact' as path, 1.0::float as score, updated from i join p on lower(name) = replace(lower(component), '-', ' ')),
f as (select item, id, 'similar' as path, {score_sql(grams_sql("name"), grams_sql("component"))} as score, updated from i join p on vendor = 1 and item not in (select item from e)),
u as (select * from e union all select * from f where score >= 0.35::float)
select item, id, path, score::double as score, rn from (select *, row_number() over (partition by item order by score desc, updated desc nulls last, id) as rn from u) where rn <= 30
"""


def initialism_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose first words' initials are an item's first word, followed by its other words."""
    t = table(spark, sf_dir, "part")
    catalogue = t.selectExpr("p_partkey as id", "p_brand as vendor", "lower(replace(p_name, ' ', '_') || '_' || p_type || case when p_size % 2 = 0 then '_pro' else '' end) as product")
    items = t.where("p_partkey % 100 = 0").selectExpr("p_partkey as item", "upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) || ' ' || p_type as name")
    return fuzzy.initialism_search(items, catalogue).select("item", "id", "vendor", "product", "rn")


INITIALISM_SQL = """
with c as (select p_partkey as id, p_brand as vendor, lower(replace(p_name, ' ', '_') || '_' || p_type || case when p_size % 2 = 0 then '_pro' else '' end) as product from part),
i as (select p_partkey as item, lower(substr(p_name, 1, 1)) as a, lower(substr(split_part(p_name, ' ', 2), 1, 1)) as b, lower(p_type) as t from part where p_partkey % 100 = 0),
m as (select distinct on (item, vendor, product) item, id, vendor, product from i join c on regexp_matches(product, '^' || a || '[^_]*_' || b || '[^_]*_' || t || '(_|$)') order by item, vendor, product, id)
select item, id, vendor, product, rn from (select *, row_number() over (partition by item order by length(product), id) as rn from m) where rn <= 500
"""


def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows whose product is a word of an item's name and whose vendor is a word of its vendor."""
    t = table(spark, sf_dir, "part")
    items = t.where("p_partkey % 100 = 0").selectExpr("p_partkey as item", "p_type || ' ' || p_name as name", "replace(p_brand, '#', ' ') || ' Inc' as vendor")
    catalogue = t.selectExpr("p_partkey as id", "case when p_size % 2 = 0 then 'brand' else split_part(p_brand, '#', 2) end as vendor", "lower(case when p_size % 3 = 0 then p_type else split_part(p_name, ' ', 2) end) as product", *columns(_NAMED))
    return fuzzy.pair_search(items, _named(catalogue))


PAIRS_SQL = f"""
with i as (select p_partkey as item, lower(p_type) as t, lower(split_part(p_name, ' ', 1)) as n1, lower(split_part(p_name, ' ', 2)) as n2, split_part(p_brand, '#', 2) as v from part where p_partkey % 100 = 0),
a as (select case when p_size % 2 = 0 then 'brand' else split_part(p_brand, '#', 2) end as vendor, lower(case when p_size % 3 = 0 then p_type else split_part(p_name, ' ', 2) end) as product, p_partkey as id, {_NAMED} from part),
c as (select vendor, product, min(id) as id from a group by 1, 2), stats as ({majors_sql("a")})
select item, id, vendor, product, rn, all_targets as targets, cataloged_row_count, max_major from (select item, id, vendor, product, row_number() over (partition by item order by id) as rn from i join c on vendor in ('brand', v, 'inc') and product in (t, n1, n2)) join stats using (vendor, product) where rn <= 40
"""


def explained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found catalogue rows that explain their item's name."""
    items, catalogue = _items(spark, sf_dir).withColumnRenamed("vendor", "item_vendor"), _catalogue(spark, sf_dir)
    first, every = identify.asked_once(items, ["name", "item_vendor"])
    pool = fuzzy.two_column_search(first, catalogue).select("item", "id").join(first, "item").join(catalogue, "id")
    found = identify.explained_candidates(pool).withColumnRenamed("item", "asked")
    return every.join(found, "asked").select("item", "id", "vendor", "product", "relaxed")


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found rows in the order of preference for their item, with what decided."""
    items, catalogue = _items(spark, sf_dir).withColumnRenamed("vendor", "item_vendor"), _catalogue(spark, sf_dir)
    items = items.selectExpr("*", "(item % 40) || '.1' as item_version", "case when item % 200 = 0 then 'npm' end as ecosystem")
    first, every = identify.asked_once(items, ["name", "item_vendor", "item_version", "ecosystem"])
    pool = fuzzy.two_column_search(first, catalogue).drop("rn", "score").join(first, "item").join(catalogue.select("id", "vendor", "product"), "id")
    ranked = identify.ranked_candidates(pool.selectExpr("*", "case when id % 7 = 0 then 'o' when id % 11 = 0 then 'h' else 'a' end as part"))
    return every.join(ranked.withColumnRenamed("item", "asked"), "asked").select(*ranked.columns)


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z0-9]+')"


def _holds(wide: str, slug: str, wide_words: str, slug_words: str) -> str:
    return f"({slug} <> '' and {wide} <> '' and (contains({wide}, {slug}) or (len({slug_words}) > 0 and len(list_filter({slug_words}, lambda w: not list_contains({wide_words}, w))) = 0)))"


RANK_SQL = f"""
with {_POOL_SQL},
k as (select pool.*, case when id % 7 = 0 then 'o' when id % 11 = 0 then 'h' else 'a' end as part, i.name, i.vendor as item_vendor, item % 40 as own, item % 200 = 0 as npm from pool join i using (item)),
m as (select *, bool_or(part = 'a') over (partition by item) as has_app from k where part <> 'h'),
u as (select distinct on (item, vendor, product) * from m where part = 'a' or not has_app order by item, vendor, product, id),
e as (select *, replace(lower(product), '_', ' ') as slug, {_words("lower(replace(product, '_', ' '))")} as w, replace(vendor, '_', ' ') as cv, lower(item_vendor) as iv, {_words("lower(name)")} as q,
  case when max_major is null or max_major <= 0 then 1 when own <= max_major then 0 when own <= 2 * max_major then 1 else 2 end as cover from u),
g as (select e.item, e.id, bool_or(s.id <> e.id and s.cover = 0 and s.cv = e.cv and {_holds("s.slug", "e.slug", "s.w", "e.w")}) as current, bool_or(len(s.w) > 0 and len(s.w) < len(e.w) and e.w[1:len(s.w)] = s.w) as derived from e join e s using (item) group by 1, 2),
o as (select item, id, vendor, product, not (array_to_string(q, ' ') = array_to_string(w, ' ') and not (cover = 2 and current)) as by_not_exact, not coalesce(npm and list_contains(targets, 'node.js'), false) as by_other_target,
  len(list_filter(q, lambda x: not list_contains(w, x) and not (list_contains({_words("cv")}, x) or (length(x) >= 4 and contains(array_to_string({_words("cv")}, ''), x)))))::int as by_unexplained, cover as by_coverage, not (contains(iv, cv) or contains(cv, iv)) as by_other_vendor, derived as by_derived, -cataloged_row_count as by_fewer_rows from e join g using (item, id))
select * from (select *, row_number() over (partition by item order by by_not_exact, by_other_target, by_unexplained, by_coverage, by_other_vendor, by_derived, by_fewer_rows, id) as rn from o) where rn <= 10
"""


def fallback_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's candidates of the first stage of the fallback cascade that has any: names that are similar, that hold a pair
    of words, that fewer words find in a further table, or that nothing finds."""
    t = table(spark, sf_dir, "part")
    name = "case p_partkey % 300 when 0 then p_name when 100 then split_part(p_name, ' ', 2) || ' of many quite different long words' when 200 then case when p_size % 2 = 0 then upper(left(p_name, 1) || left(split_part(p_name, ' ', 2), 1)) || ' ' || p_type else p_type || ' unit ' || p_size || ' deluxe' end else p_type || ' unit ' || p_size || ' deluxe' end as name"
    vendor = "case p_partkey % 300 when 200 then p_type else replace(p_brand, '#', ' ') end as vendor"
    items = t.where("p_partkey % 100 = 0").selectExpr("p_partkey as item", name, vendor, "p_size || '.0' as version", "cast(null as string) as declared", "case when p_size % 9 = 0 then 'npm' end as ecosystem")
    short = _named(t.selectExpr("p_partkey + 1000000000 as id", "case when p_size % 2 = 0 then 'brand' else split_part(p_brand, '#', 2) end as vendor", "lower(split_part(p_name, ' ', 2)) as product", "p_type as title", *columns(_NAMED)))
    further = _named(t.selectExpr("p_partkey + 2000000000 as id", "lower(p_type) as vendor", "lower(p_type) || '_unit_' || p_size as product", "p_type || ' Unit ' || p_size as title", *columns(_NAMED)))
    return cascade.cascade(items, _catalogue(spark, sf_dir).unionByName(short), further)


def bundled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each order that one vendor alone makes under exactly this name."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_brand as vendor", "replace(p_name, ' ', '-') || '_' || p_type || case when p_size % 2 = 0 then cast(p_size as string) else '' end as product", "case when p_partkey % 4 > 0 then array('*', 'x') else array('x') end as targets")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    components = lines.selectExpr("l_orderkey as item", "struct(l_linenumber, l_suppkey, l_partkey) as place", "case when l_partkey % 5 = 0 then ' ' else case when l_partkey % 3 = 0 then '@s/' else '' end || replace(upper(p_name), ' ', '_') || p_type || case when p_size % 2 = 0 then cast(p_size as string) else '' end end as name", "cast(p_size as string) as version")
    return identify.bundled_components(components, t).select("item", "id", "name", "version", "vendor")


BUNDLED_SQL = """
with c as (select lower(regexp_replace(p_name || p_type || case when p_size % 2 = 0 then p_size::varchar else '' end, '[\\s_-]', '', 'g')) as k, min(p_brand) as vendor, max(p_brand) as other, min(p_partkey) as id, bool_or(p_partkey % 4 > 0) as wild from part group by 1),
l as (select l_orderkey as item, l_partkey, case when l_partkey % 5 = 0 then ' ' else case when l_partkey % 3 = 0 then '@s/' else '' end || replace(upper(p_name), ' ', '_') || p_type || case when p_size % 2 = 0 then p_size::varchar else '' end end as name, p_size::varchar as version,
  lower(regexp_replace(p_name || p_type || case when p_size % 2 = 0 then p_size::varchar else '' end, '[\\s_-]', '', 'g')) as k, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as rn from lineitem join part on l_partkey = p_partkey where l_partkey % 5 > 0)
select item, id, name, version, vendor from l join c using (k) where rn <= 10 and vendor = other and (wild or starts_with(name, '@'))
"""

#: name -> (query, DuckDB SQL)
SEARCHES = {
    "trigram_top_k": (trigram_top_k, TOP_K_SQL), "two_column_fuzzy": (two_column_fuzzy, TWO_COLUMN_SQL), "exact_then_fuzzy": (exact_then_fuzzy, EXACT_SQL), "initialism_regex": (initialism_regex, INITIALISM_SQL), "exact_pairs": (exact_pairs, PAIRS_SQL),
    "explained_candidates": (explained_candidates, None), "candidate_rank": (candidate_rank, RANK_SQL), "bundled_components": (bundled_components, BUNDLED_SQL), "fallback_stages": (fallback_stages, None),
}
