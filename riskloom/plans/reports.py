"""Evaluation against labels, exports and labels for readers, product trees: over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import evaluate, present, rank
from riskloom.plans.lists import columns
from riskloom.session import table
from riskloom.sources import documents

_EXPECTED = """p_name || p_partkey as product_name, cast(p_size as {s}) as version, case p_partkey % 3 when 0 then 'IDENTIFIED_REGISTRY' when 1 then 'IDENTIFIED_CPE' else 'UNIDENTIFIED' end as expected_outcome, 'npm' as expected_ecosystem, lower(p_type) as expected_package_name,
  p_brand as expected_cpe_vendor, p_type as expected_cpe_product, case when p_partkey % 4 = 0 then 'x (part=a, y)' end as ground_truth_source, p_partkey % 50 = 0 as excluded"""
_ACTUAL = """p_name || p_partkey as product_name, cast(p_size as {s}) as version, 1 as sequence, case when p_partkey % 5 > 0 then 'IDENTIFIED' else 'UNIDENTIFIED' end as status, case when p_partkey % 7 > 0 then 'npm' else 'maven' end as ecosystem, upper(p_type) as package_name,
  case when p_partkey % 6 > 0 then 'cpe:2.3:' || case when p_size % 2 = 0 then 'a' else 'o' end || ':' || p_brand || ':' || p_type || ':*' end as cpe, case when p_size % 3 = 0 then '0.95' when p_size % 3 = 1 then '0.6' else '' end as confidence"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    expected = t.selectExpr(*columns(_EXPECTED.format(s="string").replace("(part=a, y)", "(part=a; y)")))
    actual = t.where("p_partkey % 13 > 0").selectExpr(*columns(_ACTUAL.format(s="string")))
    doubled = actual.where("status = 'IDENTIFIED' and confidence = '0.6'").withColumns({"sequence": F.lit(2), "confidence": F.lit("0.97")})
    return evaluate.matched(expected, actual.unionByName(doubled), "sequence")


_ROWS = f"""
e as (select {_EXPECTED.format(s="varchar").replace("(part=a, y)", "(part=a; y)")}, p_partkey from part), a as (select {_ACTUAL.format(s="varchar")}, p_partkey as k from part where p_partkey % 13 > 0),
r as (select e.*, k is not null as found, coalesce(status, '') as status, ecosystem, package_name, cpe, case when status = 'IDENTIFIED' and confidence = '0.6' then '0.97' else confidence end as confidence from e left join a on k = p_partkey)
"""
_RIGHT = """coalesce(case expected_outcome when 'IDENTIFIED_REGISTRY' then status = 'IDENTIFIED' and ecosystem = expected_ecosystem and lower(package_name) = expected_package_name
  when 'IDENTIFIED_CPE' then status = 'IDENTIFIED' and cpe is not null and (ground_truth_source is null or split_part(cpe, ':', 3) = 'a') else status = 'UNIDENTIFIED' end, false)"""


def golden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, false positives among the controls, correctness and correctness at high confidence: as they are, and as if
    one registry were not there."""
    rows = _scored(spark, sf_dir)
    both = [evaluate.metrics(r, F.col("excluded")).withColumn("scenario", F.lit(n)) for n, r in (("all", rows), ("without", evaluate.without_ecosystem(rows, "maven")))]
    return both[0].unionByName(both[1])


_METRICS = f"""count(*) filter (where expected_outcome <> 'UNIDENTIFIED') as targets, count(*) filter (where expected_outcome <> 'UNIDENTIFIED' and status = 'IDENTIFIED') as targets_identified, count(*) filter (where expected_outcome = 'UNIDENTIFIED') as controls,
  count(*) filter (where expected_outcome = 'UNIDENTIFIED' and status = 'IDENTIFIED') as controls_identified, count(*) filter (where not (excluded and found)) as scored, count(*) filter (where not (excluded and found) and {_RIGHT}) as n_right, count(*) filter (where not (excluded and found) and {_RIGHT} and try_cast(confidence as double) >= 0.95) as n_right_high"""
METRICS_SQL = f"""
with {_ROWS}, l as (select * replace (case when lost then 'UNIDENTIFIED' else status end as status, case when not lost then ecosystem end as ecosystem, case when not lost then package_name end as package_name, case when not lost then confidence end as confidence) from (select *, coalesce(ecosystem = 'maven' and cpe is null, false) as lost from r)),
m as (select 'all' as scenario, {_METRICS} from r union all select 'without', {_METRICS} from l)
select *, targets_identified::double / targets as recall, controls_identified::double / controls as control_rate, n_right::double / scored as correctness, n_right_high::double / scored as high_correctness from m
"""


def outcome_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and right rows of each expected outcome."""
    return evaluate.by_outcome(_scored(spark, sf_dir), F.col("excluded"))


OUTCOME_SQL = f'with {_ROWS} select expected_outcome, count(*) as total, count(*) filter (where {_RIGHT}) as n_right from r where not (excluded and found) group by 1'


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents, from each source its share by largest remainders, in an order that a multiplier shuffles."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return evaluate.stratified_sample(d, "source", F.col("doc_id") * 7919 % 10007, "doc_id", 100).select("doc_id", "source", "rn")


SAMPLE_SQL = """
with n as (select source, count(*) as n from documents group by 1), q as (select source, n * 100 // (select count(*) from documents) as f, n * 100 % (select count(*) from documents) as rest from n),
p as (select source, f + case when row_number() over (order by rest desc, source) <= 100 - (select sum(f) from q) then 1 else 0 end as quota from q),
d as (select doc_id, source, row_number() over (partition by source order by doc_id * 7919 % 10007, doc_id) as rn from documents) select doc_id, source, rn from d join p using (source) where rn <= quota
"""


def truth_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled catalogue items with their truth alone."""
    return evaluate.truth(_scored(spark, sf_dir))


TRUTH_SQL = f"with {_ROWS} select product_name, version, expected_cpe_vendor, expected_cpe_product, ground_truth_source from r where expected_outcome = 'IDENTIFIED_CPE'"


def levels_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence level, impact label and display name of items in every state."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 3 > 0 as identified", "case p_size % 3 when 0 then true when 1 then false end as confirmed", "case when p_size % 2 = 0 then 'c' end as cpe", "case when p_size % 5 > 1 then 'h' end as hint", "p_partkey % 4 = 0 as has", "case p_partkey % 7 when 0 then 'FINDINGS_TRUNCATED' when 1 then 'SOURCES_FAILED' when 2 then 'AI_CALL_FAILED' end as reason", "p_name", "case when p_size % 7 = 0 then p_name || ' (x)' end as raw")
    status = F.when(F.col("identified"), "IDENTIFIED").otherwise("UNIDENTIFIED")
    return t.select("p_partkey", present.level(F.col("identified"), F.col("confirmed"), F.col("cpe"), F.col("hint")).alias("level"), present.impact(F.col("has"), status, F.col("reason"), F.col("hint")).alias("impact"), present.display_name(F.col("raw"), F.col("p_name")).alias("name"))


LABELS_SQL = """
with t as (select p_partkey, p_name, p_size, p_partkey % 3 > 0 as i, p_partkey % 4 = 0 as has, case p_partkey % 7 when 0 then 'findings_truncated' when 1 then 'sources_failed' when 2 then 'ai_call_failed' end as reason, p_size % 5 > 1 as hint from part)
select p_partkey, case when not i then case when hint then 'hint' else 'none' end when p_size % 3 = 0 then 'high' when p_size % 2 = 0 then 'medium' else 'low' end as level,
  case when has then case when reason = 'findings_truncated' then 'affected_truncated' else 'affected' end when i then coalesce(reason, 'none') when not hint then 'undecidable' when reason is null then 'none_by_hint' else 'hint_' || reason end as impact,
  case when p_size % 7 = 0 then p_name || ' (x)' else p_name end as name from t
"""


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve columns of an export for each customer, findings being its orders, capped at three."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as item", "cast(o_orderkey as string) as finding", "o_orderkey as tie", "case when o_orderkey % 3 = 0 then o_orderpriority end as component", "o_orderstatus as component_version", "case when o_orderkey % 5 = 0 then 'A' || o_orderkey end as advisory_id", "case when o_orderkey % 10 = 0 then 'fixed' end as advisory_status", "cast(o_totalprice as double) as cvss")
    view = rank.capped_view(o, "item", "component", "component_version", "advisory_id", F.col("cvss"), "tie", 3)
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as item", "c_name as product_name", "case when c_custkey % 4 = 0 then c_name || ' (r)' end as raw_product_name", "'1' as version", "c_mktsegment as vendor", "'IDENTIFIED' as status", "cast(null as string) as ecosystem", "case when c_custkey % 2 = 0 then 'p' end as package_name", "'c' as cpe", "0.5D as confidence", "case when c_custkey % 6 = 0 then 'SOURCES_FAILED' end as research_incomplete_reason")
    return present.export_rows(c, view)


EXPORT_SQL = """
with o as (select o_custkey as item, o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority end as component, o_orderstatus as v, o_orderkey % 5 = 0 as adv, o_totalprice::double as score from orders),
w as (select *, count(*) over (partition by item, component is null) as total, row_number() over (partition by item, component is null order by score desc, o_orderkey) as rn, dense_rank() over (partition by item order by component nulls last, v nulls last) as cr from o),
k as (select * from w where (component is null and rn <= 3) or (component is not null and cr <= 3) or adv),
b as (select item, string_agg(x, '; ' order by component, r) as bundled from (select item, component, component || ' ' || v as x, min(rn) as r from k where component is not null group by all) group by 1),
g as (select item, count(*) filter (where component is null) as shown, coalesce(max(total) filter (where component is null), 0) as n, coalesce(string_agg(o_orderkey::varchar, '; ' order by rn) filter (where component is null), '') as cell,
  coalesce(string_agg(o_orderkey || ': ' || case when o_orderkey % 10 = 0 then 'fixed' else '' end || ' (A' || o_orderkey || ')', '; ' order by component is null, rn, o_orderkey::varchar || ': ') filter (where adv), '') as csaf from k group by 1)
select c_custkey as item, case when c_custkey % 4 = 0 then c_name || ' (r)' else c_name end as product_name, '1' as version, c_mktsegment as vendor, 'IDENTIFIED' as status, null::varchar as ecosystem, case when c_custkey % 2 = 0 then 'p' else 'c' end as package_or_cpe, 0.5::double as confidence, coalesce(n, 0) as vulnerability_count,
  case when coalesce(n, 0) <= coalesce(shown, 0) then coalesce(cell, '') when cell = '' then '他' || (n - shown) || '件' else cell || '; 他' || (n - shown) || '件' end as vulnerabilities, coalesce(bundled, '') as bundled_component_findings, coalesce(csaf, '') as csaf_vendor_status, case when c_custkey % 6 = 0 then 'SOURCES_FAILED' else '' end as research_incomplete_reason
from customer left join g on g.item = c_custkey left join b on b.item = c_custkey
"""


def shown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many own and component findings the capped view shows of each customer, and how many there are."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey as item", "o_orderkey as tie", "case when o_orderkey % 3 = 0 then o_orderpriority end as component", "o_orderstatus as v", "cast(null as string) as advisory", "cast(o_totalprice as double) as cvss")
    return present.shown_counts(rank.capped_view(o, "item", "component", "v", "advisory", F.col("cvss"), "tie", 2))


COUNTS_SQL = """
with o as (select o_custkey as item, o_orderkey, case when o_orderkey % 3 = 0 then o_orderpriority end as component, o_orderstatus as v, o_totalprice::double as score from orders),
w as (select *, count(*) over (partition by item, component is null) as total, row_number() over (partition by item, component is null order by score desc, o_orderkey) as rn, dense_rank() over (partition by item order by component nulls last, v nulls last) as cr from o),
k as (select * from w where (component is null and rn <= 2) or (component is not null and cr <= 2))
select item, count(*) filter (where component is null) as product_shown, coalesce(max(total) filter (where component is null), 0) as product_total, count(*) filter (where component is not null) as bundled_shown, coalesce(max(total) filter (where component is not null), 0) as bundled_total from k group by 1
"""


def product_tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of trees: one document for each brand, a branch for each part, a platform and relationships with it. A document comes in
    pieces of a hundred keys, so none is held whole."""
    t = table(spark, sf_dir, "part").selectExpr("p_brand as advisory_id", "p_partkey div 100 as piece", "p_partkey", "p_name", "p_size", "p_type")
    leaf = F.concat(
        F.lit('{"category":"product_name","name":"'), F.col("p_name"), F.lit('","branches":[{"category":"product_version","name":"'), F.col("p_size").cast("string"), F.lit('","product":{"product_id":"P'), F.col("p_partkey").cast("string"), F.lit('","name":"leaf"'),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(',"product_identification_helper":{"purl":"pkg:rpm/x/'), F.col("p_type"), F.lit("@"), F.col("p_size").cast("string"), F.lit('"}'))).otherwise(""), F.lit("}}]}"),
    )
    tie = F.concat(F.lit('{"product_reference":"P'), F.col("p_partkey").cast("string"), F.lit('","relates_to_product_reference":"OS","full_product_name":{"product_id":"OS:P'), F.col("p_partkey").cast("string"), F.lit('"}}'))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("v")))), lambda x: x["v"]), ",")
    os = '{"category":"product_name","name":"Linux","product":{"product_id":"OS","name":"Linux"}},'
    docs = t.groupBy("advisory_id", "piece").agg(F.concat(F.lit('{"product_tree":{"branches":[' + os), ordered(leaf), F.lit('],"relationships":['), ordered(tie), F.lit("]}}")).alias("json"))
    return documents.product_trees(docs, piece_col="piece").select("advisory_id", "product_id", "component", "version", "platform", "canonical", "is_canonical")


TREE_SQL = """
with l as (select p_brand as advisory_id, p_partkey, case when p_partkey % 4 = 0 then p_type else p_name end as component, p_size::varchar as version from part),
r as (select distinct p_brand as advisory_id, 'OS' as product_id, 'Linux' as component, null::varchar as version, null::varchar as platform, -1 as place from part union all select advisory_id, 'P' || p_partkey, component, version, null, p_partkey from l union all select advisory_id, 'OS:P' || p_partkey, component, version, 'Linux', p_partkey + 1000000000 from l)
select advisory_id, product_id, component, version, platform, c as canonical, c = product_id as is_canonical from (select *, first_value(product_id) over (partition by advisory_id, component, coalesce(version, ''), coalesce(platform, '') order by place) as c from r)
"""

#: name -> (query, DuckDB SQL)
REPORTS = {
    "golden_metrics": (golden_metrics, METRICS_SQL), "outcome_breakdown": (outcome_breakdown, OUTCOME_SQL), "stratified_sample": (stratified_sample, SAMPLE_SQL), "truth_projection": (truth_projection, TRUTH_SQL),
    "levels_and_labels": (levels_and_labels, LABELS_SQL), "export_rows": (export_rows, EXPORT_SQL), "shown_counts": (shown_counts, COUNTS_SQL), "product_tree_walk": (product_tree_walk, TREE_SQL),
}
