"""What a reader of results sees: levels, labels, counts, cells of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT = ["product_name", "version", "vendor", "status", "ecosystem", "package_or_cpe", "confidence", "vulnerability_count", "vulnerabilities", "bundled_component_findings", "csaf_vendor_status", "research_incomplete_reason"]


def level(identified: Column, confirmed: Column, cpe: Column, hint: Column) -> Column:
    unknown = F.when(hint.isNotNull(), "hint").otherwise("none")
    return F.when(~F.coalesce(identified, F.lit(False)), unknown).when(F.coalesce(confirmed, F.lit(False)), "high").when(cpe.isNotNull(), "medium").otherwise("low")


def impact(has_findings: Column, status: Column, reason: Column, hint: Column) -> Column:
    """affected, affected_truncated, none, none_by_hint, undecidable, or why nothing was looked for: "not affected" is said
    only where the research was complete."""
    named = status == "IDENTIFIED"
    return (
        F.when(has_findings & (reason == "FINDINGS_TRUNCATED"), "affected_truncated")
        .when(has_findings, "affected")
        .when(named & reason.isNull(), "none")
        .when(named, F.lower(reason))
        .when(hint.isNull(), "undecidable")
        .when(reason.isNull(), "none_by_hint")
        .otherwise(F.concat(F.lit("hint_"), F.lower(reason)))
    )


def display_name(raw: Column, name: Column) -> Column:
    return F.coalesce(raw, name)


def cap_notice(shown: Column, n_shown: Column, total: Column) -> Column:
    """A cell with a notice of how many entries it leaves out, in the wording of the exports."""
    notice = F.concat(F.lit("他"), (total - n_shown).cast("string"), F.lit("件"))
    return F.when(total <= n_shown, shown).when(shown == "", notice).otherwise(F.concat(shown, F.lit("; "), notice))


def cell(place: Column, value: Column, when: Column | None = None, distinct: bool = False) -> Column:
    """An aggregate: values in order, joined by "; "; ``distinct`` keeps the first of equal ones."""
    entry = F.struct(place.alias("p"), value.alias("v"))
    values = F.transform(F.array_sort(F.collect_list(entry if when is None else F.when(when, entry))), lambda x: x["v"])
    return F.array_join(F.array_distinct(values) if distinct else values, "; ")


def shown_counts(view: DataFrame) -> DataFrame:
    """Per item, own findings and those of components: how many the capped view shows and how many there are."""
    own = F.col("component").isNull()
    agg = {"product": own, "bundled": ~own}
    out = [x for k, w in agg.items() for x in (F.count_if(w).alias(f"{k}_shown"), F.coalesce(F.max(F.when(w, F.col("total_count"))), F.lit(0)).alias(f"{k}_total"))]
    return view.groupBy("item").agg(*out)


def export_rows(items: DataFrame, view: DataFrame) -> DataFrame:
    """The twelve columns of an export, one row for each item, from the capped view (item, finding, component,
    component_version, advisory_id, status, total_count, rn)."""
    own = F.col("component").isNull()
    cells = view.groupBy("item").agg(
        F.count_if(own).alias("n_shown"), F.coalesce(F.max(F.when(own, F.col("total_count"))), F.lit(0)).alias("vulnerability_count"), cell(F.col("rn"), F.col("finding"), own).alias("shown"),
        cell(F.struct("component", "rn"), F.concat_ws(" ", "component", "component_version"), ~own, distinct=True).alias("bundled_component_findings"),
        cell(F.struct(own.alias("o"), "rn"), F.concat(F.col("finding"), F.lit(": "), F.coalesce("advisory_status", F.lit("")), F.lit(" ("), F.col("advisory_id"), F.lit(")")), F.col("advisory_id").isNotNull()).alias("csaf_vendor_status"),
    )
    rows = items.join(cells, "item", "left").withColumn("vulnerability_count", F.coalesce("vulnerability_count", F.lit(0)))
    values = {
        "product_name": display_name(F.col("raw_product_name"), F.col("product_name")), "package_or_cpe": F.coalesce("package_name", "cpe"),
        "vulnerabilities": cap_notice(F.coalesce("shown", F.lit("")), F.coalesce("n_shown", F.lit(0)), F.col("vulnerability_count")),
        **{c: F.coalesce(c, F.lit("")) for c in ("bundled_component_findings", "csaf_vendor_status", "research_incomplete_reason")},
    }
    return rows.withColumns(values).select("item", *EXPORT)
