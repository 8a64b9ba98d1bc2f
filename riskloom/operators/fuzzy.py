"""Searches of a catalogue for many names at once: similar names, initialisms, exact pairs, exact before similar.

Catalogue rows have ``id``, ``vendor``, ``product``, ``title``, ``cpe``; items have ``item`` and ``name`` (and ``vendor``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import cpe, text
from riskloom.functions.trigrams import similar_names
from riskloom.operators.rank import top_each
from riskloom.operators.stats import candidate_statistics
from riskloom.session import cut

# Thresholds of the searched columns, and how many candidates a search keeps.
PRODUCT, TITLE, RECORDS, ADVISORIES = 0.3, 0.6, 0.4, 0.35
POOL, RECORD_POOL, ADVISORY_POOL, INITIALISM_POOL = 40, 20, 30, 500


def two_column_search(items: DataFrame, catalogue: DataFrame, pool: int = POOL, product: float = PRODUCT, title: float = TITLE) -> DataFrame:
    """(item, id, score, rn, targets, cataloged_row_count, max_major): by product and by title; of each vendor and product the best
    row by either column, of both lists each row's better score, the ``pool`` best of an item.

    ``targets`` are those of the rows of the vendor and product that the list found which gave the score (the product's, of equal
    ones); the counts are of all the catalogue's rows of the vendor and product.

    Rows of one name, vendor and product are one entry with their least id, and items of one name are searched once, so the work is
    that of the different names, whatever the number of their rows; items meet their list when it is cut. The catalogue is read once
    for its different rows, which are stored (else conditions on their trigrams would be asked of every row of every reading), and
    once for the statistics.
    """
    names = items.select("name").distinct()
    rows = cut(catalogue.groupBy("product", "title", "vendor").agg(F.min("id").alias("id"), F.collect_set(cpe.plain_segment(F.col("cpe"), 11)).alias("targets")))
    lists = None
    for place, (column, threshold) in enumerate((("product", product), ("title", title))):
        entries = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("right_name"), "vendor", "product").agg(F.min("id").alias("id"), F.array_distinct(F.flatten(F.collect_list("targets"))).alias("targets"))
        found = similar_names(names, entries.select(F.col("right_name").alias("name")), threshold, threshold).join(entries, "right_name")
        once = found.groupBy("left_name", "vendor", "product").agg(F.max(F.struct("score", (-F.col("id")).alias("minus_id"))).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("targets")))).alias("targets"))
        once = once.select(F.col("left_name").alias("name"), (-F.col("b.minus_id")).alias("id"), F.col("b.score").alias("score"), F.lit(-place).alias("list"), "targets", "vendor", "product")
        best = top_each(once, ["name"], pool, F.desc("score"), F.asc("id")).drop("rn")
        lists = best if lists is None else lists.unionByName(best)
    merged = lists.groupBy("name", "id").agg(F.max("score").alias("score"), F.max_by(F.struct("targets", "vendor", "product"), F.struct("score", "list")).alias("of"))
    ranked = top_each(merged, ["name"], pool, F.desc("score"), F.asc("id")).select("name", "id", "score", "rn", "of.*")
    return items.select("item", "name").distinct().join(with_statistics(ranked, catalogue), "name").drop("name")


def with_statistics(found: DataFrame, catalogue: DataFrame, targets: bool = False) -> DataFrame:
    """Adds the statistics of each candidate's partition (vendor, product), which are counted for the partitions named only; and, if
    asked, the targets of all its rows."""
    found = cut(found)
    facts = candidate_statistics(catalogue, found, ["vendor", "product"])
    if targets:
        rows = catalogue.join(found.select("vendor", "product").distinct(), ["vendor", "product"], "left_semi")
        facts = facts.join(rows.groupBy("vendor", "product").agg(F.array_sort(F.collect_set(cpe.plain_segment(F.col("cpe"), 11))).alias("targets")), ["vendor", "product"])
    return found.join(facts, ["vendor", "product"], "left").drop("vendor", "product")


def record_search(items: DataFrame, products: DataFrame, pool: int = RECORD_POOL, threshold: float = RECORDS) -> DataFrame:
    """(item, record, score): records with a similar product or package name; each column's best ``pool`` rows are taken
    before a record's rows become one.

    Rows of one name have one score, so its ``pool`` least ids are all that a list can take of them, and items of one name are
    searched once.
    """
    names, rows = items.select("name").distinct(), None
    for column in ("product", "package_name"):
        named = products.where(F.col(column).isNotNull()).select(F.col(column).alias("right_name"), "id", "record")
        first = top_each(named, ["right_name"], pool, F.asc("id")).drop("rn")
        near = similar_names(names, named.select(F.col("right_name").alias("name")), threshold)
        found = top_each(near.join(first, "right_name"), ["left_name"], pool, F.desc("score"), F.asc("id"))
        rows = found if rows is None else rows.unionByName(found)
    once = rows.groupBy(F.col("left_name").alias("name"), "record").agg(F.max("score").alias("score"))
    return items.select("item", "name").distinct().join(once, "name").select("item", "record", "score")


def advisory_search(items: DataFrame, products: DataFrame, pool: int = ADVISORY_POOL, threshold: float = ADVISORIES, fallback: Column | None = None) -> DataFrame:
    """(item, id, path, rn): rows whose normalised ``component`` equals the item's, newest advisory first; only for items
    without such rows, and of those rows for which ``fallback`` holds, similar ones.

    Rows of one component differ in their advisory's time and id alone, so its first ``pool`` by these are all that a list can take
    of them, and items of one name are searched once.
    """
    newest = (F.desc_nulls_last("updated"), F.asc("id"))
    named = items.select("item", "name", text.source_form(F.col("name")).alias("key")).distinct()
    rows = products.select("id", "updated", text.source_form(F.col("component")).alias("key"))
    exact = named.join(top_each(rows, ["key"], pool, *newest), "key").select("item", "id", F.lit("exact").alias("path"), F.lit(1.0).cast("float").alias("score"), "rn")
    rest = named.join(rows.select("key").distinct(), "key", "left_anti")
    some = (products if fallback is None else products.where(fallback)).where(F.col("component").isNotNull()).select(F.col("component").alias("right_name"), "id", "updated")
    near = similar_names(rest, some.select(F.col("right_name").alias("name")), threshold).join(top_each(some, ["right_name"], pool, *newest).drop("rn"), "right_name")
    near = top_each(near, ["left_name"], pool, F.desc("score"), *newest).select(F.col("left_name").alias("name"), "id", F.lit("similar").alias("path"), "score", "rn")
    return exact.unionByName(rest.join(near, "name").select(*exact.columns))


def initialism_search(items: DataFrame, catalogue: DataFrame, pool: int = INITIALISM_POOL) -> DataFrame:
    """(item, id): products whose leading words' initials are the item's first word and that go on with its other words.

    The first word has 2 to 6 letters, the others joined at least 3. Products meet items by the other words, a run of
    whole words of the product, so no pattern is tried on every row. Of each vendor and product the shortest name, then
    the least id, counts. Items that ask for the same words are searched once.
    """
    words = text.tokens(text.containment_form(F.col("name")))
    asked = items.select("item", words.alias("w")).select("item", F.try_element_at("w", F.lit(1)).alias("short"), F.array_join(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), "_").alias("anchor"))
    asked = asked.where(F.length("short").between(2, 6) & (F.length("anchor") >= 3))
    rows = catalogue.groupBy("vendor", "product").agg(F.min("id").alias("id"))
    tokens = rows.select("id", "vendor", "product", text.tokens(text.containment_form(F.col("product"))).alias("w")).where(F.size("w") > 1)
    # Every cut of a product after its first words: what follows is an anchor if it begins so.
    cut = tokens.select("id", "vendor", "product", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("at"))
    cut = cut.select("id", "vendor", "product", text.initials(F.slice("w", F.lit(1), F.col("at"))).alias("short"), F.slice("w", F.col("at") + 1, F.size("w")).alias("rest"))
    cut = cut.where(F.length("short").between(2, 6))
    anchors = cut.select("id", "vendor", "product", "short", F.explode(F.transform(F.sequence(F.lit(1), F.size("rest")), lambda n: F.array_join(F.slice("rest", F.lit(1), n), "_"))).alias("anchor"))
    once = asked.select("short", "anchor").distinct().join(anchors, ["short", "anchor"]).select("short", "anchor", "vendor", "product", "id").distinct()
    best = top_each(once, ["short", "anchor"], pool, F.length("product").asc(), F.asc("id"))
    return asked.join(best, ["short", "anchor"]).select("item", "id", "vendor", "product", "rn")


def pair_search(items: DataFrame, catalogue: DataFrame, pool: int = POOL) -> DataFrame:
    """(item, id, rn, targets, cataloged_row_count, max_major): products that are a word of the item's name, of a vendor that is a
    word of its vendor (eight of each at most); one row of each vendor and product, the least id.

    Targets and counts are of all the catalogue's rows of the vendor and product. The catalogue is thinned out by the pairs first.
    """
    words = lambda c: text.tokens(text.containment_form(F.col(c)))
    asked = items.select("item", F.explode(text.pairs(words("vendor"), words("name"))).alias("p")).select("item", F.col("p.a").alias("vendor"), F.col("p.b").alias("product"))
    rows = catalogue.join(asked.select("vendor", "product").distinct(), ["vendor", "product"], "left_semi")
    once = rows.groupBy("vendor", "product").agg(F.min("id").alias("id"), F.array_sort(F.collect_set(cpe.plain_segment(F.col("cpe"), 11))).alias("targets"))
    found = top_each(asked.join(once, ["vendor", "product"]), ["item"], pool, F.asc("id"))
    facts = candidate_statistics(catalogue, asked, ["vendor", "product"])
    return found.join(facts, ["vendor", "product"], "left").select("item", "id", "vendor", "product", "rn", "targets", "cataloged_row_count", "max_major")
