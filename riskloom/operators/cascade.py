"""The fallback cascade of catalogue searches. Each stage is evaluated for the items that earlier stages left without candidates.

0. Similar names in the catalogue. 1. Exact pairs of vendor and product words. 2. A keyword search of a further table with the
item's words, one fewer at a time; what it brings in is searched like the catalogue. 3. Variants of the name, for items
whose words brought nothing. Candidates of each stage must explain the name, are ranked, and pass the gate of targets. An item with a
registry match ends after stage 0.

Items: item, name, vendor, version, declared (target that its address declares), ecosystem (of its registry match). Catalogue rows: id, vendor,
product, title, cpe. What a stage settled is kept, so the next one's input is a join with it and nothing is searched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import cpe, packages, text
from riskloom.operators import fuzzy, identify
from riskloom.operators.dedup import best
from riskloom.operators.rank import top_each
from riskloom.session import cut

# Queries of fewer words and of variants that are tried, rows of a keyword search, candidates that are kept.
ATTEMPTS, VARIANTS, KEYWORD_ROWS, KEPT = 3, 3, 20, 10


def fewer_words(items: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(item, attempt, query): the words of vendor and name, then one fewer at the end each time."""
    vendor = F.when(F.trim(F.coalesce("vendor", F.lit(""))) != "", F.concat("vendor", F.lit(" "))).otherwise("")
    words = F.split(F.trim(F.concat(vendor, "name")), r"\s+")
    rows = items.where(F.trim("name") != "").select("item", words.alias("words"))
    rows = rows.select("item", "words", F.explode(F.sequence(F.lit(0), F.least(F.size("words"), F.lit(attempts)) - 1)).alias("attempt"))
    return rows.select("item", "attempt", F.array_join(F.slice("words", F.lit(1), F.size("words") - F.col("attempt")), " ").alias("query"))


def keyword_rows(queries: DataFrame, rows: DataFrame, most: int = KEYWORD_ROWS) -> DataFrame:
    """(item, attempt, query, id): rows whose title has all words of the query, the first ``most``, for the first query of an item that
    finds any.

    A query meets the different titles by its rarest word alone; a query with a word that no title has meets none. Of each title the
    ``most`` least ids are all that a query can take.
    """
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    titled = rows.where(F.trim("title") != "").select("id", "title")
    titles = titled.select("title").distinct().select("title", words("title").alias("has"))
    listed = titles.select("title", "has", F.explode("has").alias("word"))
    frequency = listed.groupBy("word").agg(F.count("*").alias("f"))
    asked = queries.select("query").distinct().select("query", words("query").alias("wants")).withColumn("word", F.explode("wants")).join(frequency, "word")
    rarest = asked.groupBy("query", "wants").agg(F.min(F.struct("f", "word"))["word"].alias("word"), F.count("*").alias("known")).where(F.col("known") == F.size("wants"))
    met = rarest.join(listed, "word").where(F.size(F.array_except("wants", "has")) == 0).select("query", "title")
    met = top_each(met.join(top_each(titled, ["title"], most, F.asc("id")).drop("rn"), "title"), ["query"], most, F.asc("id"))
    met = queries.join(met.select("query", "id"), "query").select("item", "attempt", "query", "id")
    group = Window.partitionBy("item")
    return met.withColumn("first", F.min("attempt").over(group)).where("attempt = first").withColumn("rn", F.row_number().over(group.orderBy("id"))).where(F.col("rn") <= most).drop("first", "rn")


def name_variants(items: DataFrame, most: int = VARIANTS) -> DataFrame:
    """(item, place, kind, query): the first ``most`` of: parts of a Java coordinate, initials, the name without its vendor, and the name
    whose first word may be initials."""
    row = lambda kind, query: F.struct(F.lit(kind).alias("kind"), query.alias("query"))
    one = lambda kind, query: F.when(query.isNotNull(), F.array(row(kind, query))).otherwise(F.array().cast("array<struct<kind:string,query:string>>"))
    artifacts = F.transform(text.artifact_variants(F.col("name")), lambda v: row("artifact", v))
    queries = F.concat(artifacts, one("initials", text.acronym(F.col("name"))), one("bare", text.without_vendor(F.col("name"), F.col("vendor"))), one("expanded", F.col("name")))
    return items.select("item", F.posexplode(F.slice(queries, 1, most)).alias("place", "q")).select("item", "place", "q.kind", "q.query")


def _pool(found: DataFrame, items: DataFrame, catalogue: DataFrame, name: Column) -> DataFrame:
    """Found rows (item, id, targets, cataloged_row_count, max_major) with what rules on names look at."""
    about = items.select("item", name.alias("name"), F.col("vendor").alias("item_vendor"), F.col("version").alias("item_version"), "ecosystem", "declared")
    rows = catalogue.select("id", "vendor", "product", "title", cpe.part(F.col("cpe")).alias("part"))
    return found.join(about, "item").join(rows, "id")


def settled(pool: DataFrame, kept: int = KEPT) -> DataFrame:
    """(item, rn, id, relaxed): candidates in order of preference that pass the gate."""
    ranked = identify.ranked_candidates(pool, fuzzy.POOL).select("item", "id", "rn")
    has = F.col("ecosystem").isNotNull()
    declared = F.coalesce("declared", F.when(has, packages.target_software(F.col("ecosystem"))))
    open_gate = pool.where(identify.passes_target(F.col("targets"), declared, has)).select("item", "id", "relaxed").distinct()
    rows = ranked.join(open_gate, ["item", "id"])
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy("rn"))).where(F.col("rn") <= kept)


def _similar(queries: DataFrame, items: DataFrame, catalogue: DataFrame, explained_by: Column) -> DataFrame:
    found = fuzzy.two_column_search(queries, catalogue).drop("score", "rn")
    return identify.explained_candidates(_pool(found, items, catalogue, explained_by))


def _variants(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(item, rn, id, relaxed) by the first variant of each item's name that finds anything."""
    queries = cut(name_variants(items).withColumn("key", F.struct("item", "place")))
    of = queries.join(items, "item").withColumn("name", F.col("query")).drop("item").withColumnRenamed("key", "item")
    literal = _similar(of.where("kind in ('artifact', 'bare')"), of, catalogue, F.col("query"))
    short = fuzzy.two_column_search(of.where("kind = 'initials'"), catalogue).drop("score", "rn")
    short = _pool(short, of, catalogue, F.col("query")).where(F.lower("product") == F.lower("name")).withColumn("relaxed", F.lit(False))
    expanded = fuzzy.initialism_search(of.where("kind = 'expanded'"), catalogue)
    expanded = fuzzy.with_statistics(expanded.select("item", "id", "vendor", "product"), catalogue, targets=True)
    expanded = _pool(expanded, of, catalogue, F.col("name")).withColumn("relaxed", F.lit(False))
    pool = literal.unionByName(short.select(*literal.columns)).unionByName(expanded.select(*literal.columns))
    first = pool.withColumn("least", F.min("item.place").over(Window.partitionBy("item.item"))).where("item.place = least").drop("least")
    first = first.withColumn("item", F.col("item.item")).drop("name").join(items.select("item", "name"), "item")
    return settled(first)


def cascade(items: DataFrame, catalogue: DataFrame, further: DataFrame) -> DataFrame:
    """(item, stage, rn, id, relaxed): each item's candidates of the first stage that has any; items without candidates have no rows.

    Candidates of the last stage, and those of the relaxed rule, want a verdict before they are trusted (``relaxed``).
    """
    shaped = lambda rows, stage: rows.withColumn("stage", F.lit(stage)).select("item", "stage", "rn", "id", "relaxed")
    out = cut(shaped(settled(_similar(items, items, catalogue, F.col("name"))), 0))
    rest = items.where("ecosystem is null").join(out, "item", "left_anti")
    pairs = fuzzy.pair_search(rest, catalogue).select("item", "id", "targets", "cataloged_row_count", "max_major")
    exact = cut(shaped(settled(identify.explained_candidates(_pool(pairs, rest, catalogue, F.col("name")))), 1))
    out, rest = out.unionByName(exact), cut(rest.join(exact, "item", "left_anti"))
    if rest.isEmpty():
        return out
    met = cut(keyword_rows(fewer_words(rest), further))
    words = best(met, ["item"], F.col("id")).select("item", "query")
    lucky = cut(rest.join(words, "item"))
    if not lucky.isEmpty():
        wider = catalogue.unionByName(further.join(met.select("id").distinct(), "id", "left_semi").select(*catalogue.columns))
        again = cut(shaped(settled(_similar(lucky, lucky, wider, F.col("name"))), 2))
        still = cut(lucky.join(again, "item", "left_anti"))
        out = out.unionByName(again)
        if not still.isEmpty():  # whose name alone is not similar to what its words found
            out = out.unionByName(shaped(settled(_similar(still.withColumn("name", F.col("query")), still, wider, F.col("name"))), 2))
    unlucky = cut(rest.join(words, "item", "left_anti"))
    if not unlucky.isEmpty():
        out = out.unionByName(shaped(_variants(unlucky, catalogue).withColumn("relaxed", F.lit(True)), 3))
    return out
