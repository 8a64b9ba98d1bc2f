"""Trigram similarity: shared trigrams over all trigrams of two names, and joins by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all, as a 32-bit float; 0 for names without trigrams."""
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - shared
    return F.coalesce(F.try_divide(shared, total), F.lit(0.0)).cast("float")


def _rare_first(grams: DataFrame, frequency: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, n, g): the rarest trigrams of each name, as many as two names at the threshold must have one in common of."""
    known = grams.join(frequency, "g", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0).cast("long")).alias("f"), "g"))).alias("sorted"))
    n = F.size("sorted")
    prefix = n - F.ceil(n * threshold - 1e-4).cast("int") + 1
    return known.select(*keys, n.alias("n"), F.explode(F.slice("sorted", F.lit(1), F.least(n, F.greatest(prefix, F.lit(1))))).alias("x")).select(*keys, "n", F.col("x.g").alias("g"))


def similar_names(left: DataFrame, right: DataFrame, threshold: float, above: float | None = None) -> DataFrame:
    """(left_name, right_name, shared, total, score) of the distinct names of two tables (name) whose similarity, as a 32-bit float,
    reaches the threshold, and exceeds ``above`` as a 64-bit one where that is given.

    Names meet by their rarest trigrams only, and if their lengths allow the threshold; of those pairs the whole sets are compared.
    So a trigram that most names have brings few together. Nulls and names without letters or digits are similar to nothing.
    """
    one = left.select(F.col("name").alias("left_name")).distinct().select("left_name", trigrams(F.col("left_name")).alias("x")).where(F.size("x") > 0)
    two = right.select(F.col("name").alias("right_name")).distinct().select("right_name", trigrams(F.col("right_name")).alias("y")).where(F.size("y") > 0)
    right_grams = two.select("right_name", F.explode("y").alias("g"))
    frequency = right_grams.groupBy("g").agg(F.count("*").alias("f"))
    a = _rare_first(one.select("left_name", F.explode("x").alias("g")), frequency, ["left_name"], threshold).withColumnRenamed("n", "n_left")
    b = _rare_first(right_grams, frequency, ["right_name"], threshold).withColumnRenamed("n", "n_right")
    fits = (F.col("n_left") >= F.col("n_right") * threshold - 1e-4) & (F.col("n_right") >= F.col("n_left") * threshold - 1e-4)
    met = a.join(b, "g").where(fits).select("left_name", "right_name").distinct()
    met = met.join(one, "left_name").join(two, "right_name")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    met = met.select("left_name", "right_name", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total"))
    met = met.withColumn("score", (F.col("shared") / F.col("total")).cast("float")).where(F.col("score") >= F.lit(threshold).cast("float"))
    return met if above is None else met.where(F.col("score").cast("double") > F.lit(above).cast("double"))


def similar(left: DataFrame, right: DataFrame, threshold: float, above: float | None = None) -> DataFrame:
    """(left_id, right_id, right_name, shared, total, score) of the rows (id, name) with similar names: all ids of both sides, as many
    as there are. Searches that keep a few rows of each name take ``similar_names``."""
    met = similar_names(left, right, threshold, above)
    ids = lambda rows, side: rows.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    return met.join(ids(left, "left"), "left_name").join(ids(right, "right"), "right_name").select("left_id", "right_id", "right_name", "shared", "total", "score")
