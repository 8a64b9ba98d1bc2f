"""Statistics of catalogue partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import cpe

#: A major version from here on is wide (a year or a serial number).
WIDE = 1000


def guarded_majors(rows: DataFrame, keys: list[str], major: str) -> DataFrame:
    """(keys, cataloged_row_count, max_major): the greatest major version of each partition, guarded against outliers.

    Few wide values (under a tenth) give way to the narrow ones; a maximum more than four times the 99th percentile gives
    way to it where there are twenty rows, three values and a percentile of four at least. Rows are first counted by
    value, so that a partition with very many rows is never held as a whole.
    """
    counted = rows.groupBy(*keys, F.col(major).alias("major")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    n, narrow = F.when(F.col("major").isNotNull(), F.col("n")), F.col("major") < WIDE
    # Null comes first and narrow values before wide ones, so one running sum serves both.
    known = counted.withColumns({"narrow": narrow, "below": F.sum(n).over(group.orderBy(F.asc_nulls_first("major")).rowsBetween(Window.unboundedPreceding, 0)), "rows": F.sum(n).over(group), "rows_narrow": F.sum(F.when(narrow, F.col("n"))).over(group)})
    # The least value whose share from below reaches 0.99.
    reached = lambda rows: F.col("below") >= F.ceil(F.col(rows) * F.lit(0.99).cast("decimal(3,2)"))
    facts = known.groupBy(*keys).agg(
        F.sum("n").alias("cataloged_row_count"), F.max("rows").alias("rows"), F.max("rows_narrow").alias("rows_narrow"), F.count("major").alias("distinct"), F.count_if("narrow").alias("distinct_narrow"),
        F.max("major").alias("max"), F.max(F.when(F.col("narrow"), F.col("major"))).alias("max_narrow"),
        F.min(F.when(reached("rows"), F.col("major"))).alias("p99"), F.min(F.when(F.col("narrow") & reached("rows_narrow"), F.col("major"))).alias("p99_narrow"),
    )
    wide = F.col("rows") - F.coalesce("rows_narrow", F.lit(0))
    use_narrow = (wide > 0) & (wide * 10 < F.col("rows")) & (F.coalesce("rows_narrow", F.lit(0)) > 0)
    chosen = facts.select(*keys, "cataloged_row_count", *(F.when(use_narrow, F.col(f"{c}_narrow")).otherwise(F.col(c)).cast("long").alias(c) for c in ("rows", "distinct", "max", "p99")))
    guarded = (F.col("rows") >= 20) & (F.col("distinct") >= 3) & (F.col("p99") >= 4) & (F.col("max") > 4 * F.col("p99"))
    return chosen.select(*keys, "cataloged_row_count", F.when(guarded, F.col("p99")).otherwise(F.col("max")).alias("max_major"))


def candidate_statistics(catalogue: DataFrame, candidates: DataFrame, keys: list[str], name: str = "cpe") -> DataFrame:
    """(keys, cataloged_row_count, max_major) of the partitions that candidates name, from all their rows in the catalogue.

    The catalogue is thinned out by the candidates' keys before anything is counted, so the statistics cost no more than the
    partitions asked for.
    """
    asked = candidates.select(*keys).distinct()
    rows = catalogue.select(*keys, cpe.catalogue_major(F.col(name)).alias("major")).join(asked, keys, "left_semi")
    return guarded_majors(rows, keys, "major")
