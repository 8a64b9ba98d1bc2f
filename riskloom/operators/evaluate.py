"""Scoring of identifications against labelled items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import cpe
from riskloom.operators.dedup import last_wins

KEYS = ["product_name", "version"]


def matched(expected: DataFrame, actual: DataFrame, sequence: str) -> DataFrame:
    """Every expected row with the actual one of its name and version (the last of several), or nulls."""
    return expected.join(last_wins(actual, KEYS, sequence).drop(sequence).withColumn("found", F.lit(True)), KEYS, "left")


def identified() -> Column:
    return F.coalesce(F.col("status") == "IDENTIFIED", F.lit(False))


def correct() -> Column:
    """Whether the actual outcome is the expected one: ecosystem and name (whatever its case), or vendor and product (and
    the part where the label's source states it), or not identified."""
    stated = F.nullif(F.regexp_extract(F.coalesce("ground_truth_source", F.lit("")), r"\(part=([aoh])\b", 1), F.lit(""))
    segment = lambda n: F.try_element_at(F.split("cpe", ":"), F.lit(n))
    has_product = F.size(F.split("cpe", ":")) >= 5
    by_registry = identified() & (F.col("ecosystem") == F.col("expected_ecosystem")) & (F.lower("package_name") == F.lower("expected_package_name"))
    by_cpe = identified() & has_product & (segment(4) == F.col("expected_cpe_vendor")) & (segment(5) == F.col("expected_cpe_product")) & (stated.isNull() | (cpe.plain_part(F.col("cpe")) == stated))
    right = F.when(F.col("expected_outcome") == "IDENTIFIED_REGISTRY", by_registry).when(F.col("expected_outcome") == "IDENTIFIED_CPE", by_cpe).otherwise(F.col("status") == "UNIDENTIFIED")
    return F.coalesce(right, F.lit(False))


def metrics(rows: DataFrame, excluded: Column) -> DataFrame:
    """One row: recall over the rows to be identified, false positives among the controls, correctness and correctness at
    high confidence, both without the excluded rows (those without an actual row are scored all the same)."""
    scored = ~(excluded & F.col("found").isNotNull())
    control = F.col("expected_outcome") == "UNIDENTIFIED"
    share = lambda n, of: F.try_divide(F.col(n).cast("double"), F.col(of))
    high = correct() & (F.col("confidence").try_cast("double") >= 0.95)
    out = rows.agg(
        F.count_if(~control).alias("targets"), F.count_if(~control & identified()).alias("targets_identified"), F.count_if(control).alias("controls"), F.count_if(control & identified()).alias("controls_identified"),
        F.count_if(scored).alias("scored"), F.count_if(scored & correct()).alias("n_right"), F.count_if(scored & high).alias("n_right_high"),
    )
    return out.withColumns({"recall": share("targets_identified", "targets"), "control_rate": share("controls_identified", "controls"), "correctness": share("n_right", "scored"), "high_correctness": share("n_right_high", "scored")})


def by_outcome(rows: DataFrame, excluded: Column) -> DataFrame:
    return rows.where(~(excluded & F.col("found").isNotNull())).groupBy("expected_outcome").agg(F.count("*").alias("total"), F.count_if(correct()).alias("n_right"))


def without_ecosystem(rows: DataFrame, ecosystem: str) -> DataFrame:
    """What were left if a registry were not there: matches of it alone are unidentified, those a catalogue name backs stay."""
    lost = F.coalesce((F.col("ecosystem") == ecosystem) & (F.coalesce("cpe", F.lit("")) == ""), F.lit(False))
    return rows.withColumns({"status": F.when(lost, "UNIDENTIFIED").otherwise(F.col("status")), **{c: F.when(~lost, F.col(c)) for c in ("ecosystem", "package_name", "cpe", "confidence")}})


def stratified_sample(rows: DataFrame, stratum: str, order: Column, tie: str, total: int) -> DataFrame:
    """``total`` rows, from each stratum its share by largest remainders (equal ones to the lesser name), in the order of
    ``order``, a seeded hash for a random sample."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    # A stratum is a label: the windows over this small table hold one row for each.
    everything = Window.partitionBy()
    quotas = sizes.withColumn("share", F.col("n").cast("decimal(20,0)") * total / F.sum("n").over(everything)).withColumn("floor", F.floor("share"))
    spare = F.lit(total) - F.sum("floor").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc(F.col("share") - F.col("floor")), F.asc(stratum)))
    quotas = quotas.withColumn("quota", F.col("floor") + F.when(place <= spare, 1).otherwise(0)).select(stratum, "quota")
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order.asc(), F.asc(tie))))
    return ranked.join(F.broadcast(quotas), stratum).where(F.col("rn") <= F.col("quota")).drop("quota")


def truth(rows: DataFrame) -> DataFrame:
    """The labelled items of the catalogue with their truth alone."""
    return rows.where("expected_outcome = 'IDENTIFIED_CPE'").select("product_name", "version", "expected_cpe_vendor", "expected_cpe_product", "ground_truth_source")
