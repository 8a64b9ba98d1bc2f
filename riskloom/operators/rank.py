"""Ranking, caps, pages and cursor groups. Null order is always stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores of severities where a finding has none of its own.
SEVERITY_SCORES = {"CRITICAL": 9.0, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.0}
OTHER_SCORE = 5.0


def severity_score(severity: Column, scores: dict[str, float] = SEVERITY_SCORES, other: float = OTHER_SCORE) -> Column:
    out = F.lit(other)
    for name, value in scores.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def capped_view(findings: DataFrame, item: str, component: str, version: str, advisory: str, score: Column, tie: str, limit: int) -> DataFrame:
    """Adds score, total_count, rn and component_rank, and caps each item's findings.

    An item's own findings (null component) are capped by their rank, those of its components by the component's rank, and
    findings of an advisory always stay. Display order: item, own findings first, then components, each by rank.
    """
    own = F.col(component).isNull()
    group = Window.partitionBy(item, own)
    # The wider window first: its exchange by item serves the windows by item and kind, too.
    ranked = (
        findings.withColumn("score", score)
        .withColumn("component_rank", F.dense_rank().over(Window.partitionBy(item).orderBy(F.asc_nulls_last(component), F.asc_nulls_last(version))))
        .withColumn("total_count", F.count("*").over(group))
        .withColumn("rn", F.row_number().over(group.orderBy(F.desc_nulls_first("score"), F.asc_nulls_last(tie))))
    )
    kept = (own & (F.col("rn") <= limit)) | (~own & (F.col("component_rank") <= limit)) | F.col(advisory).isNotNull()
    return ranked.where(kept)


def display_order(item: str, component: str) -> list[Column]:
    return [F.col(item).asc(), F.asc_nulls_first(component), F.col("rn").asc()]


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of the table."""
    return rows.orderBy(*order).limit(n)


def top_each(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key with their rank ``rn``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 0), each row with the table's number of rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(number * size).limit(size).join(F.broadcast(total))


def tied_cap(rows: DataFrame, keys: list[str], cap: int, ts: str) -> DataFrame:
    """The ``cap`` earliest rows of each key, and all that share the last one's time."""
    return rows.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(ts)))).where(F.col("place") <= cap).drop("place")


def merged_lists(lists: list[DataFrame], keys: list[str], id_col: str, score: str, n: int) -> DataFrame:
    """Several ranked lists as one: each id with its best score, ranked anew and cut."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    once = rows.groupBy(*keys, id_col).agg(F.max(score).alias(score))
    return top_each(once, keys, n, F.desc(score), F.asc(id_col))
