"""Choosing one row of several. Choices are aggregates with partial sums, so a frequent key is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ascending order of the columns ``order`` (nulls first); ties must be told apart by them."""
    rest = [c for c in rows.columns if c not in keys]
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("first_row")).select(*keys, *(F.col(f"first_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with one key the one that came last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("last_row")).select(*keys, *(F.col(f"last_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def rank_in(value: Column, order: list[str]) -> Column:
    """The place of a value in a list; -1, so first of all, if it is not there."""
    return F.coalesce(F.array_position(F.lit(order), value), F.lit(0)).cast("int") - 1


#: The most cautious status first.
STATUSES = ["known_affected", "under_investigation", "fixed", "known_not_affected"]
#: Sources in the order in which they are asked; the first one to name a finding keeps it.
SOURCES = ["csaf", "cve_org", "ghsa", "nvd", "osv"]


def by_precedence(rows: DataFrame, keys: list[str], status: str, advisory: str, order: list[str] = STATUSES) -> DataFrame:
    """One row of each key: the most cautious status, then the lesser advisory; a status that is not listed comes first."""
    return best(rows, keys, rank_in(F.col(status), order), F.col(advisory))


def first_source(rows: DataFrame, keys: list[str], source: str, place: str, order: list[str] = SOURCES) -> DataFrame:
    """One row of each key: of the source asked first, then the one it named first."""
    return best(rows, keys, rank_in(F.col(source), order), F.col(place))


def folded(rows: DataFrame, identity: list[str], id_col: str, place: str) -> DataFrame:
    """All ids with the first id (by ``place``) whose row says the same; nulls say the same as empty texts."""
    same = [F.coalesce(F.col(c), F.lit("")).alias(f"same{i}") for i, c in enumerate(identity)]
    named = rows.select(F.col(id_col), F.col(place), *same)
    first = named.groupBy(*(f"same{i}" for i in range(len(identity)))).agg(F.min_by(id_col, place).alias("canonical"))
    return named.join(first, [f"same{i}" for i in range(len(identity))]).select(id_col, "canonical", (F.col(id_col) == F.col("canonical")).alias("is_canonical"))


def merged_entries(entries: DataFrame, keys: list[str], name: str, place: str, lists: list[str], sets: list[str]) -> DataFrame:
    """Entries of one key as one: its first name, the ``lists`` one after the other, the union of the ``sets``.

    Meant for the entries of one document (part of ``keys``), whose number is bounded by the document.
    """
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.coalesce(F.col(c), F.array()).alias("v")))), lambda x: x.v))
    return entries.groupBy(*keys).agg(F.min_by(name, place).alias(name), *(joined(c).alias(c) for c in lists), *(F.array_distinct(joined(c)).alias(c) for c in sets))


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one of two sets has."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))
