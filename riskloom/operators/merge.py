"""Merging of a new batch of rows into a stored table; every policy is one plan that gives the table's next version.

Keys are compared null-safely. A batch must hold one row for each key (see ``dedup.last_wins``); the stored table too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERWRITE, CHANGED, COALESCE, ABSENT = "overwrite", "changed", "coalesce", "absent"


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    return out


def merge(old: DataFrame, new: DataFrame, keys: list[str], policy: str, keep: list[str] | None = None, touched: list[str] | None = None) -> DataFrame:
    """The table ``old`` (same columns as ``new``) after the batch ``new``.

    - overwrite: new values replace old ones, nulls too;
    - changed: they do so only if a column besides ``touched`` (times of the last visit) differs, else the row stays whole;
    - coalesce: a new value replaces an old one only if it is not null;
    - absent: only rows with new keys are added.
    Columns in ``keep`` hold their first value that is not null, whatever the policy.
    """
    if policy == ABSENT:
        return old.unionByName(absent(old, new, keys))
    keep, touched = keep or [], touched or []
    both = old.withColumn("in_old", F.lit(True)).alias("old").join(new.withColumn("in_new", F.lit(True)).alias("new"), _same(keys), "full")
    came, was = F.col("in_new").isNotNull(), F.col("in_old").isNotNull()
    differs = F.lit(False)
    for c in old.columns:
        if c not in [*keys, *touched]:
            differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    replaces = came & (~was | differs) if policy == CHANGED else came

    def value(c: str) -> Column:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in keep:
            return F.coalesce(a, b)
        return F.coalesce(b, a) if policy == COALESCE else F.when(replaces, b).otherwise(a)

    return both.select(*(F.when(was, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) if c in keys else value(c).alias(c) for c in old.columns))


def absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not in ``old``."""
    return new.alias("new").join(old.select(*keys).alias("old"), _same(keys), "left_anti")


def with_existing(old: DataFrame, new: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Every row of ``new`` with the id that its key has after an insert of what is absent: the stored one if there is one."""
    stored = old.select(*keys, F.col(id_col).alias("stored_id"))
    rows = new.alias("new").join(stored.alias("old"), _same(keys), "left")
    return rows.select(*(F.coalesce("old.stored_id", f"new.{id_col}").alias(c) if c == id_col else F.col(f"new.{c}").alias(c) for c in new.columns), F.col("old.stored_id").isNull().alias("inserted"))


def update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the columns of ``changes`` where their key is there; changes of other keys do nothing."""
    rows = old.alias("old").join(changes.withColumn("in_new", F.lit(True)).alias("new"), _same(keys), "left")
    replaced = set(changes.columns) - set(keys)
    return rows.select(*(F.when(F.col("in_new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in replaced else F.col(f"old.{c}").alias(c) for c in old.columns))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children of the named parents give way to the new ones; a parent without new ones is left with none."""
    return old.join(parents.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(parents: DataFrame, gone: Column, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """The table without the rows for which ``gone`` is true, and each child (table, its key, the parent's key) without
    the rows of deleted parents."""
    doomed = parents.where(gone)
    kept = parents.where(~F.coalesce(gone, F.lit(False)))
    return [kept, *(child.join(doomed.select(F.col(pk).alias(fk)), fk, "left_anti") for child, fk, pk in children)]


def prune(old: DataFrame, seen: DataFrame, keys: list[str], failures: DataFrame, expected: int | None = None, least_share: float = 0.9) -> DataFrame:
    """The table without the rows that a full run did not see, but only if the run had no failure and saw at least
    ``least_share`` of what was ``expected`` (the stored rows if None); else the table as it is."""
    seen = seen.select(*keys).distinct()
    failed = failures.agg(F.count("*").alias("failed"))
    counted = seen.agg(F.count("*").alias("n_seen"))
    stored = old.agg(F.count("*").alias("n_old"))
    whole = F.lit(expected) if expected is not None else F.col("n_old")
    verdict = failed.join(counted).join(stored).select(((F.col("failed") == 0) & (F.col("n_seen") >= whole * least_share)).alias("complete"))
    marked = old.alias("old").join(seen.withColumn("in_new", F.lit(True)).alias("new"), _same(keys), "left")
    # The verdict is one row.
    return marked.join(F.broadcast(verdict)).where(F.col("in_new").isNotNull() | ~F.col("complete")).select(*(F.col(f"old.{c}").alias(c) for c in old.columns))


def violations(rows: DataFrame, unique: list[str], checks: dict[str, Column]) -> DataFrame:
    """(rule, n) of broken rules: repeated keys, and rows for which a check is false."""
    repeats = rows.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n")
    for name, check in checks.items():
        repeats = repeats.unionByName(rows.where(~check).agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n"))
    return repeats.where("n > 0")
