"""Connected components of a table of links, by alternating large and small stars.

Each round replaces the links of a node by links to the smallest node near it; the rounds end when the table no
longer changes, which takes about the logarithm of the longest path. A node with very many links is no bottleneck:
its smallest neighbour is found with partial sums, and the join back to its links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import scoped, stored


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


@scoped("components")
def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: long): the smallest node reachable.

    Nulls link nothing; repeated links and loops are harmless; there are no ties, since nodes are told apart by their
    numbers; an empty table gives an empty result.
    """
    lesser = lambda x, y: F.least(F.col(x), F.col(y)).alias("a")
    links = links.where(F.col("a") != F.col("b"))
    now = stored(links.select(lesser("a", "b"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    state = _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = stored(large, "links")
        # large holds (smaller a, larger b): b's smaller neighbours all join the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        before, now = state, stored(small.where(F.col("a") != F.col("b")).distinct(), "links")
        state = _state(now)
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots).distinct()
