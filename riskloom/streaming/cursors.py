"""Incremental loads: cursors, groups of equal times, dead letters, windows of time, freshness. State is a small table that
a run reads and writes as a whole; changes come as a DataFrame with the result of each."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions import times

#: Failures in a row after which a cursor may pass a document.
DEAD_AFTER = 3


def due(changes: DataFrame, cursors: DataFrame, feed: str, ts: str, overlap: str = "INTERVAL 0 SECONDS") -> DataFrame:
    """Changes later than their feed's cursor less a safety overlap (all of them where it has none); what comes again is
    harmless, since merges are idempotent."""
    known = cursors.select(F.col(feed), F.col("cursor"))
    return changes.join(known, feed, "left").where(F.col("cursor").isNull() | (F.col(ts) > F.col("cursor") - F.expr(overlap))).drop("cursor")


def initial_cursors(headers: DataFrame, feed: str, modified: str, overlap: str = "INTERVAL 7 DAYS") -> DataFrame:
    """(feed, cursor): the least time that a feed's parts state, less the overlap."""
    return headers.groupBy(feed).agg((F.min(modified) - F.expr(overlap)).alias("cursor"))


def group_cursor(results: DataFrame, feed: str, ts: str, ok: Column, cap: int | None = None) -> DataFrame:
    """(feed, cursor, n_groups, n_rows): how far a run gets that works off groups of equal time in order and stops at the
    first with a failure; a group is begun only while fewer than ``cap`` rows are done.

    Groups are counted first, so the windows hold one row for each time.
    """
    groups = results.groupBy(feed, ts).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("good"), F.count("*").alias("n"))
    earlier = Window.partitionBy(feed).orderBy(ts)
    groups = groups.withColumn("all_good", F.min("good").over(earlier)).withColumn("before", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passed = F.col("all_good") if cap is None else F.col("all_good") & (F.col("before") < cap)
    return groups.groupBy(feed).agg(F.max(F.when(passed, F.col(ts))).alias("cursor"), F.count_if(passed).alias("n_groups"), F.coalesce(F.sum(F.when(passed, F.col("n"))), F.lit(0)).alias("n_rows"))


def frozen_cursor(results: DataFrame, feed: str, ts: str, ok: Column, dead: Column | None = None) -> DataFrame:
    """(feed, cursor, n_ok, n_failed): everything is tried, but the cursor stays before the first failure that is no dead
    letter; rows of one time stand or fall together."""
    good = F.coalesce(ok, F.lit(False))
    passes = good if dead is None else good | F.coalesce(dead, F.lit(False))
    first_bad = results.groupBy(feed).agg(F.min(F.when(~passes, F.col(ts))).alias("stop"))
    rows = results.join(first_bad, feed)
    return rows.groupBy(feed).agg(F.max(F.when(F.col("stop").isNull() | (F.col(ts) < F.col("stop")), F.col(ts))).alias("cursor"), F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"))


def dead_letters(failures: DataFrame, results: DataFrame, key: str, ok: Column, after: int = DEAD_AFTER) -> DataFrame:
    """The table (key, failures, dead) after a run: one more for what failed, nothing left of what succeeded."""
    run = results.groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("good"))
    both = failures.select(key, "failures").join(run, key, "full").where(~F.coalesce("good", F.lit(False)))
    n = (F.coalesce("failures", F.lit(0)) + F.when(F.col("good").isNotNull(), 1).otherwise(0)).cast("int")
    return both.select(key, n.alias("failures"), (n >= after).alias("dead"))


def letter_counts(letters: DataFrame, feed: str) -> DataFrame:
    """(feed, n_failing, n_dead): how many documents of each feed failed in their last run, and how many the cursor has passed."""
    return letters.groupBy(feed).agg(F.count_if(F.col("failures") > 0).alias("n_failing"), F.count_if(F.coalesce("dead", F.lit(False))).alias("n_dead"))


def advanced(cursors: DataFrame, run: DataFrame, feed: str) -> DataFrame:
    """The cursor table after a run; a run that passed nothing, and feeds without one, leave their cursor as it is."""
    return cursors.select(feed, F.col("cursor").alias("old")).join(run.select(feed, "cursor"), feed, "full").select(feed, F.greatest("old", "cursor").alias("cursor"))


def pair_text(changes: Column, deletions: Column) -> Column:
    """Two cursors in one text; an unknown one is empty."""
    return F.concat_ws("|", F.coalesce(changes.cast("string"), F.lit("")), F.coalesce(deletions.cast("string"), F.lit("")))


def pair_of(state: Column) -> Column:
    at = lambda i: F.nullif(F.split_part(state, F.lit("|"), F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("changes"), at(2).alias("deletions"))


def windows(bounds: DataFrame, days: int = 120) -> DataFrame:
    """(start, end) windows of ``days`` days that cover each (start, end) without gaps; the last may be shorter."""
    starts = bounds.select("end", F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {days} DAYS"))).alias("start")).where("start < end")
    return starts.select("start", F.least(F.col("start") + F.expr(f"INTERVAL {days} DAYS"), F.col("end")).alias("end"))


def split(counted: DataFrame, most: int = 20_000, least: str = "INTERVAL 1 DAY") -> DataFrame:
    """(start, end, settled) from windows with their number of results ``n``: those with more than ``most`` become two
    halves unless they are short already."""
    large = (F.col("n") > most) & (F.col("end") > F.col("start") + F.expr(least))
    return counted.select(F.explode(F.when(large, _halves(F.col("start"), F.col("end"))).otherwise(F.array(F.struct("start", "end")))).alias("w"), (~large).alias("settled")).select("w.start", "w.end", "settled")


def _halves(start: Column, end: Column) -> Column:
    middle = times.midpoint(start, end)
    return F.array(F.struct(start.alias("start"), middle.alias("end")), F.struct(middle.alias("start"), end.alias("end")))


def window_tree(tops: DataFrame, least: str = "INTERVAL 1 DAY") -> DataFrame:
    """(tree, level, path, start, end, leaf): each window of ``tops`` and its halves, quarters and so on, down to the first that are no
    longer than ``least``. A node's path is its place on its level; trees are known by their start.

    The levels follow from the longest window, so the tree is made without looking at any data.
    """
    spare = F.col("end") > F.col("start") + F.expr(least)
    level = tops.select(F.col("start").alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("path"), "start", "end")
    longest = tops.agg(F.max(F.unix_micros("end") - F.unix_micros("start")).alias("n"), F.max(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(least))).alias("least")).first()
    depth = max(0, math.ceil(math.log2(longest["n"] / longest["least"]))) if longest["n"] else 0
    out = level
    for n in range(1, depth + 1):
        halves = level.where(spare).select("tree", "path", F.posexplode(_halves(F.col("start"), F.col("end"))).alias("half", "w"))
        level = halves.select("tree", F.lit(n).alias("level"), (F.col("path") * 2 + F.col("half")).alias("path"), "w.start", "w.end")
        out = out.unionByName(level)
    return out.withColumn("leaf", ~spare)


def settled_windows(bounds: DataFrame, events: DataFrame, ts: str, most: int, days: int = 120, least: str = "INTERVAL 1 DAY") -> DataFrame:
    """Windows (start, end, n) over the events such that none holds more than ``most`` unless it is short: the windows that halving
    each one that holds too many would end with.

    Events are counted once, by the finest windows; sums over these are the counts of all wider ones. A window stays if it is
    settled and the one that it is half of is not. Events meet the finest windows by equality on a step of time, so none
    meets them all.
    """
    tree = window_tree(windows(bounds, days), least)
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(least))
    step = lambda c: F.floor(F.unix_micros(c) / width).cast("long")
    moments = events.groupBy(F.col(ts).cast("timestamp").alias("ts")).agg(F.count("*").alias("m")).withColumn("step", step(F.col("ts")))
    leaves = tree.where("leaf").withColumn("step", F.explode(F.sequence(step(F.col("start")), step(F.col("end")))))
    held = leaves.join(moments, "step").where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    counts = held.groupBy("tree", "level", "path").agg(F.sum("m").alias("m"))
    above = counts.select("tree", "path", F.col("level").alias("own"), "m", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    sums = above.groupBy("tree", "level", F.call_function("shiftright", F.col("path"), F.col("own") - F.col("level")).alias("path")).agg(F.sum("m").alias("n"))
    known = tree.join(sums, ["tree", "level", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = known.withColumn("settled", (F.col("n") <= most) | F.col("leaf"))
    open_ones = known.where("not settled").select("tree", (F.col("level") + 1).alias("level"), F.col("path").alias("parent"))
    top = known.where("settled and level = 0").select("start", "end", "n")
    below = known.where("settled and level > 0").withColumn("parent", F.shiftright("path", 1)).join(open_ones, ["tree", "level", "parent"])
    return top.unionByName(below.select("start", "end", "n"))


def freshness(states: DataFrame, now: Column) -> DataFrame:
    """(mirror, warning) of mirrors (mirror, baseline_loaded, last_error, last_synced_at, stale_after_days) that cannot be
    relied on: no baseline, the last run failed, or too old; none for the others."""
    warning = (
        F.when(~F.coalesce("baseline_loaded", F.lit(False)), "baseline_missing")
        .when(F.col("last_error").isNotNull(), "last_run_failed")
        .when(F.col("last_synced_at").isNull(), "never_synced")
        .when(times.is_stale(F.col("last_synced_at"), now, F.col("stale_after_days")), "stale")
    )
    return states.select("mirror", warning.alias("warning")).where("warning is not null")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


def run_over(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off what a stream has, batch by batch, and ends; a batch that is repeated after a failure comes under its old
    number, so ``apply`` must be idempotent for a number."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Spent(Exception):
    """The run's budget is used up."""


def run_within(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, batches: int, seconds: float | None = None) -> bool:
    """Works off at most so many batches, and begins none after so many seconds; True if nothing is left.

    How much a batch holds is limited by the stream's source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). What is not begun stays
    behind the stream's offset and is the next run's first batch, so several runs do what one without limits does.
    """
    began, done = time.monotonic(), 0

    def limited(batch: DataFrame, number: int) -> None:
        nonlocal done
        if done >= batches or (seconds is not None and time.monotonic() - began > seconds):
            raise _Spent("budget used up")
        apply(batch, number)
        done += 1

    query = stream.writeStream.foreachBatch(limited).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "budget used up" not in str(e):
            raise
        return False
    return True


LETTERS = "feed string, document string, ts timestamp, failures int, dead boolean"


def letters_stream(results: DataFrame, after: int = DEAD_AFTER) -> DataFrame:
    """LETTERS rows, one for each document of a batch, from a stream of results (feed, document, ts, ok): how often it failed in a
    row, over all batches.

    The count is the state of the document's key in the stream's state store, so it survives restarts; a success sets it
    back and drops the state. Results of one batch count in the order of their times.
    """

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (failures,) = state.get if state.exists else (0,)
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for ok in rows["ok"].fillna(False).astype(bool):
            failures = 0 if ok else failures + 1
        if failures:
            state.update((failures,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"feed": [key[0]], "document": [key[1]], "ts": [rows["ts"].iloc[-1]], "failures": [failures], "dead": [failures >= after]})

    return results.select("feed", "document", "ts", "ok").groupBy("feed", "document").applyInPandasWithState(count, LETTERS, "failures int", "update", GroupStateTimeout.NoTimeout)
