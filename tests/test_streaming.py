"""Streams that keep a table up to date, and windows that settle."""

from pyspark.sql import functions as F

from riskloom.streaming import cursors, snapshots


def test_merge_stream(spark, tmp_path):
    schema = "k int, v string, seq int"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0, [(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    run = lambda: snapshots.merge_stream(stream(), str(tmp_path / "table"), str(tmp_path / "mark"), ["k"], "seq", "coalesce")
    run()
    put(1, [(2, None, 5), (3, "d", 1)])
    put(2, [(3, "e", 2)])
    run()
    run()  # nothing new: the table stays
    shape = snapshots.current(spark, str(tmp_path / "table"), spark.createDataFrame([], "k int, v string").schema)
    assert sorted(tuple(r) for r in shape.collect()) == [(1, "b"), (2, "c"), (3, "e")]
    assert snapshots.versions(spark, str(tmp_path / "table")) == [1, 2, 3]
    assert snapshots.current(spark, str(tmp_path / "none"), shape.schema).count() == 0


def test_windows_settle(spark):
    events = spark.range(400).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60 * (1 + F.col("id") % 3)).alias("ts"))
    bounds = spark.sql("select timestamp'2024-01-01 00:00:00' as start, timestamp'2024-02-10 00:00:00' as end")
    got = cursors.settled_windows(bounds, events, "ts", 100, 10, "INTERVAL 2 HOURS").orderBy("start").collect()
    assert sum(r["n"] for r in got) == 400
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:]))
    assert all(r["n"] <= 100 or (r["end"] - r["start"]).total_seconds() <= 7200 * 2 for r in got) and len(got) > 4


def test_cursor_tables(spark):
    cursor = spark.createDataFrame([("a", 5), ("b", None)], "feed string, cursor int")
    run = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "feed string, cursor int")
    assert sorted(tuple(r) for r in cursors.advanced(cursor, run, "feed").collect()) == [("a", 5), ("b", 2), ("c", 1)]
    pair = spark.range(1).select(cursors.pair_text(F.lit("x"), F.lit(None).cast("string")).alias("p"))
    assert tuple(pair.select(cursors.pair_of(F.col("p")).alias("q")).first()["q"]) == ("x", None)
    assert cursors.pending(cursor, run, "feed").count() == 0
    heads = spark.sql("select 'o' as feed, timestamp'2024-01-09 00:00:00' as m union all select 'o', timestamp'2024-01-08 00:00:00'")
    assert cursors.initial_cursors(heads, "feed", "m").first()["cursor"].day == 1
