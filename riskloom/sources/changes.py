"""Lists of changed documents, without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text, times

PATH = r"^[0-9]{4}/[a-z0-9_.\-]+\.json$"


def modified_ids(spark: SparkSession, path: str, directories: list[str], cursor: str | None = None) -> DataFrame:
    """(ts, directory, id) of lines ``timestamp,directory/id`` with a sound time and id, in one of the directories, later
    than the cursor; the latest of an id's lines."""
    rows = spark.read.csv(path, schema="stamp string, place string")
    rows = rows.select(times.strict(F.col("stamp")).alias("ts"), F.split_part("place", F.lit("/"), F.lit(1)).alias("directory"), F.regexp_extract("place", "^[^/]*/(.+)$", 1).alias("id"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("directory").isin(*directories) & F.col("id").rlike(text.OSV_ID))
    if cursor is not None:
        rows = rows.where(F.col("ts") > times.lenient(F.lit(cursor)))
    return rows.groupBy("id").agg(F.max_by(F.struct("ts", "directory"), "ts").alias("m")).select("m.ts", "m.directory", "id")


def changed_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path, ts, tracking_id) of lines ``path,timestamp``; lines of another shape are left out."""
    rows = spark.read.csv(path, schema="path string, stamp string").select("path", times.lenient(F.col("stamp")).alias("ts"))
    return rows.where(F.col("path").rlike(PATH) & F.col("ts").isNotNull()).withColumn("tracking_id", text.tracking_id(F.col("path")))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, updated) of an advisory feed in JSON."""
    shape = "feed struct<entry:array<struct<id:string,content:struct<src:string>,updated:string>>>"
    rows = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("feed.entry").alias("e"))
    return rows.select("e.id", F.col("e.content.src").alias("url"), times.lenient(F.col("e.updated")).alias("updated"))
