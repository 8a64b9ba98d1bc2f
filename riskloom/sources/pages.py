"""Pages of a list that were fetched and landed as files, one JSON object each: records of a window of time, with the list's total
and the page's place in it. They are read as a table or as a stream; nothing is fetched here.

A file is named ``<anything>/<window>_<start>.json``; the object has ``totalResults``, ``startIndex`` and an array of records. Pages of a
window may be missing or damaged: their records are not there, and ``completeness`` says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, folder: str, stream: bool, at_once: int | None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream:
        reader = reader.schema("value string")
        if at_once:
            reader = reader.option("maxFilesPerTrigger", at_once)
    return reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)


def pages(spark: SparkSession, folder: str, records: str, stream: bool = False, at_once: int | None = None) -> DataFrame:
    """(window, start, total, records, error): a row for each page file; ``records`` names the object's array, whose entries come as
    texts. ``at_once`` bounds the files of a stream's batch."""
    rows = _files(spark, folder, stream, at_once).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_[0-9]+\.json$", 1).alias("window"), F.col("value"))
    body = F.from_json("value", f"totalResults long, startIndex long, `{records}` array<string>", {"mode": "PERMISSIVE"})
    rows = rows.withColumn("body", body)
    sound = F.col("body.totalResults").isNotNull() & F.col("body.startIndex").isNotNull() & F.col(f"body.`{records}`").isNotNull()
    return rows.select("window", F.col("body.startIndex").alias("start"), F.col("body.totalResults").alias("total"), F.when(sound, F.col(f"body.`{records}`")).alias("records"), F.when(~sound, "damaged page").alias("error"))


def page_records(rows: DataFrame) -> DataFrame:
    """(window, place, record): the records of sound pages; a page that was landed twice counts once."""
    once = rows.where("error is null").dropDuplicates(["window", "start"]) if not rows.isStreaming else rows.where("error is null")
    return once.select("window", "start", F.posexplode("records").alias("i", "record")).select("window", (F.col("start") + F.col("i")).alias("place"), "record")


def completeness(rows: DataFrame) -> DataFrame:
    """(window, expected, found, damaged, complete): what each window's pages hold of what they promise."""
    found = page_records(rows).select("window", "place").distinct().groupBy("window").agg(F.count("*").alias("found"))
    told = rows.groupBy("window").agg(F.max("total").alias("expected"), F.count("error").alias("damaged"))
    out = told.join(found, "window", "left").select("window", "expected", F.coalesce("found", F.lit(0)).alias("found"), "damaged")
    return out.withColumn("complete", F.coalesce((F.col("found") == F.col("expected")) & (F.col("damaged") == 0), F.lit(False)))
