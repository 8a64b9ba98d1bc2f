"""A keyed table kept up to date by a stream: versions of it in numbered folders, the last one is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from riskloom.operators.dedup import last_wins
from riskloom.operators.merge import merge
from riskloom.streaming.cursors import run_over


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, in order: those whose folder holds the mark of a finished write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[1:]) for n in done if n[:1] == "v")


def current(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    known = versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/v{known[-1]}") if known else spark.createDataFrame([], schema)


def merge_stream(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], sequence: str, policy: str = "overwrite") -> None:
    """Merges what the stream has into the table: of a batch's rows with one key the last by ``sequence`` counts. Batch n
    makes version n + 1 from version n, so a repeated batch writes the same version again."""
    schema = stream.drop(sequence).schema

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = [v for v in versions(spark, folder) if v <= number]
        old = spark.read.schema(schema).parquet(f"{folder}/v{known[-1]}") if known else spark.createDataFrame([], schema)
        merge(old, last_wins(batch, keys, sequence).drop(sequence), keys, policy).write.mode("overwrite").parquet(f"{folder}/v{number + 1}")

    run_over(stream, apply, checkpoint)
