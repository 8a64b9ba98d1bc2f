"""Token ids as Parquet list columns (operator 2).

A written folder holds one row per document in ascending order of its id: ``doc_id``, ``shard`` (the writing
partition), ``start`` (ids of the shard before it), ``n_tokens`` and ``ids`` (list of 32-bit integers). Id pages
are dictionary encoded, and delta encoded where the dictionary grows too large; row groups and rows per page are
set, and page indexes are written, so that a reader of a few documents or of the metadata alone fetches only the
pages it needs.

Nulls and ties: a null text is an empty one (only the end id); a null id sorts first; rows with equal ids are
ordered by a hash of their text, and equal rows are written as often as they occur. An empty table gives an empty
folder with its schema. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .vocabulary import encoder

SCHEMA = "doc_id long, shard int, start long, n_tokens long, ids array<int>"
#: How many documents are encoded at once.
BATCH = 512


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool) -> DataFrame:
    """Documents (doc_id, text) to rows of SCHEMA, in the order of the input's partitions."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, shard, start = encoder(tokenizer, drops_space), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids, lengths = work.ids(batch["text"], end_id)
                starts = start + np.concatenate(([0], np.cumsum(lengths)[:-1]))
                start += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(np.full(len(lengths), shard, np.int32)), pa.array(starts), pa.array(lengths), base.list_array(ids, lengths, pa.int32())], ["doc_id", "shard", "start", "n_tokens", "ids"])

    return docs.mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, drops_space: bool = True, row_group_bytes: int = 32 << 20, page_rows: int = 128, page_bytes: int = 256 << 10) -> None:
    """Encodes whole texts and writes them in ascending order of ``doc_id`` below ``path``."""
    ordered = base.texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    rows = encode_documents(ordered, tokenizer, end_id, drops_space)
    options = {
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "compression": "zstd",
    }
    with base.settings(docs.sparkSession):
        rows.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, ids_from: int | None = None, ids_to: int | None = None) -> DataFrame:
    """Rows of a written folder; only the named columns and the row groups and pages of the range of ids are read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if ids_from is not None:
        df = df.where(F.col("doc_id") >= ids_from)
    if ids_to is not None:
        df = df.where(F.col("doc_id") <= ids_to)
    return df.select(*columns) if columns else df


def with_starts(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Replaces the start within the shard by the start within all documents.

    ``metadata`` has the columns shard and n_tokens of all rows. The broadcast table has one row per written shard.
    """
    bases = base.running_base(metadata.groupBy("shard").agg(F.sum("n_tokens").alias("total")), "shard", "total", "base")
    return rows.join(F.broadcast(bases.select("shard", "base")), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


def with_crc(rows: DataFrame) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids_crc32) from rows with ids."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, values = base.list_parts(b["ids"])
            raw = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["shard"], b["start"], pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "shard", "start", "ids").mapInArrow(check, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")
