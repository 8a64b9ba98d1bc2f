"""What the two operators on vectors share: usable vectors, classes of equal vectors, bounded merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>): without vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def least_ids(rows: DataFrame, n: int) -> DataFrame:
    """(vector, ids, copies): classes of equal vectors, each with its ``n`` least ids in order and its number of rows.

    Each task sends at most ``n`` ids of a class, so a class with very many rows meets nowhere as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, list[int]] = {}
            ids, lists = b["vec_id"].to_pylist(), b["vector"]
            raws = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) + 0.0 for x in lists]
            for i, raw in zip(ids, raws, strict=True):
                found.setdefault(raw.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(k, np.float64) for k in found], pa.list_(pa.float64())), pa.array([sorted(x)[:n] for x in found.values()], pa.list_(pa.int64())), pa.array([len(x) for x in found.values()], pa.int64())],
                ["vector", "ids", "copies"],
            )

    some = rows.mapInArrow(run, "vector array<double>, ids array<long>, copies long")
    return some.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, n).alias("ids"), F.sum("copies").alias("copies"))
