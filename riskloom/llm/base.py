"""What the operators of this subpackage share: the shared folder, stored tables and their scopes, key filters, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key filter: 8 MB, whatever the number of keys.
FILTER_BITS = 26
#: Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/riskloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files behind and send rows to Python in batches of at most BATCH_ROWS rows and
    (but for a single row) BATCH_BYTES bytes, since texts and blocks are long. The session's own values come back after them.

    What Python works on is therefore written inside: by ``stored``, by ``scoped`` operators, or by a writer of their own.
    """
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, ROWS, BYTES)}
    for k, v in ((CLEANUP, "true"), (ROWS, str(BATCH_ROWS)), (BYTES, str(BATCH_BYTES))):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str, *by: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` below ``path``, parted by the columns ``by``, and reads it back."""
    spark = df.sparkSession
    writer = df.write.option("compression", compression)
    with settings(spark):
        (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, *by: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut there and survives lost executors.

    The table goes with the operator that stored it (see ``scoped``); outside of one it stays.
    """
    path = new_path(df.sparkSession, name)
    if (mine := _scope.get()) is not None:
        mine.append(path)
    return written(df, path, *by, compression=compression)


def drop(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        place.getFileSystem(conf).delete(place, True)


def scoped(name: str, compression: str = "snappy", told: Callable[[str], None] = lambda path: None) -> Callable:
    """An operator whose result is stored; the tables that it stored on the way are deleted when it returns or fails. ``told`` hears
    where the result lies."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(*args, **options) -> DataFrame:
            mine: list[str] = []
            token = _scope.set(mine)
            spark = None
            try:
                out = operator(*args, **options)
                spark = out.sparkSession
                path = new_path(spark, name)
                kept = written(out, path, compression=compression)
            finally:
                _scope.reset(token)
                drop(spark or SparkSession.active(), mine)
            if (outer := _scope.get()) is not None:
                outer.append(path)
            told(path)
            return kept

        return run

    return wrap


class KeyFilter:
    """A test for rows that may have one of some keys: true for all that do, and for few others.

    The keys' hashes are set in a bitmap of 2**bits bits, whatever their number, which is built by a distributed
    aggregation and broadcast. So a large table can be thinned out where it lies; an exact join with the few rows left
    follows. With many more keys than bits the test lets everything through, and the join alone decides.
    """

    def __init__(self, keys: DataFrame, bits: int = FILTER_BITS):
        self.size = 1 << bits
        words = keys.select(self.place(*keys.columns).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
        table = np.zeros(self.size >> 6, np.uint64)
        table[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def place(self, *columns: Column | str) -> Column:
        """The bit of a key."""
        return F.pmod(F.xxhash64(*columns), F.lit(self.size))

    def test(self) -> Callable[[pa.Array], pa.Array]:
        """For tasks: which bits are set."""
        shared = self.shared

        def has(places: pa.Array) -> pa.Array:
            at = places.to_numpy(zero_copy_only=False).astype(np.uint64)
            return pa.array((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1)

        return has

    def __call__(self, *columns: Column | str) -> Column:
        test = self.test()

        @F.arrow_udf("boolean")
        def has(places: pa.Array) -> pa.Array:
            return test(places)

        return has(self.place(*columns))


def rested(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task whose worker serves other stages after it: memory that is free at its end goes back to the machine."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # the C library of Linux has it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column."""
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of an Arrow list column (nulls are empty lists)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    values = column.flatten()
    return np.concatenate(([0], np.cumsum(lengths))), np.asarray(values.to_numpy(zero_copy_only=False))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo ``by``; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % by


def running_base(parts: DataFrame, order: str, total: str, base: str) -> DataFrame:
    """Adds to each row the sum of ``total`` over the rows before it.

    ``parts`` must hold one row per written partition, so the single-task window stays small: its size is the
    number of partitions, never the number of documents.
    """
    from pyspark.sql import Window

    return parts.withColumn(base, F.sum(total).over(Window.orderBy(order)) - F.col(total))


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of rows with equal (integer) keys in a sorted partition, whatever the batches' borders."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b[k].to_numpy() for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for i, j in zip(at[:-1], at[1:], strict=True):
            key = tuple(int(c[i]) for c in columns)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)
