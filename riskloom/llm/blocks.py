"""Documents in blocks, and the exchange of hashed keys between blocks.

A block is one row that holds many documents: their words as positions in the block's own vocabulary. Blocks are
written to the shared folder, so a later step finds the same block again. A step that needs a corpus-wide fact
about a hashed key (how often does this pair of words occur?) sends the distinct keys of each block, in order and
cut by ranges of the hash, to the task of the range; the task answers each block with an array in the same order.
So a key that is frequent in the corpus is sent once for each block, and the answer needs no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: A block is closed when it holds so many words.
BLOCK_WORDS = 400_000
SLICE = 512
CHUNK = "part int, block long, keys binary, data binary"


class WordIds(dict):
    """word -> its position in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Block:
    """A block as a task sees it: documents' lengths in words, word ids, vocabulary."""

    def __init__(self, row: dict):
        self.id: int = row["block"]
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ids = expand(row["ids"], np.int32)
        words = zstandard.decompress(row["vocab"])
        self.vocab: list[bytes] = words.split(b" ") if words else []
        self.row = row

    def hashes(self, seed: int = 0) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab), np.uint64, len(self.vocab))


def blocks(docs: DataFrame, lower: bool, also: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """Stores documents (doc_id, text, ``also``) as blocks; ``also`` columns become arrays, one entry a document."""
    kept = ["doc_id", *also]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids = TaskContext.get().partitionId() << 33, WordIds()
        words: list[np.ndarray] = []
        lengths: list[int] = []
        columns: list[list] = [[] for _ in kept]
        total = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate([*words, np.empty(0, np.int32)]).astype(np.int32)
            arrays = [pa.array([block]), *(pa.array([c], pa.list_(kinds[i])) for i, c in enumerate(columns))]
            arrays += [pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()), pa.array([squeeze(flat)], pa.binary()), pa.array([zstandard.compress(b" ".join(ids), 1)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["block", "doc_ids", *also, "lengths", "ids", "vocab"])

        kinds: list[pa.DataType] = []
        for whole in batches:
            kinds = [whole.schema.field(c).type for c in kept]
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                for i, c in enumerate(kept):
                    columns[i] += b[c].to_pylist()
                for text in base.text_bytes(b["text"]):
                    split = (text.lower() if lower else text).split()
                    words.append(np.fromiter(map(ids.__getitem__, split), np.int32, len(split)))
                    lengths.append(len(split))
                    total += len(split)
                if total >= block_words:
                    yield close()
                    block, ids, total = block + 1, WordIds(), 0
                    words, lengths, columns = [], [], [[] for _ in kept]
        if lengths:
            yield close()

    types = dict(docs.dtypes)
    arrays = ", ".join([f"doc_ids array<{types['doc_id']}>", *(f"{c} array<{types[c]}>" for c in also)])
    return base.stored(docs.select(*kept, "text").mapInArrow(base.rested(gather), f"block long, {arrays}, lengths binary, ids binary, vocab binary"), "blocks")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a block's arrays are large."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of the fewest whole bytes that hold them."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if len(raw) < 9:
        return np.empty(0, np.uint64)
    width = raw[0]
    n = (len(raw) - 9) // width
    out = np.zeros((n + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    out[1:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(n, width)
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed values, their first bytes first: small numbers then are long runs of zeros."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1) if len(values) else b""


def expand(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.empty(0, kind)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def cut(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending keys are cut into ``parts`` ranges of the hash: parts + 1 positions."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


def chunks(block: int, keys: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of CHUNK for one block's ascending distinct keys; the columns' parts lie one after the other in data."""
    at = cut(keys, parts)
    for p in range(parts):
        i, j = at[p], at[p + 1]
        if i < j:
            yield p, block, pack(keys[i:j]), b"".join(len(z := squeeze(c[i:j])).to_bytes(4, "little") + z for c in columns)


def columns_of(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(expand(data[at + 4 : at + 4 + n], kind))
        at += 4 + n
    return out


def parts_of(df: DataFrame) -> int:
    """Ranges of the hash: several for each shuffle partition, so that these fill evenly."""
    return 6 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def answers(asked: DataFrame, kinds: list[type], reply: Callable[..., tuple[np.ndarray, ...]], fields: str = "", by: tuple[str, ...] = ("part",)) -> DataFrame:
    """For each range of keys, what ``reply`` makes of all blocks' keys.

    ``reply(keys, inverse, columns)`` gets the distinct keys, each sent key's position among them and the
    sent columns; it returns the array of answers for the sent keys and a tuple for the range's own row, whose fields
    are named by ``fields``. Result: (``by``, block, data, ``fields``): a row for each block, and one with a null
    block for the range itself.
    """
    names = [f.split()[0] for f in fields.split(",") if f.strip()]
    shape = ", ".join([*(f"{k} {dict(asked.dtypes)[k]}" for k in by), "block long", "data binary", *([fields] if fields else [])])
    arrow = arrow_schema(shape)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sent = [unpack(x) for x in table["keys"].to_pylist()]
        data = [columns_of(x, kinds) for x in table["data"].to_pylist()]
        lengths = [len(x) for x in sent]
        flat = np.concatenate(sent)
        columns = [np.concatenate([d[i] for d in data]) for i in range(len(kinds))]
        keys, inverse = np.unique(flat, return_inverse=True)
        values = tuple(k.as_py() for k in key)
        told, own = reply(keys, inverse, columns)
        ends = np.cumsum(lengths)
        rows = [(*values, b, squeeze(told[e - n : e]), *(None for _ in names)) for b, n, e in zip(table["block"].to_pylist(), lengths, ends, strict=True)]
        rows.append((*values, None, None, *own))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return asked.groupBy(*by).applyInArrow(run, shape)


def with_replies(stored_blocks: DataFrame, replies: DataFrame, name: str, by: tuple[str, ...] = ("part",)) -> DataFrame:
    """Adds the answers to each block as an array of binaries in the order of ``by``, empty where nothing was asked."""
    own = replies.where("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*by, "data"))).alias(name))
    return stored_blocks.join(own, "block", "left").withColumn(name, F.coalesce(F.col(f"{name}.data"), F.array().cast("array<binary>")))


def joined(raws: list[bytes] | None, kind: type) -> np.ndarray:
    return np.concatenate([*(expand(x, kind) for x in raws or []), np.empty(0, kind)])
