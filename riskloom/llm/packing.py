"""Packing of documents into training sequences by cutting-stock column generation (operator 4).

Documents are encoded with an end id. A document's whole blocks of ``size`` ids are sequences of their own; what
remains of it is an item for the cutting-stock plan (module ``cutting``) over the histogram of item lengths in
units of ``unit`` ids. The plan's size is bounded by the sequence length, so it is made on the driver; items of
each length class are ranked by document over all partitions, and a plan maps ranks to places. Items that the plan
leaves over (a bounded number) are laid end to end and cut at the sequence's end.

Nulls and ties: a null text is an empty one and gives a piece that holds only the end id; a null id sorts first;
equal rows are packed as often as they occur, in the order of their storage. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, cutting
from .vocabulary import KEPT, encoder

BATCH = 512


def encoded(docs: DataFrame, tokenizer: str, end_id: int, drops_space: bool, size: int, kept: int = KEPT) -> DataFrame:
    """(row, doc_id, n, ids, crcs): ids with the end id, and the crc32 of each block and of what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, row = encoder(tokenizer, drops_space, kept), TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                ids, n = work.ids(b["text"], end_id)
                raw, ends = memoryview(ids).cast("B"), np.cumsum(n).tolist()
                crcs = [[zlib.crc32(raw[4 * i : 4 * min(i + size, j)]) for i in range(j - k, j, size)] for j, k in zip(ends, n.tolist(), strict=True)]
                rows = np.arange(row, row + len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(rows), b["doc_id"].cast(pa.int64()), pa.array(n), base.list_array(ids, n, pa.int32()), pa.array(crcs, pa.list_(pa.int64()))], ["row", "doc_id", "n", "ids", "crcs"])

    return docs.mapInArrow(base.rested(run), "row long, doc_id long, n long, ids array<int>, crcs array<long>")


def ranked(items: DataFrame) -> DataFrame:
    """Adds the shard, the place within shard and length class, and the shard's blocks before the document.

    Rows are dealt out by ranges of (class, doc_id, row), so a frequent length is split over partitions.
    """
    dealt = items.repartitionByRange("kind", "doc_id", "row").sortWithinPartitions("kind", "doc_id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, done = TaskContext.get().partitionId(), {}, 0
        for b in batches:
            kinds = b["kind"].to_numpy()
            place = np.empty(len(kinds), np.int64)
            for kind in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == kind)
                place[at] = seen.get(kind, 0) + np.arange(len(at))
                seen[kind] = seen.get(kind, 0) + len(at)
            blocks = b["blocks"].to_numpy()
            before = done + np.cumsum(blocks) - blocks
            done += int(blocks.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(kinds), shard, np.int32)), pa.array(place), pa.array(before)], [*b.schema.names, "shard", "place", "before"])

    from pyspark.sql.types import IntegerType, LongType, StructType

    kind = StructType(list(dealt.schema.fields)).add("shard", IntegerType()).add("place", LongType()).add("before", LongType())
    return dealt.mapInArrow(base.rested(run), kind)


def item_places(plan: cutting.Plan, kinds: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, slot) of the items of given length classes and ranks; sequence -1: left for cutting."""
    sequence, slot = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), np.int64)
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        rank = ranks[at]
        rows = np.array(plan.segments.get(kind, []), np.int64).reshape(-1, 5)
        placed = int((rows[:, 1] * rows[:, 2]).sum())
        inside = rank < placed
        if inside.any():
            first, per, _, start, offset = rows[np.searchsorted(rows[:, 0], rank[inside], "right") - 1].T
            r = rank[inside] - first
            sequence[at[inside]] = start + r // per
            slot[at[inside]] = offset + r % per
        rest = plan.rest.get(kind, [])
        for i in at[~inside]:
            where = rest[int(ranks[i]) - placed]
            if where is not None:
                sequence[i], slot[i] = where
    return sequence, slot


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, drops_space: bool = False, size: int = 1024, unit: int = 8, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """(pieces, tokens): pieces (row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and the stored
    token table (row, doc_id, n, ids, crcs) that the pieces refer to. A worker remembers the ids of ``kept`` stretches."""
    tokens = base.stored(encoded(base.texts(docs), tokenizer, end_id, drops_space, size, kept), "tokens")
    blocks, tail = F.floor(F.col("n") / size), F.col("n") % size
    items = tokens.select("row", "doc_id", "n", "crcs", blocks.alias("blocks"), F.ceil(tail / unit).alias("kind"))
    items = base.stored(ranked(items), "ranked")
    shares = items.groupBy("shard", "kind").agg(F.count("*").alias("rows"), F.sum("blocks").alias("blocks"))
    bases = shares.withColumn("base", F.sum("rows").over(Window.partitionBy("kind").orderBy("shard")) - F.col("rows")).select("shard", "kind", "base")
    by_shard = base.running_base(shares.groupBy("shard").agg(F.sum("blocks").alias("blocks")), "shard", "blocks", "blocks_base").select("shard", "blocks_base")
    histogram = {r["kind"]: r["rows"] for r in shares.where("kind > 0").groupBy("kind").agg(F.sum("rows").alias("rows")).collect()}
    plan = cutting.plan(histogram, size // unit)
    total_blocks = shares.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    # One row for each partition and class that it holds, and one for each partition.
    known = items.join(F.broadcast(bases), ["shard", "kind"]).join(F.broadcast(by_shard), "shard")
    known = known.select("row", "doc_id", "n", "crcs", "blocks", "kind", (F.col("base") + F.col("place")).alias("rank"), (F.col("blocks_base") + F.col("before")).alias("first_block"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ranks = b["kind"].to_numpy(), b["rank"].to_numpy()
            sequence, slot = np.full(len(kinds), -2, np.int64), np.zeros(len(kinds), np.int64)
            sequence[kinds > 0], slot[kinds > 0] = item_places(plan, kinds[kinds > 0], ranks[kinds > 0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], [*b.schema.names, "sequence", "slot"])

    from pyspark.sql.types import IntegerType, LongType, StructType

    placed = base.stored(known.mapInArrow(base.rested(place), StructType(list(known.schema.fields)).add("sequence", LongType()).add("slot", LongType())), "placed")
    shape = ["row", "doc_id", "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset"]
    length = F.col("n") % size
    whole = placed.where("blocks > 0").select("row", "doc_id", "n", "first_block", F.posexplode(F.slice("crcs", F.lit(1), F.col("blocks").cast("int"))).alias("k", "ids_crc32"))
    whole = whole.withColumns({"start": F.col("k").cast("long") * size, "length": F.lit(size).cast("long"), "sequence_id": F.col("first_block") + F.col("k") + plan.sequences, "offset": F.lit(0).cast("long")})
    tails = placed.where("sequence >= 0").withColumns({"length": length, "start": F.col("n") - length, "ids_crc32": F.element_at("crcs", -1), "sequence_id": F.col("sequence")})
    tails = tails.withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length"))
    # What the plan leaves over: a bounded number of items, whatever the number of documents.
    over = placed.where("sequence = -1").withColumn("length", length)
    over = over.withColumn("at", F.sum("length").over(Window.orderBy("kind", "rank")) - F.col("length"))
    over = over.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("length") - 1) / size))))
    begin, end = F.greatest("at", F.col("piece") * size), F.least(F.col("at") + F.col("length"), (F.col("piece") + 1) * size)
    over = over.select("row", "doc_id", "n", (begin - F.col("at") + F.col("n") - F.col("length")).alias("start"), (end - begin).alias("length"), (F.col("piece") + plan.sequences + total_blocks).alias("sequence_id"), (begin - F.col("piece") * size).alias("offset"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = base.list_parts(b["part"])
            raw = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "part"), pa.array(crc, pa.int64())], [*(c for c in b.schema.names if c != "part"), "ids_crc32"])

    parts = tokens.select("row", "ids").join(F.broadcast(over), "row").withColumn("part", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))).drop("ids")
    over = parts.mapInArrow(base.rested(check), StructType([f for f in parts.schema.fields if f.name != "part"]).add("ids_crc32", LongType()))
    pieces = whole.select(*shape).unionByName(tails.select(*shape)).unionByName(over.select(*shape))
    return pieces, tokens


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of each sequence, and the document of each of its pieces."""
    parts = pieces.join(tokens.select("row", "ids"), "row").select("sequence_id", "offset", "doc_id", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part"))
    rows = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "part"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.part").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
