"""Near-duplicate vectors by NN-descent (operator 10).

Equal vectors form one node. The first neighbour graph comes from several orders of the nodes by random sign codes: in
each order, runs of ``block`` consecutive nodes are compared. Then neighbours meet through their common neighbours: a
node's neighbours and those that name it are compared with each other, and each keeps its nearest. A list whose last
entry is a link (cosine >= threshold) is saturated and becomes twice as long for the next round, up to ``longest``. The
rounds end when no list is saturated anew and hardly any entry (``settled``) changes. Where comparing shows links, a
spanning forest of them is reported, so every link met joins its components even where a list is full of nearer ones.

In dense groups a list of any bounded length misses links, so links are counted apart: each component is cut into tiles, and
pairs of tiles are multiplied, without a row for each pair. A list of any length finds the component; the tiles count in full.

Each run audits itself: a bounded sample of nodes is compared with all, and if less than ``target`` of their links lie within
the found components, further orders are drawn and the descent goes on, ``retries`` times at most. The share is the result's
column ``audit_recall`` (1 where the sample has no link).

Nulls and ties: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; a null id has a null component, no links and is kept; rows with equal ids are one vector each, and
their component is the least id reachable; vectors of different lengths link with nothing. A list's ties go to the
smaller node number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, vectors
from .components import components

THRESHOLD = 0.95
#: First length of a list and its greatest, orders for the first graph, nodes compared in an order's run, nodes of a tile.
K, LONGEST, ORDERS, BLOCK, TILE = 8, 64, 8, 128, 512
#: Those that name a node are compared in groups of about so many.
GROUP = 64
#: Share of entries that a settled graph still changes; nodes of the audit, the recall it wants, and how often it tries again.
SETTLED, AUDIT, TARGET, RETRIES = 0.02, 256, 0.95, 3
NEAR = "node long, near array<struct<d:double,node:long>>, link long"


def codes(nodes: DataFrame, orders: range) -> DataFrame:
    """(order, code, node, vector): signs of 60 random projections, in each order of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b["vector"]).to_numpy()
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                part = b.take(at)
                data = vectors.matrix(part["vector"])
                for o in orders:
                    planes = np.random.default_rng([o, int(size)]).normal(size=(int(size), 60))
                    code = ((data @ planes > 0).astype(np.int64) << np.arange(60)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), o * 100_000 + size, np.int64)), pa.array(code), part["node"], part["vector"]], ["order", "code", "node", "vector"])

    return nodes.mapInArrow(run, "order long, code long, node long, vector array<double>")


def forest(hit: np.ndarray) -> np.ndarray:
    """The parent of each member in a spanning forest of the links ``hit``; -1 for roots and members without a link."""
    parent = np.full(len(hit), -1, np.int64)
    left = hit.any(axis=1)
    while left.any():
        now = np.array([int(left.argmax())])
        left[now] = False
        while len(now):
            reach = hit[now] & left
            new = np.flatnonzero(reach.any(axis=0))
            parent[new] = now[reach[:, new].argmax(axis=0)]
            left[new] = False
            now = new
    return parent


def compared(ids: np.ndarray, data: np.ndarray, k: int | np.ndarray, threshold: float) -> pa.RecordBatch:
    """NEAR rows for some nodes (ascending) that meet: each one's ``k`` nearest, and its parent in a spanning forest of the links."""
    cosines = data @ data.T
    np.fill_diagonal(cosines, -2)
    sizes = np.minimum(np.broadcast_to(k, len(ids)), len(ids) - 1)
    m = int(sizes.max())
    order = np.argsort(-np.round(cosines, 6), axis=1, kind="stable")[:, :m]
    d = -np.round(np.take_along_axis(cosines, order, axis=1), 6)
    kept = np.arange(m) < sizes[:, None]
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    parent = forest(cosines >= threshold)
    near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d[kept]), pa.array(ids[order][kept])], ["d", "node"]))
    return pa.RecordBatch.from_arrays([pa.array(ids), near, pa.array(ids[parent], mask=parent < 0)], ["node", "near", "link"])


def first_graph(nodes: DataFrame, orders: range, block: int, k: int, threshold: float) -> DataFrame:
    """NEAR rows from comparing the neighbours in each order."""
    dealt = codes(nodes, orders).repartitionByRange("order", "code", "node").sortWithinPartitions("order", "code", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in base.runs_of(batches, ["order"]):
            for at in range(0, rows.num_rows, block):
                # the last run of an order reaches back, so that no node is alone at its end
                part = rows.slice(max(0, min(at, rows.num_rows - block)), block)
                if part.num_rows > 1:
                    ids, first = np.unique(part["node"].to_numpy(), return_index=True)
                    yield compared(ids, vectors.matrix(part["vector"])[first], k, threshold)

    return dealt.mapInArrow(run, NEAR)


def merged(found: DataFrame, lengths: DataFrame, k: int, longest: int, threshold: float) -> DataFrame:
    """(node, k, near): the nearest of all entries (node, other, d), as many as the node's list is long.

    A window with a limit chooses them, so a node that very many name is never gathered as a whole.
    """
    once = found.groupBy("node", "other").agg(F.min("d").alias("d"))
    ranked = once.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))).where(F.col("rn") <= longest)
    kept = ranked.join(lengths.select("node", "k"), "node", "left").withColumn("k", F.coalesce("k", F.lit(k))).where(F.col("rn") <= F.col("k"))
    return kept.groupBy("node").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("d", F.col("other").alias("node")))).alias("near"))


def entries(near: DataFrame) -> DataFrame:
    return near.select("node", F.explode("near").alias("e")).select("node", F.col("e.node").alias("other"), F.col("e.d").alias("d"))


def forest_links(near: DataFrame) -> DataFrame:
    return near.where("link is not null").select(F.least("node", "link").alias("a"), F.greatest("node", "link").alias("b")).distinct()


def lengthened(graph: DataFrame, longest: int, threshold: float) -> DataFrame:
    """(node, k, was): twice as long as it was where a full list ends with a link."""
    full = (F.size("near") >= F.col("k")) & (F.element_at("near", -1)["d"] <= -threshold)
    return graph.select("node", F.when(full, F.least(F.col("k") * 2, F.lit(longest))).otherwise(F.col("k")).alias("k"), F.col("k").alias("was"))


def meetings(graph: DataFrame, nodes: DataFrame, lengths: DataFrame, threshold: float) -> DataFrame:
    """NEAR rows from comparing the neighbours of each node, and those that name it, with each other: of each as many as its
    list is long."""
    edges = graph.select("node", F.explode("near.node").alias("other"))
    names = edges.groupBy("other").agg(F.ceil(F.count("*") / GROUP).alias("groups")).withColumnRenamed("other", "centre")
    inward = edges.select(F.col("other").alias("centre"), F.col("node").alias("member")).join(names, "centre")
    inward = inward.select("centre", F.pmod(F.xxhash64("member"), F.col("groups")).alias("part"), "member")
    outward = edges.select(F.col("node").alias("centre"), F.col("other").alias("member")).unionByName(graph.select(F.col("node").alias("centre"), F.col("node").alias("member")))
    outward = outward.join(names, "centre", "left").select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("groups", F.lit(1)) - 1)).alias("part"), "member")
    rows = inward.unionByName(outward).distinct().join(nodes.join(lengths.select("node", "k"), "node").select(F.col("node").alias("member"), "vector", "k"), "member")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in base.runs_of(batches, ["centre", "part"]):
            if some.num_rows > 1:
                ids = some["member"].to_numpy()
                order = np.argsort(ids)
                yield compared(ids[order], vectors.matrix(some["vector"])[order], some["k"].to_numpy()[order], threshold)

    return rows.mapInArrow(run, NEAR)


def descended(nodes: DataFrame, met: DataFrame, before: tuple[DataFrame, list[DataFrame]] | None, k: int, longest: int, threshold: float, settled: float) -> tuple[DataFrame, list[DataFrame]]:
    """(graph, what met) from first meetings, joined to an earlier graph if there is one, until settled.

    A round writes two tables, what met and the graph; the links are read from all that met, at the end.
    """
    met = base.stored(met, "met")
    lengths = nodes.select("node", F.lit(k).alias("k")) if before is None else before[0].select("node", "k")
    found = entries(met) if before is None else entries(met).unionByName(entries(before[0]))
    all_met = [met] if before is None else [*before[1], met]
    graph = base.stored(merged(found, lengths, k, longest, threshold), "graph")
    while True:
        lengths = lengthened(graph, longest, threshold)
        met = base.stored(meetings(graph, nodes, lengths, threshold), "met")
        all_met.append(met)
        after = base.stored(merged(entries(met).unionByName(entries(graph)), lengths, k, longest, threshold), "graph")
        old = entries(graph).select("node", "other", F.lit(True).alias("old"))
        changes, total = entries(after).join(old, ["node", "other"], "left").agg(F.count_if(F.col("old").isNull()), F.count("*")).first()
        grown = lengths.agg(F.count_if(F.col("k") > F.col("was"))).first()[0]
        graph = after
        if changes <= settled * max(1, total) and not grown:
            return graph, all_met


def links_of(all_met: list[DataFrame]) -> DataFrame:
    """(a, b): the links in the forests of all that met."""
    out = forest_links(all_met[0])
    for met in all_met[1:]:
        out = out.unionByName(forest_links(met))
    return out.distinct()


def linked_copies(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, linked): how many rows each node (node, component, vector, copies) is linked with in its component."""
    tiles = members.groupBy("component").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    rows = members.join(tiles, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "vector")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), some in base.runs_of(batches, ["component", "i", "j"]):
            data, own, copies = vectors.matrix(some["vector"]), some["own"].to_numpy(), some["copies"].to_numpy()
            hit = data @ data.T >= threshold
            np.fill_diagonal(hit, False)
            if i != j:
                hit &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(some["node"].to_numpy()), pa.array((hit * copies).sum(axis=1).astype(np.int64))], ["node", "linked"])

    return rows.mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def audited(nodes: DataFrame, found: DataFrame, threshold: float, sample: int) -> float:
    """The share of the links of at most ``sample`` nodes, those with the least hashes, that lie within a component."""
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "vector").collect()
    by_size: dict[int, tuple] = {}
    for size in {len(r["vector"]) for r in asked}:
        mine = [r for r in asked if len(r["vector"]) == size]
        by_size[size] = np.array([r["node"] for r in mine]), np.array([r["vector"] for r in mine])
    shared = nodes.sparkSession.sparkContext.broadcast(by_size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b["vector"]).to_numpy()
            for size, (own, q) in shared.value.items():
                some = b.take(pa.array(np.flatnonzero(sizes == size)))
                if some.num_rows:
                    other = some["node"].to_numpy()
                    who, at = np.nonzero((q @ vectors.matrix(some["vector"]).T >= threshold) & (own[:, None] != other[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(other[at])], ["node", "other"])

    true = nodes.select("node", "vector").mapInArrow(compare, "node long, other long")
    of = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    row = true.join(of("node", "x"), "node", "left").join(of("other", "y"), "other", "left").agg(F.count("*"), F.count_if(F.col("x") == F.col("y"))).first()
    return row[1] / row[0] if row[0] else 1.0


@base.scoped("near_vectors")
def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, longest: int = LONGEST, orders: int = ORDERS, block: int = BLOCK, settled: float = SETTLED, tile: int = TILE, audit: int = AUDIT, target: float = TARGET, retries: int = RETRIES) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for each row: links are other vectors with a cosine of at least
    ``threshold``."""
    usable = vectors.usable(rows, id_col, vector_col)
    classes = vectors.least_ids(usable, 1).select(F.element_at("ids", 1).alias("node"), "copies", "vector")
    # Two different vectors with one id: the node's number must tell them apart.
    classes = base.stored(classes.withColumn("node", F.struct("node", F.xxhash64("vector"))).select(F.col("node.node").alias("least"), F.xxhash64("node").alias("node"), "copies", "vector"), "classes")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) for x in b["vector"]]
            lists = [x / np.abs(x).max() for x in lists]
            yield pa.RecordBatch.from_arrays([b["node"], b["copies"], pa.array([x / np.linalg.norm(x) for x in lists], pa.list_(pa.float64()))], ["node", "copies", "vector"])

    nodes = base.stored(classes.select("node", "copies", "vector").mapInArrow(unit, "node long, copies long, vector array<double>"), "nodes")
    state = None
    for attempt in range(retries + 1):
        met = first_graph(nodes, range(attempt * orders, (attempt + 1) * orders), block, k, threshold)
        state = descended(nodes, met, state, k, longest, threshold, settled)
        found = base.stored(components(links_of(state[1])).select("node", "component"), "components")
        share = audited(nodes, found, threshold, audit)
        if share >= target:
            break
    counts = linked_copies(found.join(nodes, "node"), threshold, tile)
    least = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(found, "node", "left").join(counts, "node", "left").join(least, "component", "left")
    known = known.select(F.col("vector").alias("v"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    known = base.stored(known, "known")
    all_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    out = all_rows.join(known, (F.col("vector") == F.col("v")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "audit_recall": F.lit(float(share))})


def recall(rows: DataFrame, found: DataFrame, every: int = 100, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all links of the rows whose id is divisible by ``every`` that ``found`` counts: these rows, in blocks,
    against all rows."""
    usable = vectors.usable(rows, id_col, vector_col)
    asked = usable.where(F.col("vec_id") % every == 0)
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 + asked.count() // 256)).alias("block"), F.size("vector").alias("size")).agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("vector")).alias("flat"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = usable.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.size("vector").alias("size"), "vec_id", "vector")
    asks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n = [], []
        if left.num_rows:
            data, own = vectors.matrix(left["vector"]), left["vec_id"].to_numpy()
            data = data / np.linalg.norm(data, axis=1, keepdims=True)
            for b in right.to_pylist():
                q = np.array(b["flat"]).reshape(len(b["ids"]), -1)
                hit = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ data.T >= threshold
                ids += b["ids"]
                n += (hit & (np.array(b["ids"])[:, None] != own[None, :])).sum(axis=1).tolist()
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    true = some.groupBy("part", "size").cogroup(asks.groupBy("part", "size")).applyInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return 1.0 if not row[1] else row[0] / row[1]
