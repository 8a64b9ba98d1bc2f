"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard (operator 6).

Vectors are dealt to shards of about ``shard_rows``: first to the nearest of some centroids, fitted on a bounded sample,
then by a hash where a centroid has more. A task builds its shard's graph, and the graph is stored as one Parquet row of
flat arrays: ids, vectors, and for each level the nodes' neighbours as 32-bit integers. Rows enter a graph in batches: each
batch searches the graph so far for its neighbours, keeps a spread-out few of them and links both ways; a node whose list
overflows keeps its best. Searching reads the stored rows: a task holds one block of queries of bounded size, mostly of
one cell, loads the arrays of one visited shard after the other, and merges their answers as it goes. A block's shards are dealt to a
fixed number of lanes, so the answers stored are at most ``n`` of each query and lane, however many shards are visited.

A query visits the shards of its nearest centroids only. How many is audited in each run: a bounded sample of queries is
compared with all rows, and so many centroids are visited as hold ``target`` of the sample's true neighbours, all of them
if need be. Nearness is the inner product in double precision; the graph is built on vectors with one more component
that makes them equally long, which turns the largest inner product into the least distance.

Equal vectors form one node, which answers with its least ids, as many as an answer can need: so copies neither crowd
the graph nor the answers, and ties go to the smaller id.

Nulls and ties: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of another length than the query's are no candidates; rows with one id and different vectors are
candidates of their own. Without other rows a query has no answer. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, vectors

#: Rows of a shard; neighbours on a level (twice as many on the lowest); width of the search while building and asking.
SHARD_ROWS, LINKS, BUILD_WIDTH, SEARCH_WIDTH = 4096, 16, 96, 192
BATCH, QUERY_BLOCK, LANES = 128, 1024, 4
#: Most centroids, rows they are fitted on, queries of the audit, and the share of true neighbours that visits must hold.
CENTROIDS, SAMPLE, AUDIT, TARGET = 1024, 16_384, 128, 0.97


class Graph:
    """A shard's graph: ``levels[l]`` is an int32 matrix of neighbours, -1 where a list ends."""

    def __init__(self, data: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH):
        n = len(data)
        norms = (data * data).sum(axis=1)
        self.data = data
        self.points = np.column_stack([data, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))])
        rng = np.random.default_rng(n)
        self.level = np.minimum((-np.log(rng.random(n)) / math.log(links)).astype(int), 8)
        self.level[:1] = self.level.max(initial=0)
        self.levels = [np.full((n, links * (2 if l == 0 else 1)), -1, np.int32) for l in range(int(self.level.max(initial=0)) + 1)]
        at = 1
        while at < n:
            size = min(BATCH, max(1, at))
            self._add(np.arange(at, min(n, at + size)), width)
            at += size

    def arrays(self) -> tuple[np.ndarray, list[np.ndarray]]:
        return self.data.ravel(), [t.ravel() for t in self.levels]

    @classmethod
    def stored(cls, data: np.ndarray, levels: list[np.ndarray]) -> Graph:
        """A graph from its arrays, for searching."""
        out = cls.__new__(cls)
        norms = (data * data).sum(axis=1)
        out.data, out.levels = data, [t.reshape(len(data), -1) for t in levels]
        out.points = np.column_stack([data, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))])
        return out

    def _add(self, new: np.ndarray, width: int) -> None:
        entry = np.zeros((len(new), 1), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            here = np.flatnonzero(self.level[new] >= level)
            found, scores = self._search(self.points[new], self.points, entry, level, width if len(here) else 1, limit=int(new[0]))
            entry = found[:, : max(1, min(8, found.shape[1]))]
            if not len(here):
                continue
            found, scores = found[here], scores[here]
            mates = new[here]
            if len(mates) > 1:  # those that enter together see each other as well
                among = self.points[mates] @ self.points[mates].T
                np.fill_diagonal(among, -np.inf)
                found = np.hstack([found, np.broadcast_to(mates, (len(mates), len(mates)))])
                scores = np.hstack([scores, among])
            self._link(mates, found, scores, level)

    def _link(self, nodes: np.ndarray, found: np.ndarray, scores: np.ndarray, level: int) -> None:
        table = self.levels[level]
        keep = table.shape[1] // (2 if level == 0 else 1)
        for node, row, score in zip(nodes, found, scores, strict=True):
            order = np.argsort(-score, kind="stable")[: 4 * keep]
            order = order[np.isfinite(score[order])]
            chosen = self._spread(node, row[order], score[order], keep)
            table[node, : len(chosen)] = chosen
            for other in chosen:
                back = table[other]
                free = np.flatnonzero(back < 0)
                if node in back:
                    continue
                if len(free):
                    back[free[0]] = node
                else:
                    all_of = np.append(back, node)
                    close = self.points[all_of] @ self.points[other]
                    order = np.argsort(-close, kind="stable")
                    best = self._spread(other, all_of[order], close[order], len(back))
                    back[:] = -1
                    back[: len(best)] = best

    def _spread(self, node: int, candidates: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
        """Candidates, nearest first, without those nearer to one already taken than to the node, unless too few remain."""
        if len(candidates) <= keep:
            return candidates
        close = self.points[candidates] @ self.points[candidates].T
        taken: list[int] = []
        most = np.full(len(candidates), -np.inf)
        for i in range(len(candidates)):
            if most[i] <= scores[i]:
                taken.append(i)
                np.maximum(most, close[i], out=most)
                if len(taken) == keep:
                    break
        if len(taken) < keep:
            rest = np.ones(len(candidates), bool)
            rest[taken] = False
            taken += np.flatnonzero(rest)[: keep - len(taken)].tolist()
        return candidates[taken]

    def _search(self, queries: np.ndarray, points: np.ndarray, entry: np.ndarray, level: int, width: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries at once: (nodes, scores), ``width`` of them for each query, best first.

        Only nodes below ``limit`` count. Each step opens the best few nodes of each query that are not yet open; the
        search ends when every query's best ``width`` are open.
        """
        limit = len(points) if limit is None else limit
        table, q = self.levels[level], np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(points) + 1), bool)
        nodes = np.full((len(queries), width), -1, np.int64)
        scores = np.full((len(queries), width), -np.inf)
        opened = np.zeros((len(queries), width), bool)
        fresh = entry
        steps = 4 if width > 8 else 1
        while True:
            valid = (fresh >= 0) & (fresh < limit)
            fresh = np.where(valid, fresh, len(points))
            valid &= ~seen[q, fresh]
            order = np.sort(np.where(valid, fresh, len(points)), axis=1)  # a node that two lists name counts once
            valid = (order < len(points)) & np.concatenate((np.ones((len(queries), 1), bool), order[:, 1:] != order[:, :-1]), axis=1)
            fresh = order
            seen[q, fresh] = True
            safe = np.where(valid, fresh, 0)
            got = np.einsum("qd,qnd->qn", queries, points[safe])
            got[~valid] = -np.inf
            nodes, scores, opened = np.hstack([nodes, np.where(valid, fresh, -1)]), np.hstack([scores, got]), np.hstack([opened, np.zeros(fresh.shape, bool)])
            best = np.argsort(-scores, axis=1, kind="stable")[:, :width]
            nodes, scores, opened = nodes[q, best], scores[q, best], opened[q, best]
            todo = ~opened & (nodes >= 0)
            if not todo.any():
                return nodes, scores
            pick = np.argsort(~todo, axis=1, kind="stable")[:, :steps]
            live = todo[q, pick]
            opened[q, pick] |= live
            out = table[np.where(live, nodes[q, pick], 0)]
            fresh = np.where(live[:, :, None], out, -1).reshape(len(queries), -1).astype(np.int64)

    def nearest(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products), best first; -1 where there are no more."""
        entry = np.zeros((len(queries), 1), np.int64)
        extended = np.column_stack([queries, np.zeros(len(queries))])
        for level in range(len(self.levels) - 1, 0, -1):
            entry = self._search(extended, self.points, entry, level, 1)[0][:, :1]
        nodes, _ = self._search(extended, self.points, entry, 0, min(width, len(self.data)))
        exact = np.einsum("qd,qnd->qn", queries, self.data[np.maximum(nodes, 0)])
        exact[nodes < 0] = -np.inf
        return nodes, exact


def centroids(rows: DataFrame, k: int, sample: int) -> np.ndarray:
    """``k`` means of at most ``sample`` vectors of the most frequent length, those with the least hashes."""
    some = rows.orderBy(F.xxhash64("vector"), "vec_id").limit(sample).select("vector").toArrow()["vector"]
    sizes = pa.compute.list_value_length(some).to_numpy()
    most = np.bincount(sizes).argmax()
    data = vectors.matrix(some.combine_chunks().filter(pa.array(sizes == most)))
    rng = np.random.default_rng(6)
    means = data[rng.permutation(len(data))[: min(k, len(data))]].copy()
    for _ in range(8):
        of = nearest_centroid(data, means)
        for c in range(len(means)):
            if (mine := data[of == c]).size:
                means[c] = mine.mean(axis=0)
    return means


def nearest_centroid(data: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(((means * means).sum(axis=1) - 2 * data[i : i + 4096] @ means.T).argmin(axis=1) for i in range(0, len(data), 4096))])


INDEX = "cell int, sub int, size int, ids array<array<long>>, vectors array<double>, levels array<array<int>>"


def build(rows: DataFrame, n: int, means: np.ndarray, shard_rows: int, links: int, width: int) -> DataFrame:
    """The stored index, a row for each shard (INDEX). Vectors of another length than the centroids' are in cell -1."""
    shared = rows.sparkSession.sparkContext.broadcast(means)
    classes = vectors.least_ids(rows, n + 1).select("ids", "vector")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b["vector"]).to_numpy()
            cell = np.full(b.num_rows, -1, np.int32)
            fits = np.flatnonzero(sizes == shared.value.shape[1])
            if len(fits):
                cell[fits] = nearest_centroid(vectors.matrix(b["vector"].take(pa.array(fits))), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sizes.astype(np.int32)), b["ids"], b["vector"]], ["cell", "size", "ids", "vector"])

    placed = base.stored(classes.mapInArrow(place, "cell int, size int, ids array<long>, vector array<double>"), "placed")
    subs = placed.groupBy("cell", "size").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
    dealt = placed.join(F.broadcast(subs) if len(means) <= CENTROIDS else subs, ["cell", "size"]).withColumn("sub", F.pmod(F.xxhash64("vector"), F.col("subs")).cast("int")).drop("subs")

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        data = vectors.matrix(table["vector"])
        order = np.lexsort(data.T[::-1])  # the same graph whatever the order of arrival
        order = order[np.random.default_rng(1).permutation(len(order))]
        flat, levels = Graph(data[order], links, width).arrays()
        ids = table["ids"].combine_chunks().take(pa.array(order)).to_pylist()
        cell, sub, size = (k.as_py() for k in key)
        return pa.table({"cell": pa.array([cell], pa.int32()), "sub": pa.array([sub], pa.int32()), "size": pa.array([size], pa.int32()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([flat], pa.list_(pa.float64())), "levels": pa.array([levels], pa.list_(pa.list_(pa.int32())))})

    return base.stored(dealt.groupBy("cell", "sub", "size").applyInArrow(graph, INDEX), "index", compression="zstd")


def true_nearest(rows: DataFrame, asked: list[tuple[int, list[float]]], n: int) -> DataFrame:
    """(query_id, vec_id, score, vector): the ``n`` nearest of each of a bounded number of queries, by comparing all rows."""
    ids = np.array([i for i, _ in asked])
    q = np.array([v for _, v in asked])
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for b in batches:
            keep = np.flatnonzero(pa.compute.list_value_length(b["vector"]).to_numpy() == q.shape[1])
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            score = q @ vectors.matrix(b["vector"]).T
            score[own[:, None] == b["vec_id"].to_numpy()[None, :]] = -np.inf
            best = np.argpartition(-score, min(n, score.shape[1] - 1), axis=1)[:, :n]
            who, at = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
            ok = np.isfinite(score[who, at])
            who, at = who[ok], at[ok]
            yield pa.RecordBatch.from_arrays([pa.array(own[who]), b["vec_id"].take(pa.array(at)), pa.array(score[who, at]), b["vector"].take(pa.array(at))], ["query_id", "vec_id", "score", "vector"])

    near = rows.mapInArrow(compare, "query_id long, vec_id long, score double, vector array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def visits(rows: DataFrame, asked: DataFrame, means: np.ndarray, n: int, audit: int, target: float) -> int:
    """How many centroids a query must visit: audited on at most ``audit`` queries, those with the least hashes."""
    some = asked.where(F.size("vector") == means.shape[1]).orderBy(F.xxhash64("vec_id", "vector")).limit(audit).collect()
    if len(means) == 1 or not some:
        return len(means)
    queries = {r["vec_id"]: np.array(r["vector"]) for r in some}
    found = true_nearest(rows, [(i, v.tolist()) for i, v in queries.items()], n).collect()
    if not found:
        return len(means)
    cell = nearest_centroid(np.array([r["vector"] for r in found]), means)
    rank = {i: np.argsort(np.argsort(-(means @ v))) for i, v in queries.items()}
    needed = np.sort([rank[r["query_id"]][c] + 1 for r, c in zip(found, cell, strict=True)])
    return int(needed[math.ceil(target * len(needed)) - 1])


class Block:
    """A block of queries (query_id, vector, cells) and the best ``n`` answers of each so far."""

    def __init__(self, rows: pa.Table, n: int, width: int):
        self.n, self.width = n, max(width, n + 1)
        self.own, self.vectors = rows["query_id"].to_numpy(), vectors.matrix(rows["vector"])
        offsets, self.cells = base.list_parts(rows["cells"])
        self.owner = np.repeat(np.arange(len(self.own)), np.diff(offsets))
        self.ids = [np.empty(0, np.int64)] * len(self.own)
        self.scores = [np.empty(0)] * len(self.own)

    def ask(self, cell: int, shard: pa.Table) -> None:
        """Merges the answers of a shard for the queries that visit its cell."""
        who = np.unique(self.owner[self.cells == cell])
        ids = shard["ids"][0].as_py()
        data = shard["vectors"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        graph = Graph.stored(data, [np.array(t, np.int32) for t in shard["levels"][0].as_py()])
        for at in range(0, len(who), BATCH):
            some = who[at : at + BATCH]
            for i, nodes, scores in zip(some.tolist(), *graph.nearest(self.vectors[some], self.width), strict=True):
                left, got_v, got_s = self.n, [], []
                for node, s in zip(nodes, scores, strict=True):
                    # the shard's answer is cut where a lower score begins and enough are there
                    if node < 0 or (left <= 0 and s < got_s[-1]):
                        break
                    mine = [x for x in ids[node] if x != self.own[i]]
                    got_v += mine
                    got_s += [s] * len(mine)
                    left -= len(mine)
                self._merge(i, np.array(got_v, np.int64), np.array(got_s, np.float64))

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keeps the best ``n`` different answers, ties by the smaller id."""
        ids, scores = np.concatenate((self.ids[i], ids)), np.concatenate((self.scores[i], scores))
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        self.ids[i], self.scores[i] = ids[new][: self.n], scores[new][: self.n]

    def answers(self) -> pa.RecordBatch:
        who = np.repeat(self.own, [len(x) for x in self.ids])
        return pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.scores))], ["query_id", "vec_id", "score"])


def search(index: DataFrame, asked: DataFrame, means: np.ndarray, probes: int, n: int, width: int, query_block: int = QUERY_BLOCK, lanes: int = LANES) -> DataFrame:
    """(query_id, vec_id, score): the answers of the shards that each query visits, the best ``n`` of each lane."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(means)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b["vector"]).to_numpy().astype(np.int32)
            near = np.full((b.num_rows, min(probes, len(shared.value))), -1, np.int32)
            fits = np.flatnonzero(sizes == shared.value.shape[1])
            if len(fits):
                near[fits] = np.argsort(-(vectors.matrix(b["vector"].take(pa.array(fits))) @ shared.value.T), axis=1)[:, : near.shape[1]]
            lists = base.list_array(near.ravel(), np.full(len(near), near.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(near[:, 0]), pa.array(sizes), b["vec_id"], b["vector"], lists], ["first", "size", "query_id", "vector", "cells"])

    routed = base.stored(asked.mapInArrow(route, "first int, size int, query_id long, vector array<double>, cells array<int>"), "routed")
    # Blocks of about ``query_block`` queries: cells one after another, large cells cut by a hash. One row a cell is numbered here.
    counted = routed.groupBy("size", "first").agg(F.count("*").alias("of"))
    counted = counted.withColumn("before", F.sum("of").over(Window.partitionBy("size").orderBy("first")) - F.col("of"))
    place = F.col("before") + F.pmod(F.xxhash64("query_id", "vector"), "of")
    queries = base.stored(routed.join(counted, ["size", "first"]).select("size", F.floor(place / query_block).alias("block"), "query_id", "vector", "cells"), "queries")
    wanted = queries.groupBy("size", "block").agg(F.array_distinct(F.flatten(F.collect_set("cells"))).alias("cells")).select("size", "block", F.explode("cells").alias("cell"))
    # A block's queries come before its shards in each lane.
    left = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumns({"kind": F.lit(0), "cell": F.lit(-2), "sub": F.lit(-1)})
    right = index.join(wanted, ["size", "cell"]).withColumns({"lane": F.pmod(F.hash("cell", "sub"), F.lit(lanes)), "kind": F.lit(1)})
    keys = ["size", "block", "lane", "kind", "cell", "sub"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(parts, *keys[:3]).sortWithinPartitions(*keys)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for key, rows in base.runs_of(batches, keys):
            if key[3] == 0:
                if block is not None:
                    yield block.answers()
                block = Block(rows, n, width)
            else:
                block.ask(key[4], rows)
        if block is not None:
            yield block.answers()

    return dealt.select(*keys, "query_id", "vector", "cells", "ids", "vectors", "levels").mapInArrow(base.rested(ask), "query_id long, vec_id long, score double")


@base.scoped("nearest")
def nearest(rows: DataFrame, queries: DataFrame, n: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, links: int = LINKS, build_width: int = BUILD_WIDTH, width: int = SEARCH_WIDTH, audit: int = AUDIT, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``n`` nearest rows but itself."""
    indexed = vectors.usable(rows, id_col, vector_col)
    asked = vectors.usable(queries, id_col, vector_col).distinct()
    shape = "query_id long, rank int, vec_id long, score double"
    total = indexed.count()
    if not total:
        return rows.sparkSession.createDataFrame([], shape)
    means = centroids(indexed, min(CENTROIDS, math.ceil(total / shard_rows)), SAMPLE)
    index = build(indexed, n, means, shard_rows, links, build_width)
    probes = visits(indexed, asked, means, n, audit, target)
    found = base.stored(search(index, asked, means, probes, n, width), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def recall(rows: DataFrame, found: DataFrame, queries: DataFrame, n: int = 20, audit: int = AUDIT, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of the true nearest of at most ``audit`` queries that ``found`` names; ties at the end count as found."""
    asked = vectors.usable(queries, id_col, vector_col).orderBy(F.xxhash64("vec_id", "vector")).limit(audit).collect()
    asked = [r for r in asked if len(r["vector"]) == len(asked[0]["vector"])]
    if not asked:
        return 1.0
    true = true_nearest(vectors.usable(rows, id_col, vector_col), [(r["vec_id"], r["vector"]) for r in asked], n).select("query_id", F.col("score").alias("t"))
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    row = true.join(least, "query_id", "left").agg(F.count("*"), F.count_if((F.col("t") >= F.col("least") - 1e-9))).first()
    return row[1] / row[0] if row[0] else 1.0
