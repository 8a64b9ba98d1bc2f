"""Substring removal by de Bruijn compaction of repeated word runs (operator 5).

A window is ``window`` consecutive words. Of the k-mers of each window the one with the least hash is its anchor, so
equal windows have equal anchors at equal places; some 7 % of all k-mers are anchors. Anchors are the nodes of a
de Bruijn graph, and the words from one anchor to the end of the next are its edges. The graph's nodes are joined
over all blocks: a node that occurs at least twice with one incoming and one outgoing edge throughout lies inside a
repeated nonbranching path. Consecutive nodes of this kind compact to one path in each document (its head names
the path), and every window inside is repeated. Windows that reach over a path's ends, or hang on a branching node, are
verified by themselves: their hashes, with their source coordinates, are counted over all blocks. Both decisions
depend only on the window's words, so all occurrences of a window are decided alike.

Windows are equal if two independent hashes of 64 bits agree, each over other hashes of the words; inside a path a
node agrees by the first and its edges, which cover its words, by the second. Among n different windows two are taken
for equal with a probability of about n * n / 2**129 (3e-13 for 1e13 windows).

Nulls and ties: a null or empty text has no words; fewer words than a window are never removed; a null id is kept as
null; repeated rows are documents of their own, so their windows occur twice. An empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .blocks import CHUNK, Block, answers, arrow_schema, batch, blocks, chunks, joined, parts_of, rows_of, with_replies
from .words import mixed, powers, runs

WINDOW, KMER = 35, 8
RESULT = "doc_id long, h long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long>>, paths array<struct<head:long,start:long,length:long>>"
SINGLE, PATH, BRANCHING = 0, 1, 2


class Graph:
    """Anchors of one block: place, node key, context (both edges), and for each window its place and anchor."""

    def __init__(self, block: Block, window: int, k: int):
        self.window, self.k = window, k
        self.doc = np.repeat(np.arange(len(block.lengths)), block.lengths)
        h, self.second = (block.hashes(seed)[block.ids] if block.vocab else np.empty(0, np.uint64) for seed in (0, 1))
        n = len(h)
        ok = np.flatnonzero(self.doc[window - 1 :] == self.doc[: n - window + 1]) if n >= window else np.empty(0, np.int64)
        self.starts = ok
        self.windows = runs(h, window)[ok] if len(ok) else np.empty(0, np.uint64)
        if not len(ok):
            self.place, self.keys, self.context, self.anchor = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        kmers = runs(h, k)
        width = window - k + 1
        slid = np.lib.stride_tricks.sliding_window_view(kmers, width)
        best = np.concatenate([slid[i : i + 16384].argmin(axis=1) for i in range(0, len(slid), 16384)])
        place = np.arange(n - window + 1)[ok] + best[ok]
        self.place, self.anchor = np.unique(place, return_inverse=True)
        self.keys = kmers[self.place]
        up, down = powers(n + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.second * up[:n], dtype=np.uint64)))
        p, q = self.place[:-1], self.place[1:] + k
        self.linked = self.doc[p] == self.doc[self.place[1:]]
        edge = mixed((total[q] - total[p]) * down[p] + (q - p).astype(np.uint64))
        edge[~self.linked] = 0
        none = np.zeros(1, np.uint64)
        self.context = mixed(np.concatenate((none, edge)) * np.uint64(0x9E3779B97F4A7C15) + np.concatenate((edge, none)))

    def window_values(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen windows' distinct (hash, check value), by hash: both, how many windows, and each window's place.

        The check value is a hash of the window over other hashes of its words.
        """
        keys = self.windows[chosen]
        checks = runs(self.second, self.window)[self.starts[chosen]] if len(keys) else keys
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else np.empty(0, bool)
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        return k[new], c[new], np.bincount(place, minlength=int(new.sum())).astype(np.uint32), place

    def paths(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last anchor of each compacted path, and where its words begin and end."""
        inside = kind == PATH
        linked = np.concatenate(([False], self.linked, [False])) if len(inside) else np.zeros(1, bool)
        first = np.flatnonzero(inside & ~(linked[:-1] & np.concatenate(([False], inside[:-1])))) if len(inside) else np.empty(0, np.int64)
        last = np.flatnonzero(inside & ~(linked[1:] & np.concatenate((inside[1:], [False])))) if len(inside) else np.empty(0, np.int64)
        begin = np.where(linked[first], self.place[first - 1], self.place[first]) if len(first) else first
        after = np.minimum(last + 1, max(0, len(inside) - 1))
        end = np.where(linked[last + 1], self.place[after], self.place[last]) + self.k if len(first) else first
        return first, last, begin, end

    def decided(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window: is it inside a path, and is it open (to be verified by itself)."""
        first, last, begin, end = self.paths(kind)
        of = kind[self.anchor]
        inside = of == PATH
        path = np.clip(np.searchsorted(first, self.anchor, "right") - 1, 0, max(0, len(first) - 1))
        if len(first):
            inside &= (begin[path] <= self.starts) & (self.starts + self.window <= end[path])
        return inside, (of != SINGLE) & ~inside


def distinct(keys: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how often each occurs, its least context, and whether that is its only one."""
    order = np.lexsort((context, keys))
    k, c = keys[order], context[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    last = np.concatenate((first[1:], [len(k)])) - 1 if len(k) else first
    return k[first], (last - first + 1).astype(np.uint32), c[first], c[first] == c[last]


def repeated(inverse: np.ndarray, n: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """For each sent (key, check value): does the pair occur more than once? Equal keys with other check values are others."""
    order = np.lexsort((checks, inverse))
    i, c = inverse[order], checks[order]
    group = np.cumsum(np.concatenate(([True], (i[1:] != i[:-1]) | (c[1:] != c[:-1])))) - 1 if len(i) else i
    out = np.empty(len(i), bool)
    out[order] = (np.bincount(group, n[order]) > 1)[group] if len(i) else False
    return out


@base.scoped("runs")
def repeated_runs(docs: DataFrame, window: int = WINDOW, k: int = KMER, with_paths: bool = False) -> DataFrame:
    """(doc_id, h, n_words, n_removed, kept_sha256, spans, paths) for each document (doc_id, text, h).

    ``spans`` are the removed runs of words; ``paths`` the occurrences of compacted paths, by the key of their head.
    ``h`` is a hash of the text, which tells rows of one id apart.
    """
    stored = blocks(docs, False, ["h"])
    parts = parts_of(docs)
    k = min(k, window)

    arrow = arrow_schema(CHUNK)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = Graph(Block(row), window, k)
            keys, n, context, one = distinct(g.keys, g.context)
            if rows := list(chunks(row["block"], keys, [n, context, one], parts)):
                yield batch(rows, arrow)

    def kinds(keys, inverse, columns):
        n, context, one = columns
        total = np.bincount(inverse, n, len(keys))
        low, high = np.full(len(keys), 2**64 - 1, np.uint64), np.zeros(len(keys), np.uint64)
        np.minimum.at(low, inverse, context)
        np.maximum.at(high, inverse, context)
        mixed_up = np.bincount(inverse, ~one, len(keys)) > 0
        kind = np.where(total < 2, SINGLE, np.where((low == high) & ~mixed_up, PATH, BRANCHING)).astype(np.uint8)
        return kind[inverse], ()

    slim = stored.select("block", "lengths", "ids", "vocab")
    node_kinds = base.stored(answers(slim.mapInArrow(base.rested(nodes), CHUNK), [np.uint32, np.uint64, np.bool_], kinds), "nodes")

    def of_anchors(g: Graph, replies: list[bytes]) -> np.ndarray:
        keys, at = np.unique(g.keys, return_inverse=True)
        return joined(replies, np.uint8)[at] if len(keys) else np.empty(0, np.uint8)

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = Graph(Block(row), window, k)
            _, is_open = g.decided(of_anchors(g, row["kinds"]))
            keys, checks, n, _ = g.window_values(is_open)
            if rows := list(chunks(row["block"], keys, [n, checks], parts)):
                yield batch(rows, arrow)

    def often(keys, inverse, columns):
        return repeated(inverse, *columns), ()

    known = with_replies(slim, node_kinds, "kinds")
    verified = base.stored(answers(known.mapInArrow(base.rested(open_windows), CHUNK), [np.uint32, np.uint64], often), "windows")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            g = Graph(block, window, k)
            kind = of_anchors(g, row["kinds"])
            hit, is_open = g.decided(kind)
            if is_open.any():
                hit[is_open] = joined(row["often"], np.bool_)[g.window_values(is_open)[3]]
            covered = np.zeros(len(block.ids) + 1, np.int64)
            np.add.at(covered, g.starts[hit], 1)
            np.add.at(covered, g.starts[hit] + window, -1)
            removed = np.cumsum(covered[:-1]) > 0
            ends = np.cumsum(block.lengths)
            gone = np.concatenate(([0], np.cumsum(removed)))
            n_removed = gone[ends] - gone[ends - block.lengths]
            shas, spans = [], []
            for n, e, r in zip(block.lengths.tolist(), ends.tolist(), n_removed.tolist(), strict=True):
                ids = block.ids[e - n : e]
                here = []
                if r:
                    mask = removed[e - n : e]
                    ids = ids[~mask]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2).tolist()
                    here = [{"start": s, "length": t - s} for s, t in edges]
                spans.append(here)
                shas.append(hashlib.sha256(b" ".join(map(block.vocab.__getitem__, ids.tolist()))).hexdigest())
            paths: list[list[dict]] = [[] for _ in shas]
            if with_paths:
                base_of = ends - block.lengths
                first, _, begin, end = g.paths(kind)
                for f, s, e in zip(first.tolist(), begin.tolist(), end.tolist(), strict=True):
                    d = int(g.doc[s])
                    paths[d].append({"head": int(g.keys[f].view(np.int64)), "start": s - int(base_of[d]), "length": e - s})
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["h"], pa.int64()), pa.array(block.lengths), pa.array(n_removed), pa.array(shas, pa.string()), pa.array(spans, SPANS), pa.array(paths, PATHS)],
                ["doc_id", "h", "n_words", "n_removed", "kept_sha256", "spans", "paths"],
            )

    whole = with_replies(with_replies(stored, node_kinds, "kinds"), verified, "often")
    return whole.mapInArrow(base.rested(finish), RESULT)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
PATHS = pa.list_(pa.struct([("head", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def hashed_texts(docs: DataFrame) -> DataFrame:
    return base.texts(docs).withColumn("h", F.xxhash64("text"))


@base.scoped("spans")
def cuts(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, h, spans) of the documents with something to cut."""
    return repeated_runs(hashed_texts(docs), window, k).where("n_removed > 0").select("doc_id", "h", "spans").dropDuplicates(["doc_id", "h"])


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated runs of words cut out of the text; a text with nothing to cut stays as it is, one
    with cuts is its kept words joined by single spaces. All columns of the input come back, whatever their names.

    Only the texts with something to cut, and the few that a bitmap of fixed size takes for such, move to be joined with
    their cuts; all others are passed on where they lie.
    """
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = cuts(pair, window, k)
    may_be_cut = base.KeyFilter(found.select("doc_id", "h"))
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"row.{quoted(text_col)}"), F.lit(""))).alias("h"))

    @F.arrow_udf("string")
    def trimmed(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            words = (text or "").encode().split()
            for s in reversed(cuts):
                del words[s["start"] : s["start"] + s["length"]]
            out.append(b" ".join(words).decode())
        return pa.array(out, pa.string())

    sure = rows.where(~may_be_cut("doc_id", "h")).select("row.*")
    joined_rows = rows.where(may_be_cut("doc_id", "h")).alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.h") == F.col("f.h")), "left").select("row", "spans")
    joined_rows = base.stored(joined_rows, "joined")
    same = joined_rows.where("spans is null").select("row.*")
    cut = joined_rows.where("spans is not null").select(*(trimmed(F.col(f"row.{quoted(c)}"), "spans").alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))
    return sure.union(same).union(cut)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
