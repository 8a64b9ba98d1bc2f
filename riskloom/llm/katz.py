"""Katz backoff language model over n-grams up to a given order (operator 3).

Good-Turing discounts for counts up to ``k`` come from the counts of counts of the whole corpus: as they are where all
factors lie between 0 and 1, else from a straight line through their logarithms, else half of one count; the column
``discount`` says which, for each order. Greater counts lose a thousandth of one count, so that every history keeps
some mass to give away. An n-gram that occurs has its discounted share of its history's count; the mass taken off goes
to all other words in proportion to their probability after the history without its first word, by a backoff weight
that normalises exactly. The unigram itself is discounted the same way, and its free mass is the probability of a word
that the corpus lacks. A text is scored token by token, from the longest history down: the n-gram's share if it occurs,
else the history's weight (none for histories that do not occur) times the probability one order below. Before a text's
first word there are start marks; each text closes with an end token.

The model is stored in partitioned tables below ``model_path``: ``counts`` (by order; ranges of hashed n-grams with
their counts) and ``weights`` (ranges of hashed histories with their backoff weights). N-grams are told apart by 64-bit
hashes: among n different ones about n * n / 2**65 pairs share their counts.

Nulls and ties: a null text is an empty one, whose only token is the end; a null id takes part with the remainder of
the text "null"; repeated rows count as often as they occur. With nothing to learn from, every token has the
probability 1 of the one unknown word. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .blocks import CHUNK, Block, answers, arrow_schema, batch, blocks, chunks, expand, joined, pack, parts_of, rows_of, squeeze, with_replies
from .words import STEP, mixed

#: Counts up to this one are discounted; what greater ones lose; words of a block; the order of the model.
K, TRIFLE, BLOCK_WORDS, ORDER = 5, 1e-3, 1_000_000, 3
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def turing(counts: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 1 .. k from the counts of counts 1 .. k + 1."""
    k = len(counts) - 1
    r = np.arange(1, k + 1)
    with np.errstate(all="ignore"):
        common = (k + 1) * counts[k] / counts[0]
        return ((r + 1) * counts[1:] / (r * counts[:-1]) - common) / (1 - common)


def discounts(n: list[int]) -> tuple[np.ndarray, str]:
    """Factors for counts 0 .. k (index 0 unused), from n[r - 1] = how many n-grams occur r times, r <= k + 1, and the law
    they follow: turing, smoothed or absolute."""
    counts = np.array(n, float)
    r = np.arange(1, len(n) + 1)
    sound = lambda d: bool(np.isfinite(d).all() and (d > 0).all() and (d < 1).all())
    if sound(d := turing(counts)):
        return np.concatenate(([0.0], d)), "turing"
    if (counts > 0).sum() > 1:
        some = counts > 0
        slope, height = np.polyfit(np.log(r[some]), np.log(counts[some]), 1)
        if sound(d := turing(np.exp(height + slope * np.log(r)))):
            return np.concatenate(([0.0], d)), "smoothed"
    return np.concatenate(([0.0], (r[:-1] - 0.5) / r[:-1])), "absolute"


@dataclass
class Law:
    """What a task needs of the model besides the answers: totals and discounts."""

    tokens: int
    distinct: int
    documents: int
    factors: list[np.ndarray]
    unknown: float

    def kept(self, counts: np.ndarray, order: int) -> np.ndarray:
        """Discounted counts."""
        d = self.factors[order - 1]
        return np.where(counts < len(d), counts * d[np.minimum(counts, len(d) - 1).astype(np.int64)], counts - TRIFLE)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts, 1) / max(1, self.tokens), self.unknown)

    def baseline(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


@dataclass
class Level:
    """The distinct n-grams of one order in a block: keys, and of each its history (in the level below, whose last entry
    stands for start marks alone) and the n-gram without its first word; of each token its n-gram and its history."""

    keys: np.ndarray
    first: np.ndarray
    suffix: np.ndarray
    gram: np.ndarray
    history: np.ndarray


class Grams:
    """Tokens and distinct n-grams of one block. Token ids: the vocabulary's, then the end."""

    def __init__(self, block: Block, order: int):
        v, lengths = len(block.vocab), block.lengths
        self.n = lengths + 1
        ends = np.cumsum(self.n) - 1
        self.tokens = np.full(int(self.n.sum()), v, np.int64)
        mask = np.ones(len(self.tokens), bool)
        mask[ends] = False
        self.tokens[mask] = block.ids
        self.doc = np.repeat(np.arange(len(lengths)), self.n)
        self.held = np.array(block.row["held"], bool)
        begins = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
        hashes = np.concatenate((block.hashes(), [END]))
        none = np.empty(0, np.int64)
        self.levels = [Level(hashes, none, none, self.tokens, none)]
        start = START
        for _ in range(1, order):
            below = self.levels[-1]
            history = np.concatenate(([0], below.gram[:-1]))[: len(self.tokens)]
            history[begins] = len(below.keys)
            codes, index, gram = np.unique(history * (v + 1) + self.tokens, return_index=True, return_inverse=True)
            first, second = codes // (v + 1), codes % (v + 1)
            with np.errstate(over="ignore"):
                keys = mixed(np.append(below.keys, start)[first] * np.uint64(STEP) + hashes[second])
                start = mixed(np.array([start * np.uint64(STEP) + START]))[0]
            self.levels.append(Level(keys, first, below.gram[index], gram, history))

    def counts(self) -> list[np.ndarray]:
        """Training counts of each level's n-grams."""
        learnt = (~self.held)[self.doc]
        return [np.bincount(x.gram, learnt, len(x.keys)).astype(np.uint32) for x in self.levels]

    def history_keys(self, o: int) -> np.ndarray:
        """Keys of the histories of order ``o``, start marks alone last; the order is part of a key."""
        start = START
        with np.errstate(over="ignore"):
            for _ in range(2, o):
                start = mixed(np.array([start * np.uint64(STEP) + START]))[0]
            return mixed(np.append(self.levels[o - 2].keys, start) + np.uint64(o))


@base.scoped("scores")
def scored(docs: DataFrame, held_out: DataFrame | str, model_path: str, order: int = ORDER, k: int = K) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, discount) for each document (doc_id, text).

    ``held_out`` is a boolean SQL condition on doc_id; the model learns from the rows where it is false.
    """
    rows = base.texts(docs).withColumn("held", F.expr(held_out) if isinstance(held_out, str) else held_out)
    stored = blocks(rows, True, ["held"], BLOCK_WORDS)
    slim = stored.select("block", "held", "lengths", "ids", "vocab")
    parts = parts_of(docs)
    asks = f"order int, {CHUNK}"
    asks_arrow = arrow_schema(asks)
    orders = range(1, order + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = Grams(Block(row), order)
            for o, level, n in zip(orders, g.levels, g.counts(), strict=True):
                at = np.argsort(level.keys)
                if out := [(o, *c) for c in chunks(row["block"], level.keys[at], [n[at]], parts)]:
                    yield batch(out, asks_arrow)

    def count(keys, inverse, columns):
        n = columns[0]
        total = np.bincount(inverse, n, len(keys)).astype(np.int64)
        learnt = np.flatnonzero(n)
        owner = np.zeros(len(n), np.int64)  # of the blocks that hold an n-gram, the first one speaks for it
        owner[learnt[np.unique(inverse[learnt], return_index=True)[1]]] = 1
        known = keys[total > 0]
        c = total[total > 0]
        of_counts = np.bincount(np.minimum(c, k + 2), minlength=k + 3)[1 : k + 2].tolist()
        return (total[inverse] * 2 + owner).astype(np.uint64), (pack(known), squeeze(c.astype(np.uint32)), of_counts, int(c.sum()), len(c))

    answered = answers(slim.mapInArrow(base.rested(ask), asks), [np.uint32], count, "grams binary, counts binary, n_r array<long>, total long, distinct long", ("order", "part"))
    table = base.written(answered.withColumn("model", F.col("block").isNull()), f"{model_path}/counts", "model", "order", compression="zstd")
    facts = table.where("model").select("order", "total", "distinct", F.posexplode("n_r").alias("r", "n"))
    known = {(x["order"], x["r"]): x for x in facts.groupBy("order", "r").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), F.sum("n").alias("n")).collect()}
    laws = [discounts([known[o, r]["n"] if (o, r) in known else 0 for r in range(k + 1)]) for o in orders]
    tokens, distinct = (known[1, 0][x] if known else 0 for x in ("total", "distinct"))
    law = Law(tokens, distinct, stored.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0, [d for d, _ in laws], 1.0)
    if tokens:  # what the discounts of all unigrams leave
        small = [known[1, r - 1]["n"] for r in range(1, k + 1)]
        law.unknown = (sum(n * r * (1 - float(law.factors[0][r])) for r, n in enumerate(small, 1)) + TRIFLE * (distinct - sum(small))) / tokens

    shape = f"kind int, {CHUNK}, doc_ids array<long>, held array<boolean>, n array<long>, n_known array<long>, base array<double>, seen array<double>, open_doc binary, open_history binary"
    shape_arrow = arrow_schema(shape)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            g = Grams(Block(row), order)
            totals, owns = [], []
            for o, level in zip(orders, g.levels, strict=True):
                told = np.empty(len(level.keys), np.uint64)
                told[np.argsort(level.keys)] = joined(row[f"order{o}"], np.uint64)
                totals.append((told >> np.uint64(1)).astype(np.int64))
                owns.append((told & np.uint64(1)).astype(bool))
            share = law.unigram(totals[0])
            logs = np.log10(share)[g.tokens]
            keys, spent, covered, open_doc, open_at, before = [], [], [], [], [], 0
            for o in orders[1:]:
                level, total, own = g.levels[o - 1], totals[o - 1], owns[o - 1]
                history = np.append(totals[o - 2], law.documents)
                lower, share = share, law.kept(total, o) / np.maximum(1, history[level.first])
                seen = total[level.gram] > 0
                logs = np.where(seen, np.log10(np.maximum(share, 1e-300))[level.gram], logs)
                is_open = ~seen & (history[level.history] > 0)
                needs = np.zeros(len(history), bool)
                needs[level.history[is_open]] = True
                needs[level.first[own]] = True
                asked = np.flatnonzero(needs)
                keys.append(g.history_keys(o)[asked])
                spent.append(np.bincount(level.first[own], share[own], len(history))[asked])
                covered.append(np.bincount(level.first[own], lower[level.suffix[own]], len(history))[asked])
                place = np.zeros(len(history), np.int64)
                place[asked] = before + np.arange(len(asked))
                open_doc.append(g.doc[is_open])
                open_at.append(place[level.history[is_open]])
                before += len(asked)
            flat = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
            at = np.argsort(flat(keys, np.uint64))
            rank = np.empty(len(at), np.int32)
            rank[at] = np.arange(len(at))
            docs_here = len(g.n)
            of_doc = lambda per_token: np.bincount(g.doc, per_token, docs_here)
            yield batch(
                [(0, None, row["block"], None, None, row["doc_ids"], row["held"], g.n.tolist(), of_doc(totals[0][g.tokens] > 0).astype(np.int64).tolist(), of_doc(law.baseline(totals[0])[g.tokens]).tolist(), of_doc(logs).tolist(), squeeze(flat(open_doc, np.int32)), squeeze(rank[flat(open_at, np.int64)]))],
                shape_arrow,
            )
            if out := [(1, *c, *[None] * 8) for c in chunks(row["block"], flat(keys, np.uint64)[at], [flat(spent, np.float64)[at], flat(covered, np.float64)[at]], parts)]:
                yield batch(out, shape_arrow)

    whole = stored
    for o in orders:
        whole = with_replies(whole, table.where(f"not model and order = {o}").select("part", "block", "data"), f"order{o}")
    halves = base.stored(whole.mapInArrow(base.rested(resolve), shape), "resolved", "kind", compression="zstd")

    def weigh(keys, inverse, columns):
        spent, covered = (np.bincount(inverse, c, len(keys)) for c in columns)
        weight = np.maximum(1 - spent, 1e-300) / np.maximum(1 - covered, 1e-300)
        return weight[inverse], (pack(keys), weight.tobytes())

    weights = answers(halves.where("kind = 1").select("part", "block", "keys", "data"), [np.float64, np.float64], weigh, "histories binary, weights binary")
    weights = base.written(weights.withColumn("model", F.col("block").isNull()), f"{model_path}/weights", "model", compression="zstd")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            weight = np.log10(joined(row["weights"], np.float64))
            doc, at = expand(row["open_doc"], np.int32), expand(row["open_history"], np.int32)
            total = np.array(row["seen"]) + np.bincount(doc, weight[at], len(row["n"]))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(row["n"], pa.int64()), pa.array(row["n_known"], pa.int64()), pa.array(row["base"]), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    final = with_replies(halves.where("kind = 0").drop("kind", "part", "keys", "data"), weights.where("not model").select("part", "block", "data"), "weights")
    named = ", ".join(f"{o}: {name}" for o, (_, name) in zip(orders, laws, strict=True))
    return final.mapInArrow(base.rested(finish), RESULT).withColumns({"train_tokens": F.lit(int(law.tokens)).cast("long"), "discount": F.lit(named)})
