"""Compression classifier for text quality (operator 9).

A zstandard dictionary is built from texts labelled good and another from texts labelled bad. A text is cut into
blocks; each block is compressed with either dictionary, and the difference of the summed sizes, once over the
text's bytes and once over the compressed bytes, is turned into a probability by a logistic curve fitted on
labelled texts that no dictionary has seen, weighted to the share of both classes among all labels.

Nulls and ties: a null or empty text has zero differences and gets the curve's score there; a null id takes part
with the remainder of the text "null"; a document with contradictory labels teaches nothing; repeated rows get
equal scores. A class without any labelled text leaves nothing to compare: all scores are then 0.5. Only the id and
the text are read. A class with so few texts that zstandard trains no dictionary has its texts' last bytes as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from . import base

#: Bytes of a block, of a dictionary, and zstandard's level.
BLOCK, DICTIONARY, LEVEL = 512, 112_640, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            options = {}
            if raw:  # a class without texts has no dictionary
                options["dict_data"] = known = zstandard.ZstdCompressionDict(raw)
                known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, **options))
        return out


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def differences(parts: list[bytes], good, bad) -> tuple[float, float]:
    """How much smaller a text's blocks are with the good dictionary: per byte, and per compressed byte."""
    if not parts:
        return 0.0, 0.0
    g, b = sum(len(good(x)) for x in parts), sum(len(bad(x)) for x in parts)
    return (b - g) / sum(map(len, parts)), (b - g) / (b + g)


@F.arrow_udf(ArrayType(BinaryType()))
def some_blocks(texts: pa.Array, most: pa.Array) -> pa.Array:
    """At most ``most`` blocks of each text, evenly spread over the whole of it."""
    out = []
    for text, n in zip(base.text_bytes(texts), most.to_pylist(), strict=True):
        parts = blocks(text)
        out.append([parts[i] for i in np.linspace(0, len(parts) - 1, min(n, len(parts))).astype(int)])
    return pa.array(out, pa.list_(pa.binary()))


def dictionary(source: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY bytes: zstandard's, or the blocks' last bytes where zstandard finds nothing
    that repeats or has less to read than a dictionary holds."""
    try:
        return zstandard.train_dictionary(DICTIONARY, source).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(source)[-DICTIONARY:]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 20)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_blocks: int = 64, held_out_by: int = 4, held_out: int = 2) -> Model:
    """Fits on at most ``sample_rows`` labelled documents of each class, those with the smallest hashes of ids, and on at
    most ``sample_blocks`` blocks of each, spread over its whole text.

    Rows whose crc32(doc_id) modulo ``held_out_by`` is ``held_out`` are never read as labels. The sample, at most
    8,000 * 64 * 512 bytes, is all that comes to the driver.
    """
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (base.remainder("doc_id", held_out_by) != held_out))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where(F.col("quality") == F.col("other")).select("doc_id", "quality")
    )
    share = {r["quality"]: r["n"] for r in agreed.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = None
    for q in (1, 0):
        one = agreed.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = one if picked is None else picked.unionByName(one)
    rows = base.texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = rows.select("doc_id", "quality", some_blocks("text", F.lit(sample_blocks)).alias("blocks")).collect()
    rows = sorted(((r["quality"], r["doc_id"], [bytes(x) for x in r["blocks"]]) for r in rows), key=lambda r: (r[0], r[1]))
    one, other = ([t for q, _, t in rows if q == k] for k in (1, 0))
    built, seen = [], []
    for side in (one, other):  # every third text is kept for the curve
        built.append(dictionary([x for i, t in enumerate(side) if i % 3 for x in t]))
        seen.append([t for i, t in enumerate(side) if i % 3 == 0])
    if not (seen[0] and seen[1]):
        return Model(b"", b"", np.zeros(3))
    model = Model(*built, np.zeros(3))
    good, bad = (c.compress for c in model.compressors())
    x = np.array([differences(t, good, bad) for side in seen for t in side])
    y = np.repeat([1.0, 0.0], [len(seen[0]), len(seen[1])])
    total = share[1] + share[0]
    weight = np.repeat([share[1] / total / len(seen[0]), share[0] / total / len(seen[1])], [len(seen[0]), len(seen[1])])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    model.weights = fit_curve(x / scale, y, weight) / np.append(scale, 1)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the calibrated probability that a whole text is good."""
    return docs.select(F.col(id_col).alias("doc_id"), goodness(model)(F.col(text_col)).alias("score"))


def goodness(model: Model) -> Callable[[Column], Column]:
    """A column function: the score of each text."""

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good, bad = (c.compress for c in model.compressors())
        for texts in batches:
            x = np.array([differences(blocks(t), good, bad) for t in base.text_bytes(texts)]).reshape(-1, 2)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ model.weights[:2] + model.weights[2], -35, 35))))

    return rate
