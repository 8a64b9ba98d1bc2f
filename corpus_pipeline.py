"""The corpus pipeline: raw documents to packed training sequences, one written table after another.

All stages but the last return the columns of their input, whatever further columns it has and however they are named.
Null texts are empty ones; rows with a null or a repeated id are documents of their own; empty tables stay empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import base, minmax, packing, quality, repeats, secrets
from riskloom.llm.queries import read, tokenizer_path

#: A document goes if its score for good quality is below this.
REJECT_BELOW = 0.5
MASK = "[SECRET]"
#: Stretches whose ids a worker remembers while packing: fewer than the operator's own default, since its workers have served all stages.
KEPT_STRETCHES = 200_000
#: (stage, where its result lies) for results that no later stage has replaced; each thread has its own.
_results: ContextVar[tuple[tuple[str, str], ...]] = ContextVar("results", default=())


def _stage(name: str) -> Callable:
    """A stage whose result is stored, so that Python gets bounded batches whatever the caller's session says.

    A stage's result is there for the next stage, or to be written elsewhere before the next stage is called: then it goes,
    but where the next stage reads that very table; in that case it goes after it. Calling the same stage again deletes nothing.
    """

    def wrap(stage: Callable) -> Callable:
        store = base.scoped(name, "zstd", lambda path: _results.set((*_results.get(), (name, path))))(stage)

        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            earlier, inputs = [x for x in _results.get() if x[0] != name], docs.inputFiles()
            read = [x for x in earlier if any(x[1] in f for f in inputs)]
            _forget(spark, [x for x in earlier if x not in read])
            out = store(spark, docs, sf_dir)
            _forget(spark, read)
            return out

        return run

    return wrap


def _forget(spark: SparkSession, results: list[tuple[str, str]]) -> None:
    base.drop(spark, [path for _, path in results])
    _results.set(tuple(x for x in _results.get() if x not in results))


@_stage("quality")
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the compression classifier rejects go. A null text is rated as an empty one."""
    rate = quality.goodness(quality.fit(docs, read(spark, sf_dir, "labels")))
    return docs.where(rate(F.col("text")) >= REJECT_BELOW)


@_stage("near_duplicates")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies (five words, similarity of 0.8 or more) stays.

    Each stored row is a document of its own, whatever its id. Of a group the smallest id stays, null ids last, and of
    rows with one id the first. Rows without words are nobody's copies and all stay. Texts stay where they lie but for
    those that go, and the few that a bitmap of fixed size takes for such.
    """
    rows = base.stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n"), F.col("doc_id").alias("id")), "rows", compression="zstd")
    found = minmax.near_duplicates(rows.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text")), percent=80)
    found = found.select(F.col("doc_id").alias("n"), "component_id").join(rows.select("n", "id"), "n")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "n"))["n"].alias("stays"), F.count("*").alias("size")).where("size > 1")
    gone = base.stored(found.join(stays, "component_id").where("n != stays").select("n"), "gone")
    may_go = base.KeyFilter(gone)
    return rows.where(~may_go("n")).select("row.*").union(rows.where(may_go("n")).join(gone, "n", "left_anti").select("row.*"))


@_stage("substrings")
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: runs of words that repeat are cut out of the texts; every document stays, if only with an empty text."""
    return repeats.without_repeats(docs)


@_stage("secrets")
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: secrets are masked; every document stays."""
    return secrets.masked(docs, secrets.fit(docs), MASK)


@_stage("packing")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of documents in sequences of at most 1,024 tokens; a null text is packed as its end token."""
    pieces, _ = packing.packed(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, size=1024, kept=KEPT_STRETCHES)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_filter), ("near duplicates", near_duplicates), ("substrings", substrings), ("secrets", secret_scan), ("packing", pack)]

#: SQL cannot express compression, permutation hashing or tokenizers.
ORACLE_SQL = None


@base.scoped("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage stores its result as Parquet, which the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
