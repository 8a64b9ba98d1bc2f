"""The queries opN_<name> of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, counts, descent, hnsw, infill, katz, minmax, oracles, packing, pieces, quality, repeats, secrets, token_files, variants


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@base.scoped("op1_pieces")
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@base.scoped("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.new_path(spark, "token_files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    metadata = token_files.read_token_files(spark, path, ["shard", "n_tokens"])
    rows = token_files.with_starts(token_files.with_crc(token_files.read_token_files(spark, path)), metadata)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = katz.scored(read(spark, sf_dir, "documents"), base.remainder("doc_id", 10) == 0, base.new_path(spark, "katz"), order=2)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "discount")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = packing.packed(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, size=1024)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_runs(repeats.hashed_texts(read(spark, sf_dir, "documents")), window=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 20 = 0"), n=20)


def op7_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


@base.scoped("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.findings(docs, secrets.fit(docs)).select("doc_id", "n_candidates", "n_secrets", "secrets")


@base.scoped("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    rated = quality.score(docs, model)
    return rated.select("doc_id", (base.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@base.scoped("op12_infill")
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.restored(infill.transformed(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


@base.scoped("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Of the operators whose results are whole numbers, texts and flags. Encoders, compression, forests and packing cannot be
    said in SQL; the sums of logarithms and products of op3 and op6 depend on the order of addition in their last bits."""
    return {"op5_substrings": oracles.SUBSTRINGS, "op7_minmax_near_duplicates": oracles.NEAR_DUPLICATES, "op10_nn_descent": oracles.NEAR_VECTORS, "op11_variants": oracles.VARIANTS, "op12_infill": oracles.INFILL}
