"""The compression classifier: its split, held-out accuracy, odd texts, few labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import base, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


@pytest.fixture(scope="module")
def fitted(tables):
    docs, labels = tables
    return docs, labels, quality.fit(docs, labels)


def test_held_out_documents(spark, fitted):
    docs, labels, _ = fitted
    rows = queries.op9_quality(spark, SF).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(held) > 50 and auc > 0.95
    assert np.mean(np.array(good) >= 0.5) > 0.9 and np.mean(np.array(bad) < 0.5) > 0.8


def test_scores_are_compressed_sizes(spark, fitted):
    """Each score is the curve over the two compressed sizes, counted once more by hand."""
    docs, _, model = fitted
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.limit(60), model).collect()}
    good, bad = model.compressors()
    for r in docs.limit(60).collect():
        raw = (r["text"] or "").encode()
        g, b = (sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)) for c in (good, bad))
        x = np.array([(b - g) / len(raw), (b - g) / (b + g)]) if raw else np.zeros(2)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(x @ model.weights[:2] + model.weights[2]))), rel=1e-9)


def test_held_out_labels_teach_nothing(fitted):
    docs, labels, model = fitted
    flipped = labels.withColumn("quality", F.when(base.remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.fit(docs, flipped)
    assert other.good == model.good and other.bad == model.bad and (other.weights == model.weights).all()


def test_odd_texts_and_clashing_columns(spark, fitted):
    *_, model = fitted
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "word " * 200_000, 3), (3, "é" * 700, 4)], "doc_id long, text string, score int").withColumn("a.b", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert got[1] == got[2] == pytest.approx(1 / (1 + np.exp(-model.weights[2]))) and all(0 <= x <= 1 for x in got.values())
    assert quality.score(docs.limit(0), model).count() == 0


def test_few_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(40)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(i, 1, 0) for i in range(20)]):
        assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels(rows))).collect()} == {0.5}
    some = [(i, i % 2, 0) for i in range(6)] + [(8, 0, 0), (8, 1, 0), (None, 1, 0), (9, None, 0)]
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, quality.fit(docs, labels(some))).collect())
