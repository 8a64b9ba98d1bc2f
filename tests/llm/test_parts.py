"""Parts that several operators share: components, key filters, plans of cutting, window hashes, written pages."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from riskloom.llm import base, cutting, repeats, token_files
from riskloom.llm.components import components
from riskloom.llm.queries import tokenizer_path


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(5, x) for x in range(200, 400)] + [(7, 7), (9, 8), (8, 9), (8, 9)] + [(r.randrange(3000, 3200), r.randrange(3000, 3200)) for _ in range(150)] + [(None, 4), (4, None)]
    group = {x: {x} for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    for a, b in links:
        if a in group and b in group and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    got = [tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, min(g)) for x, g in group.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_filter_lets_all_keys_through(spark):
    keys = spark.createDataFrame([(i * 7, None if i % 5 == 0 else f"k{i}") for i in range(500)], "x long, y string")
    some = base.KeyFilter(keys, bits=16)
    assert keys.where(~some("x", "y")).isEmpty()
    others = spark.range(100_000, 110_000).selectExpr("id as x", "'z' as y")
    assert others.where(some("x", "y")).count() < 200
    assert spark.range(10).where(base.KeyFilter(keys.limit(0), bits=10)("id", "id")).isEmpty()


def test_plan_is_near_the_bound_and_sound():
    r = np.random.default_rng(3)
    for histogram in ({int(l): int(n) for l, n in enumerate(r.integers(0, 4000, 129)) if l}, {100: 5000, 28: 4000, 3: 10}, {65: 1000}, {128: 7}, {1: 3}, {}):
        plan = cutting.plan(histogram, 128)
        fill, total = {}, 0
        for length, rows in plan.segments.items():
            for _, per, times, start, _ in rows:
                for s in range(start, start + times):
                    fill[s] = fill.get(s, 0) + per * length
        for length, places in plan.rest.items():
            placed = sum(per * times for _, per, times, *_ in plan.segments.get(length, []))
            assert placed + len(places) == histogram[length]
            for where in filter(None, places):
                fill[where[0]] = fill.get(where[0], 0) + length
        total = sum(fill.values())
        assert all(n <= 128 for n in fill.values()) and len(fill) == plan.sequences
        if len(histogram) > 5:  # rounding costs less than a sequence for each length beyond what the program asks
            use = cutting.relaxed(np.array(sorted(histogram)), np.array([float(histogram[l]) for l in sorted(histogram)]), 128, 0.002)[1]
            assert total / 128 <= plan.sequences <= use.sum() + 128
            assert sum(len([w for w in x if w is None]) for x in plan.rest.values()) <= 2 * 128


def test_pricing_and_relaxation_against_brute_force():
    r = random.Random(5)
    for _ in range(20):
        size = r.randint(6, 14)
        values = np.array([-1.0] + [r.choice([-1.0, r.random() * l]) for l in range(1, size + 1)])

        def best(room, most):
            return max([0.0, *(values[l] + best(room - l, l) for l in range(1, min(room, most) + 1) if values[l] > 0)])

        value, counts = cutting.price(values, size)
        assert value == pytest.approx(best(size, size)) and counts @ np.arange(size + 1) <= size
        assert sum(values[l] * n for l, n in enumerate(counts) if n) == pytest.approx(value)
    # No pattern has a reduced cost left where the relaxation ends by itself.
    lengths, counts = np.array([3, 5, 7]), np.array([30.0, 20.0, 11.0])
    patterns, use = cutting.relaxed(lengths, counts, 16, 0.0)
    assert (use @ patterns == pytest.approx(counts)) and (patterns @ lengths <= 16).all()
    dual = np.linalg.solve(patterns.astype(float), np.ones(3))
    full = np.full(17, -1.0)
    full[lengths] = dual
    assert cutting.price(full, 16)[0] <= 1 + 1e-6 or use.sum() == pytest.approx((lengths * counts).sum() / 16)


def test_equal_hashes_with_other_words_are_other_windows():
    keys = np.array([5, 5, 5, 9, 9], np.uint64)
    inverse = np.unique(keys, return_inverse=True)[1]
    checks, n = np.array([1, 2, 1, 3, 4], np.uint64), np.array([1, 1, 1, 1, 2])
    assert repeats.repeated(inverse, n, checks).tolist() == [True, False, True, False, True]
    assert repeats.repeated(inverse[:0], n[:0], checks[:0]).tolist() == []


def test_pages_of_token_files(spark, tmp_path):
    """Version 2 pages, dictionaries, page indexes, bounded row groups; metadata are a small part of a file."""
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300))) for i in range(900)], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), row_group_bytes=1 << 20, page_rows=50)
    files = sorted((tmp_path / "files").glob("*.parquet"))
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.format_version.startswith("2") or meta.num_row_groups >= 1
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(v for k, v in columns.items() if k.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings) or "DELTA_BINARY_PACKED" in ids.encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert columns["doc_id"].statistics.max >= columns["doc_id"].statistics.min
            assert columns["n_tokens"].total_compressed_size < ids.total_compressed_size
    plan = token_files.read_token_files(spark, path, ["n_tokens"], ids_from=10, ids_to=20)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,10)" in plan


def test_many_rows_of_one_id_are_dealt_out(spark, tmp_path):
    docs = spark.range(4000).selectExpr("7 as doc_id", "cast(id as string) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(docs, str(tmp_path / "one"), tokenizer_path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_files.read_token_files(spark, str(tmp_path / "one"), ["shard"]).groupBy("shard").count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 3000
