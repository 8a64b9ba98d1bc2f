import numpy as np

from riskloom.llm import hnsw


def brute(rows, queries, n):
    out = {}
    for q, v in queries:
        if v is None or not len(v) or not np.isfinite(v).all() or not np.any(v):
            continue
        scored = [(-float(np.dot(v, w)), i) for i, w in rows if i != q and w is not None and len(w) == len(v) and np.isfinite(w).all() and np.any(w)]
        out[q] = [(i, -s) for s, i in sorted(scored)[:n]]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = hnsw.nearest(df, df.where("vec_id % 5 = 0"), n=20, **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, size=(1500, 1))
    vectors[200:300] = vectors[10]
    rows = list(enumerate(vectors)) + [(2000, None), (2005, np.zeros(24)), (2010, np.full(24, np.nan)), (2015, np.ones(3)), (2020, np.array([]))]
    got, want = found(spark, rows, shard_rows=500), brute(rows, [r for r in rows if r[0] % 5 == 0], 20)
    assert 2000 not in got and 2005 not in got and 2015 not in got
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want if want[q])
    assert hits / sum(map(len, want.values())) >= 0.95
    by = dict(rows)
    for q, answer in got.items():
        assert [(-s, i) for i, s in answer] == sorted((-s, i) for i, s in answer)
        assert all(abs(s - np.dot(by[q], by[i])) < 1e-9 for i, s in answer)
    assert [i for i, _ in got[205]][:20] == [i for i, _ in want[205]][:20]


def test_few_rows_and_none(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]) == {0: [(1, 1.0)]}
    assert found(spark, []) == {}


def clustered(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(groups, dims)) * 3
    return means[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.5


def test_audited_visits_reach_the_recall(spark):
    for data in (clustered(3000, 16, 12, 5), np.random.default_rng(6).normal(size=(3000, 16))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(4).persist()
        asked = df.where("vec_id % 20 = 0")
        got = hnsw.nearest(df, asked, n=20, shard_rows=300).persist()
        assert hnsw.recall(df, got, asked) >= 0.93
        want = brute(list(enumerate(data)), [(i, data[i]) for i in range(0, 3000, 20)], 20)
        found = {(r["query_id"], r["vec_id"]) for r in got.collect()}
        assert sum((q, i) in found for q, x in want.items() for i, _ in x) / (150 * 20) >= 0.93
    # In the clustered data a few centroids hold the neighbours.
    data = clustered(3000, 16, 12, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, vector array<double>")
    means = hnsw.centroids(df, 10, 3000)
    assert hnsw.visits(df, df.where("vec_id % 20 = 0"), means, 20, 100, 0.97) < 10


def test_index_is_flat_arrays(spark):
    data = clustered(700, 8, 3, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, vector array<double>")
    index = hnsw.build(df, 20, hnsw.centroids(df, 2, 700), 200, 8, 48).collect()
    assert sum(len(r["ids"]) for r in index) == 700 and len(index) >= 4
    for r in index:
        n = len(r["ids"])
        assert len(r["vectors"]) == 8 * n and len(r["levels"][0]) == 16 * n and all(len(x) == 8 * n for x in r["levels"][1:])
        graph = hnsw.Graph.stored(np.array(r["vectors"]).reshape(n, 8), [np.array(x, np.int32) for x in r["levels"]])
        nodes, _ = graph.nearest(data[:1], 48)
        assert set(nodes[nodes >= 0].tolist()) <= set(range(n))
