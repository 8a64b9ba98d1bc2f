import itertools

import numpy as np

from riskloom.llm import descent


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and np.isfinite(v).all() and np.any(v)]
    out = {i: [0, i] for i, _ in rows}
    group = {i: {i} for i, _ in rows}
    for a, v in ok:
        for b, w in ok:
            if a != b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                out[a][0] += 1
                if group[a] is not group[b]:
                    group[a] |= group[b]
                    for x in group[b]:
                        group[x] = group[a]
    return sorted((i, n, min(group[i]), i == min(group[i])) for i, (n, _) in out.items())


def near(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<double>, node int").repartition(3)
    return df, descent.near_vectors(df, **options)


def test_like_brute_force(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 16))
    data[100:220] = data[7] + rng.normal(size=(120, 16)) * 0.05  # a group far larger than a list
    data[300:340] = data[11] * rng.uniform(0.5, 3, size=(40, 1))
    data[400:420] = data[12]
    data[500:520] = data[530:550] + rng.normal(size=(20, 16)) * 0.08
    rows = list(enumerate(data)) + [(1000, None), (1001, np.zeros(16)), (1002, np.full(16, np.inf)), (1003, np.ones(4)), (1004, np.ones(4)), (1005, [])]
    df, out = near(spark, rows, tile=50, block=64)
    out = out.persist()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect())
    want = brute(rows)
    assert got == want
    assert descent.recall(df, out, every=7) == 1
    assert out.first()["audit_recall"] == 1


def test_few_rows_and_none(spark):
    assert near(spark, [])[1].count() == 0
    assert [tuple(r) for r in near(spark, [(4, [1.0, 0.0])])[1].collect()] == [(4, 0, 4, True, 1.0)]


def components_of(batch):
    group = {i: {i} for i in batch["node"].to_pylist()}
    for a, b in zip(batch["node"].to_pylist(), batch["link"].to_pylist(), strict=True):
        if b is not None and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {i: min(g) for i, g in group.items()}


def test_each_meeting_reports_all_its_components():
    angles = np.radians([0, 17, 34, 51])
    for order in itertools.permutations(range(4)):
        data = np.array([[np.cos(a), np.sin(a)] for a in angles[list(order)]])
        out = descent.compared(np.arange(4), data, 8, 0.95)
        assert set(components_of(out).values()) == {0}
        assert out["link"].null_count == 1
    angles = np.radians([0, 17, 34, 90, 107, 180])
    out = descent.compared(np.arange(6), np.array([[np.cos(a), np.sin(a)] for a in angles]), 8, 0.95)
    assert components_of(out) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_chains_and_bridged_groups_exactly(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):  # chains of 2 to 9 members in planes of their own, in which only neighbours are linked
        for j in rng.permutation(2 + c % 8):
            v = np.zeros(80)
            v[2 * c : 2 * c + 2] = np.cos(np.radians(17 * j)), np.sin(np.radians(17 * j))
            rows.append((len(rows), v))
    for side in (0, 34):  # two groups of near copies and one vector between them
        v = np.zeros(80)
        v[60], v[61] = np.cos(np.radians(side)), np.sin(np.radians(side))
        rows += [(len(rows) + i, v + rng.normal(size=80) * 0.001) for i in range(10)]
    v = np.zeros(80)
    v[60], v[61] = np.cos(np.radians(17)), np.sin(np.radians(17))
    rows.append((len(rows), v))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near(spark, rows)[1].collect())
    assert got == brute(rows)


def test_lists_grow_and_a_hub_is_not_gathered(spark):
    """Two groups of 40 near copies whose only link is between two of their members, and a vector that all others are nearest to."""
    rng = np.random.default_rng(11)
    rows = []
    for side in (0, 21.5):
        v = np.zeros(30)
        v[0], v[1] = np.cos(np.radians(side)), np.sin(np.radians(side))
        rows += [(len(rows) + i, v + np.r_[np.zeros(2), rng.normal(size=28) * 0.004]) for i in range(40)]
    for at in (4, 17.5):
        v = np.zeros(30)
        v[0], v[1] = np.cos(np.radians(at)), np.sin(np.radians(at))
        rows.append((len(rows), v))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near(spark, rows, k=4)[1].collect())
    assert got == brute(rows)
    graph = spark.createDataFrame([(i, 4, [(-0.99, j) for j in range(4)]) for i in range(3)] + [(9, 4, [(-0.5, 1)])], "node long, k int, near array<struct<d:double,node:long>>")
    assert {r["node"]: r["k"] for r in descent.lengthened(graph, 6, 0.95).collect()} == {0: 6, 1: 6, 2: 6, 9: 4}
