import re
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from riskloom.llm import base, katz, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

def tokens_of(text):
    return [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, order):
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    split = [tokens_of(t) for _, t in rows]
    padded = [["^"] * (order - 1) + w for w in split]
    grams = lambda w, o: [tuple(w[i - o + 1 : i + 1]) for i in range(order - 1, len(w))]
    counts = [Counter(g for h, w in zip(held, padded, strict=True) if not h for g in grams(w, o)) for o in range(1, order + 1)]
    total, distinct = sum(counts[0].values()), len(counts[0])
    d = [katz.discounts([sum(c == r for c in n.values()) for r in range(1, 7)])[0] for n in counts]
    kept = lambda c, o: c * d[o - 1][c] if c <= 5 else c - katz.TRIFLE
    unknown = 1 - sum(kept(c, 1) for c in counts[0].values()) / total
    after = [defaultdict(dict) for _ in range(order)]
    for o in range(2, order + 1):
        for g, c in counts[o - 1].items():
            after[o - 1][g[:-1]][g[-1]] = c
    weights = {}

    def p(history, w):
        o = len(history) + 1
        if o == 1:
            return kept(counts[0][w,], 1) / total if counts[0][w,] else unknown
        seen = after[o - 1].get(history)
        if seen is None:
            return p(history[1:], w)
        if w in seen:
            return kept(seen[w], o) / sum(seen.values())
        if history not in weights:
            weights[history] = (1 - sum(p(history, x) for x in seen)) / (1 - sum(p(history[1:], x) for x in seen))
        return weights[history] * p(history[1:], w)

    for o in range(2, order + 1):
        for history in list(after[o - 1])[:4]:  # exactly normalised, one unknown word included
            assert sum(p(history, w) for (w,) in counts[0]) + p(history, "unknown!") == pytest.approx(1, abs=1e-12)
    out = []
    for (i, _), h, w, full in zip(rows, held, split, padded, strict=True):
        base_score = sum(log10((counts[0][x,] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out.append((str(i), h, len(w), sum(counts[0][x,] > 0 for x in w), total, base_score, sum(log10(p(g[:-1], g[-1])) for g in grams(full, order))))
    return sorted(out)


def score(spark, rows, order=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = katz.scored(docs, base.remainder("doc_id", 10) == 0, base.new_path(spark, "test_katz"), order)
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect())


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_like_brute_force(spark, corpus, order):
    got, want = score(spark, corpus, order), brute(corpus, order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_laws():
    assert katz.discounts([1000, 400, 200, 120, 80, 55])[1] == "turing"
    d, name = katz.discounts([1000, 200, 300, 120, 80, 255])
    assert name == "smoothed" and (d[1:] > 0).all() and (d[1:] < 1).all()
    assert katz.discounts([0, 0, 0, 0, 0, 0])[1] == katz.discounts([5, 0, 0, 0, 0, 0])[1] == "absolute"


def test_nothing_to_learn_from_and_empty(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert score(spark, [(only, "a b")])[0][2:] == (3, 0, 0, 0.0, 0.0)
    assert score(spark, []) == []


def test_registered_query_like_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()]
    out = queries.op3_katz(spark, sf).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out)
    want = brute(rows, 2)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    (used,) = {r["discount"] for r in out}
    assert used
