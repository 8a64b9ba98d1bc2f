"""Spelling variants against all pairs of words, on a small corpus with planted variants, ties, chains and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm import queries, variants

LETTERS = "abcdefghijklmnopqrstuvwxyzéßÉ÷ÿ"


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least_length, least_count, ratio, every):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    form, around = {}, {}
    for w in n:
        around[w] = [x for x in n if near(w, x)]
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(around[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def found(spark, rows, schema="doc_id long, text string", **options):
    got = variants.variants(spark.createDataFrame(rows, schema), **options).select("word", "n", "n_near", "form", "form_n", "root")
    return sorted(tuple(r) for r in got.collect())


def planted():
    r = random.Random(3)
    words = ["".join(r.choice(LETTERS) for _ in range(r.randint(4, 9))) for _ in range(40)]
    words += ["aabbcc", "aaabbcc", "aabbc", "abcabc", "abcacb", "bacabc", "xaabbcc", "kkkkkk", "kkkkkkk", "kkkkkkkk", "listen", "silent", "enlist"]
    pool = []
    for k, w in enumerate(words):
        pool += [w] * (5 ** (k % 4))
        for _ in range(6):
            at, c = r.randrange(len(w) + 1), r.choice(LETTERS)
            pool += [r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])] * r.choice([1, 2, 5, 6, 25])
    pool += ["chainp"] * 8 + ["chainpq"] * 70 + ["chainpqr"] * 600
    r.shuffle(pool)
    rows = [(i, " ".join(x.upper() if r.random() < 0.1 else x for x in pool[i::30])) for i in range(30)]
    return [*rows, (None, "silent " * 7), (3, None), (4, ""), (5, "12 _ . "), (6, rows[6][1]), (6, rows[6][1])]


@pytest.mark.parametrize(("least_length", "least_count", "every"), [(6, 5, 199), (1, 1, 3)])
def test_like_all_pairs(spark, least_length, least_count, every):
    rows = planted()
    got = found(spark, rows, least_length=least_length, least_count=least_count, every=every)
    assert got == plain(rows, least_length, least_count, 5, every)
    assert any(g[5] not in (g[0], g[3]) for g in got if g[3])  # a chain of two forms


def test_all_words_one_letter_from_each_other(spark):
    """Groups of words with the same letters, and of words that all are near each other."""
    rows = [(i, f"{a}{b}cdef {b}a{a}cde") for i, (a, b) in enumerate([(a, b) for a in variants.LOWER for b in variants.LOWER])]
    assert found(spark, rows, least_count=1) == plain(rows, 6, 1, 5, 199)


def test_long_runs(spark):
    r = random.Random(5)
    long = "ab" * 10_000
    words = [long, long[:500] + long[501:], long[:-1] + "c", long[:17_000] + "É" + long[17_001:]]
    for size in (63, 64, 65, 66, 200):
        w = "".join(r.choice("abÉ") for _ in range(size))
        for _ in range(12):
            at, c = r.randrange(size + 1), r.choice("abÉz")
            words += [w, w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:-1] + "z"]
    words += ["x" * k for k in range(60, 70)] + ["q" * 100 + "x" * k for k in range(5)]
    rows = [(i, " ".join(words[i::3])) for i in range(3)]
    assert found(spark, rows, least_count=1, every=10**9) == plain(rows, 6, 1, 5, 10**9)


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    rows = [(i, "listen listem", "n", 1) for i in range(9)]
    assert found(spark, rows, "doc_id long, text string, word string, n int", every=10**9) == [("listem", 9, 1, None, None, "listem"), ("listen", 9, 1, None, None, "listen")]
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_query_like_all_pairs_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = queries.op11_variants(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == plain(rows, 6, 5, 5, 199)
