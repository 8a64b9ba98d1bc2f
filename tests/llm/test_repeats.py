import hashlib
import re
from collections import Counter

import pytest

from riskloom.llm import repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    split = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "k"), [(35, 8), (12, 5), (3, 8)])
def test_like_brute_force(spark, corpus, window, k):
    docs = spark.createDataFrame([(i, t, "x") for i, t in corpus], "doc_id long, text string, h string").repartition(5)
    found = repeats.repeated_runs(repeats.hashed_texts(docs), window, k)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()]
    order = lambda x: (x[0] is None, x)
    assert sorted(got, key=lambda x: (str(x[0]), *x[1:])) == sorted(brute(corpus, window), key=lambda x: (str(x[0]), *x[1:]))
    assert sum(x[2] for x in got) > 0


def test_paths_are_repeated_and_cuts_leave_the_rest(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    rows = repeats.repeated_runs(repeats.hashed_texts(docs), with_paths=True).collect()
    texts = {(i, t) for i, t in corpus}
    heads = Counter(p["head"] for r in rows for p in r["paths"])
    assert heads and min(heads.values()) > 1
    cut = {(r["doc_id"], r["text"]) for r in repeats.without_repeats(docs.withColumn("h", docs.doc_id)).select("doc_id", "text").collect()}
    want = {d: n for d, _, n, _ in brute(corpus, 35)}
    assert {x for x in cut if not want[x[0]]} == {x for x in texts if not want[x[0]]}
    assert all(len((t or "").split()) <= 6000 for _, t in cut)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated_runs(repeats.hashed_texts(docs)).count() == 0
    assert repeats.without_repeats(docs).count() == 0
