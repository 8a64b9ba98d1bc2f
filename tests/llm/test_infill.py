"""Fill-in-middle outputs against plain slices, and the way back from each of them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import infill
from riskloom.llm.infill import Rope, Units, joined, split_points

ODD = ["", "x", "ab", "<P>", "a<S>b", "<", "P><S", "é" * 1025, "日本語 テキスト" * 300, "😀x" * 700, "\n\n a\tb \r\n", "a" * 512, "b" * 513, "<<P", "word " * 2000, "z" * 300_000]


def plain(i, text, rate=90, spm=20):
    text = text or ""
    digits = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    out = ("spm", f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < spm else ("psm", f"<P>{x}<S>{z}<M>{y}")
    return i, n, out[0], a, b - a, out[1]


def key(row):
    return repr(row)


def test_outputs_and_way_back(spark, corpus):
    rows = corpus + [(1000 + 50 * k + j, t) for k, t in enumerate(ODD) for j in range(12)] + [(None, "null id"), (7, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, output string, h1 int").repartition(4)
    got = infill.restored(infill.transformed(docs)).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_words_as_units(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = infill.restored(infill.transformed(docs, unit=r"\w+", rate=100)).collect()
    texts = {}
    for i, t in corpus:
        texts.setdefault(i, set()).add(t or "")
    for r in got:
        text = r["restored"]
        assert text in texts[r["doc_id"]]
        words = [m.start() for m in Units(r"\w+").pattern.finditer(text)]
        assert r["n"] == (max(len(words), 1) if text else 0)
        if r["form"] != "plain":
            borders = [0, *words[1:], len(text)]
            assert r["prefix_chars"] == borders[r["prefix_units"]]
            assert r["prefix_chars"] + r["middle_chars"] == borders[r["prefix_units"] + r["middle_units"]]


@pytest.mark.parametrize("pattern", [None, r"\S+", "[^\n]*\n?"])
def test_splits_at_every_rank(pattern):
    r = random.Random(1)
    text = "".join(r.choice("ab é\n😀") for _ in range(1700))
    units = Units(pattern)
    rope = units.rope(text)
    assert str(rope) == text and rope.points == len(text)
    before = -1
    for rank in range(rope.units + 1):
        a, b = units.split(rope, rank)
        assert str(a) + str(b) == text and (a.units, b.units) == (rank, rope.units - rank)
        assert len(str(a)) == a.points > before or rank == 0
        before = a.points
        again, _ = units.split(joined(a, b), rank)
        assert str(again) == str(a)
    for at in (0, 1, 511, 512, 513, 1699, 1700):
        a, b = split_points(rope, at)
        assert (str(a), str(b)) == (text[:at], text[at:])


def test_depth_stays_small():
    rope = Units().rope("x" * 200_000)
    depth = lambda r: 0 if r.left is None else 1 + max(depth(r.left), depth(r.right))
    assert depth(rope) <= 10
    a, b = Units().split(rope, 77_777)
    assert depth(a) <= 10 and depth(b) <= 10
    assert isinstance(joined(), Rope) and str(joined()) == ""


def test_empty_table_and_unusable_marks(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restored(infill.transformed(docs)).select(F.count("*")).first()[0] == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "a", "b"), ("a", "ab", "c")):
        with pytest.raises(ValueError):
            infill.transformed(docs, marks=marks)
