"""Token counts against the tokenizers library, with any table of frequent pre-tokens."""

from collections import Counter

import pytest

from riskloom.llm import base, counts, queries
from riskloom.llm.queries import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
ODD = [
    "", " ", "  \n\n  a", "A  b\t\nc", "it's we'll don't 'S", "naïve Ünïcode café²½", "x" * 3000, "1234 56,78!", "日本語 テキスト。", "a b c", "é́ mixed", "..  ..", "a" + " b" * 3000, "<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "<|endoftext|", "😀 ok 👍🏽",
    "\x1c\x1d\x85 x", "𝔘nicode ⅷ ٣", "tab\there \x0b\x0c\r\n", "한국어 텍스트", "﻿bom", "word " * 40_000, "漢字" * 30_000, "͸Ᲊ new",
]


def want(rows, limit):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(VOCABULARY))
    out = []
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        out.append((i, len((t or "").encode()), n, n > limit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [counts.FREQUENT, 20, 1])
def test_like_the_library(spark, corpus, frequent):
    rows = corpus + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, n_tokens string, n_bytes int").repartition(5)
    got = counts.token_counts(docs, tokenizer_path(VOCABULARY), limit=100, frequent=frequent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want(rows, 100)


def test_pre_tokens_are_the_library_s_on_sure_characters():
    work = counts.library(tokenizer_path(VOCABULARY))
    sure = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not counts.UNSURE.search(c)]
    assert len(sure) > 30_000
    for at in range(0, len(sure), 500):
        text = "\n".join(f"a{c}1{c}!{c}a {c}{c} '{c}" for c in sure[at : at + 500])
        theirs = [text[i:j] for _, (i, j) in work.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert theirs == counts.PRE_TOKEN.findall(text)


def test_stretches_cut_where_no_token_crosses():
    text = "ab  cd\n\nef, gh " * 60
    for size in (1, 7, 64):
        parts = list(counts.stretches(text, size))
        assert "".join(parts) == text
        assert sum((counts.PRE_TOKEN.findall(p) for p in parts), []) == counts.PRE_TOKEN.findall(text)
    assert list(counts.stretches("x" * 100, 10)) == ["x" * 100] and list(counts.stretches("")) == []


def test_summaries_keep_what_is_frequent(spark):
    found = Counter({f"w{i}": 1 for i in range(500)}) + Counter({"the": 900, "of": 400})
    few = counts.thinned(found, 10)
    assert len(few) <= 10 and few["the"] >= 899 and few["of"] >= 399
    assert counts.thinned(found, 1000) is found
    docs = spark.createDataFrame([(i, "the the of " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(400)], "doc_id long, text string").repartition(7)
    merged = counts.frequent_words(base.texts(docs), 50)
    assert len(merged) <= 50 and {"the", " the", " of"} <= set(merged)


def test_empty_table_and_other_vocabularies(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert counts.token_counts(docs, tokenizer_path(VOCABULARY)).collect() == []
    with pytest.raises(ValueError):
        counts.library(tokenizer_path("word_bpe_49k.json"))


def test_registered_query_like_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_token_counts(spark, sf).collect()), key=repr) == want(rows, 1024)
