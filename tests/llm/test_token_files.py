"""Token files against the tokenizers library: ids, order, starts, selective reads and odd tables."""

import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import base, token_files
from riskloom.llm.queries import tokenizer_path
from riskloom.llm.vocabulary import Encoder

ODD = ["", " ", "A  b\t\nc", "it's we'll", "naïve Ünïcode café", "x" * 3000, "a b", "1234 56,78!", "日本語 テキスト", "é́ mixed", "end.", "..", "a" + " b" * 3000, "  line", "İstanbul ſtraße"]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


@pytest.mark.parametrize(("name", "drops_space"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_gives_the_library_ids(corpus, name, drops_space):
    work = Encoder(tokenizer_path(name), drops_space)
    texts = ODD + [t or "" for _, t in corpus]
    want = [work.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from what is known
        got = [memoryview(x).cast("I").tolist() for x in work.encode(texts)]
        assert got == want


def test_written_files_hold_the_ids_in_order(spark, corpus):
    from tokenizers import Tokenizer

    rows = [(i, t, "clash", 1) for i, t in corpus] + [(1000 + k, t, None, None) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int").repartition(5)
    path = base.new_path(spark, "token_files_test")
    token_files.write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    coded = {}
    for i, t, *_ in rows:
        coded.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    metadata = token_files.read_token_files(spark, path, ["shard", "n_tokens"])
    got = token_files.with_starts(token_files.with_crc(token_files.read_token_files(spark, path)), metadata).orderBy("start").collect()
    assert len(got) == len(rows)
    end, before = 0, -1
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["start"] == end and key >= before
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), crc(x)) for x in coded[r["doc_id"]]]
        end, before = end + r["n_tokens"], key
    few = token_files.read_token_files(spark, path, ["doc_id", "ids"], ids_from=1000, ids_to=1002).orderBy("doc_id").collect()
    assert [list(r["ids"]) for r in few] == [coded[1000 + k][0] for k in range(3)]
    assert token_files.read_token_files(spark, path, ["doc_id"], ids_from=1000).where(F.col("doc_id") < 1000).isEmpty()


def test_empty_table(spark):
    path = base.new_path(spark, "token_files_empty")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize(("name", "drops_space"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_python_sees_a_stretch_once_a_batch_and_the_library_once(name, drops_space):
    """Cutting, numbering and gathering are Arrow's; a word before a mark is no new word."""
    work, seen, sent = Encoder(tokenizer_path(name), drops_space), [], []
    look_up, library = work._look_up, work._encode
    work._look_up = lambda stretches, any_odd: (seen.extend(stretches), look_up(stretches, any_odd))[1]
    work._encode = lambda batch: (sent.extend(batch), library(batch))[1]
    words = ["".join(chr(97 + (k >> s) % 26) for s in (0, 3, 6)) + end for k in range(0, 512, 9) for end in ("a", "é")]
    texts = [" " + " ".join(w + m for w in words for m in ("", ".", ",", ";", "!?")) for _ in range(4)]
    for _ in range(2):
        ids, n = work.ids(pa.array(texts), 7)
        want = [*work.tokenizer.encode(texts[0], add_special_tokens=False).ids, 7]
        assert ids.tolist() == want * 4 and n.tolist() == [len(want)] * 4
    assert len(seen) == 2 * len(set(words)) + 8
    assert sum(len(x.split()) for x in sent) == len(set(words)) + 4


@pytest.mark.parametrize(("name", "drops_space"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_cuts_at_marks_like_the_library(name, drops_space):
    """U+0130 in lower case ends with a sign that is no letter; texts may begin with marks, and odd ones are not cut."""
    work = Encoder(tokenizer_path(name), drops_space)
    texts = ["aİ. b", "İ, İ!?", ".a", "?", "", "é.é", "×.", "Ã.", "….", "a.\n.b", "1.5,x's.'s", "a . b", " .", " .  a, b", "x<|endoftext|>. y", "end."]
    want = [work.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for part, told in ((texts, want), (texts[3:9], want[3:9]), ([], [])):
        assert [memoryview(x).cast("I").tolist() for x in work.encode(part)] == told
    ids, n = work.ids(pa.array(texts).slice(5, 6), 9)
    assert ids.tolist() == [i for x in want[5:11] for i in [*x, 9]] and n.tolist() == [len(x) + 1 for x in want[5:11]]
