"""Token counts by a lookup of two tiers where the texts lie (operator 13).

A text's number of tokens is the sum of its pre-tokens' numbers, since byte-level merges never cross the borders that the
tokenizer's pattern draws. First tier: a table of the corpus' frequent pre-tokens and their lengths in tokens, broadcast to all
tasks. Second tier: what the table lacks is encoded by the library, many pre-tokens at once, and kept in the worker's cache, which begins
with the table and is set back to it when it is full.

No pre-token is ever the key of a shuffle. The table comes from all texts: each task summarises its pre-tokens' counts in a
bounded number of counters (Misra-Gries; whatever makes up more than a ``frequent``-th of a task's pre-tokens has one), and the
summaries, one row a task, are merged as a stream in a fixed number of tasks and then in the driver. It holds at most ``frequent``
pre-tokens of at most FREQUENT_CHARS characters, so its size is bounded whatever the corpus. The table only saves work: counts
are the library's with any table, and with none.

Texts are cut before white space into stretches that no token crosses, so no task holds the pre-tokens of a very long text at
once. Stretches with characters on which two editions of Unicode may disagree, or with the text of an added token, are
encoded as they are by the library, in its default way.

Nulls and ties: a null text is an empty one, with no bytes and no tokens; a null id is kept; rows with equal ids are counted
each for itself; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Anything but characters that every edition of Unicode puts in the same class: printable ASCII and its white space, letters and
#: signs of Latin, Greek and Cyrillic, punctuation, kana, the first block of Chinese characters, Korean syllables.
UNSURE = re.compile("[^\t\n\v\f\r -~¡-¬®-ȳΑ-ΡΣ-ώЀ-ҁ‐-‧‰-⁞ぁ-ゔァ-ヺ一-龥가-힣]")


def _of(kind: str) -> str:
    """The sure characters of a class of Unicode, as ranges within brackets."""
    found = {c for c in map(chr, range(0xD800)) if regex.fullmatch(kind, c) and not UNSURE.search(c)}
    begins, ends = (sorted(c for c in found if chr(ord(c) + by) not in found) for by in (-1, 1))
    return "".join(f"{a}-{b}" for a, b in zip(begins, ends, strict=True))


LETTER, NUMBER = _of(r"\p{L}"), _of(r"\p{N}")
#: Pre-tokens of byte-level BPE in sure characters, as the public tokenizer's pattern has them (fixed value).
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
CUT = re.compile("[!-~](?=[ \t\n\v\f\r])")
#: Characters of a stretch; pre-tokens looked up at once; entries of a worker's cache and their longest text.
STRETCH, TOGETHER, KEPT, KEPT_CHARS = 1 << 15, 1 << 16, 200_000, 48
#: Entries of the table and their longest text; tasks that merge summaries.
FREQUENT, FREQUENT_CHARS, MERGERS = 1 << 14, 24, 64
SUMMARY = "words string, counts binary"


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of a text, cut before white space that follows a printable ASCII character; without any, one part."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    if at < len(text):
        yield text[at:]


def thinned(counts: Counter, k: int) -> Counter:
    """At most ``k`` counters, each less by the count of the first one that is left out (Misra-Gries)."""
    if len(counts) <= k:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    less = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return Counter({w: n - less for w, n in counts.items() if n > less})


def _row(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(["\0".join(counts)]), pa.array([np.fromiter(counts.values(), np.int64, len(counts)).tobytes()], pa.binary())], ["words", "counts"])


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """One SUMMARY row for each task that has texts: counters of frequent pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b["text"].to_pylist():
                for part in stretches(text):
                    if not UNSURE.search(part):
                        counts.update(PRE_TOKEN.findall(part))
                        if len(counts) > 8 * k:
                            counts = thinned(counts, k)
        counts = thinned(Counter({w: n for w, n in counts.items() if len(w) <= FREQUENT_CHARS}), k)
        if counts:
            yield _row(counts)

    return docs.select("text").mapInArrow(base.rested(run), SUMMARY)


def merged(tables: Iterator[pa.RecordBatch], k: int) -> Counter:
    counts: Counter = Counter()
    for b in tables:
        for words, raw in zip(b["words"].to_pylist(), b["counts"].to_pylist(), strict=True):
            counts.update(dict(zip(words.split("\0"), np.frombuffer(raw, np.int64).tolist(), strict=True)))
            counts = thinned(counts, k)
    return counts


def frequent_words(docs: DataFrame, k: int = FREQUENT) -> Counter:
    """The counters of the whole corpus, at most ``k``; the driver merges at most MERGERS summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if counts := merged(batches, k):
            yield _row(counts)

    rows = summaries(docs, k).repartition(MERGERS).mapInArrow(run, SUMMARY)
    with base.settings(docs.sparkSession):
        return merged(iter(rows.toArrow().to_batches()), k)


class Library:
    """The tokenizers library for one vocabulary, and what a worker remembers of it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told["pre_tokenizer"] or {}
        if told["normalizer"] or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path} is no byte-level vocabulary whose pre-tokens are known")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t["content"] for t in told["added_tokens"]]
        self.known: dict[str, int] = {}

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def whole(self, part: str) -> bool:
        """Must the library see this stretch as it is?"""
        return bool(UNSURE.search(part)) or any(a in part for a in self.added)


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    """One for each vocabulary and Python worker."""
    return Library(path)


def broadcast_lengths(docs: DataFrame, path: str, k: int = FREQUENT) -> Broadcast:
    """The first tier, packed: pre-tokens as one text, their numbers of tokens as 16-bit integers."""
    words = list(frequent_words(docs, k))
    return docs.sparkSession.sparkContext.broadcast(("\0".join(words), np.array(library(path).lengths(words), np.uint16).tobytes()))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): bytes and tokens of each whole text, and whether these are more than ``limit``."""
    docs = base.texts(docs, id_col, text_col)
    first = broadcast_lengths(docs, tokenizer, frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = library(tokenizer)
        words, lengths = first.value
        frequent = dict(zip(words.split("\0"), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if words else {}
        known = work.known
        known.update(frequent)
        waiting: list[tuple[int, list[str]]] = []
        totals = np.zeros(0, np.int64)

        def look_up() -> None:
            misses = list(set().union(*(w for _, w in waiting)).difference(known))
            known.update(zip(misses, work.lengths(misses), strict=True))
            for i, found in waiting:
                totals[i] += sum(map(known.__getitem__, found))
            waiting.clear()
            for w in misses:
                if len(w) > KEPT_CHARS:
                    del known[w]
            if len(known) > KEPT + len(frequent):
                known.clear()
                known.update(frequent)

        for b in batches:
            totals, held = np.zeros(b.num_rows, np.int64), 0
            for i in range(b.num_rows):
                for part in stretches(b["text"][i].as_py()):
                    if work.whole(part):
                        totals[i] += work.lengths([part])[0]
                        continue
                    waiting.append((i, PRE_TOKEN.findall(part)))
                    held += len(waiting[-1][1])
                    if held > TOGETHER:
                        look_up()
                        held = 0
            look_up()
            sizes = pa.compute.binary_length(b["text"].cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), sizes, pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.mapInArrow(base.rested(count), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
