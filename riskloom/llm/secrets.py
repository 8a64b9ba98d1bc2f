"""Secret scan with a random forest against false positives (operator 8).

Candidates are whole PEM blocks, long runs of key characters with a digit or many changes of case, and values assigned
after ``=`` or ``:``. Each has features: length, character transitions (their mean surprise under transition
probabilities learned from the whole corpus, and changes between kinds of characters), shares of kinds, entropy, how
much of it the corpus's frequent words cover, whether it stands in a path or address or the document's ``source`` looks
like a test's, and which telling or harmless words stand beside it. A Spark ML random forest, fitted on labelled
findings, rejects false positives; its trees, as flat arrays, rate the candidates where the texts are, so the scan is
one pass without a shuffle.

Labelled findings come from a table (text, start, length, label, source). Where there is none, ``generated_findings``
makes them by rule with a fixed seed: ``sample`` findings (a documented bound), half of them secrets.

Nulls and ties: a null or empty text has no candidates; a null id or source is allowed; overlapping candidates become
the longer one, the first of equal ones; of equally frequent words the lesser are taken; repeated rows are scanned
each; an empty table gives an empty result. Columns are read by name, so others may have any name.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}-----(?:[^-]*-----END [A-Z0-9 ]{0,40}-----|(?:\s+[A-Za-z0-9+/=]{32,})*)")
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
VALUE = re.compile(r"[:=][ \t]*[\"']?([^\s\"',;<>(){}]{8,})")
#: Telling words, in lower case, beside a secret and beside what only looks like one.
TELLING = ("secret", "token", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "private", "access")
HARMLESS = ("sha", "md5", "commit", "checksum", "hash", "digest", "uuid", "guid", "version", "example", "sample", "dummy", "placeholder", "id", "phone", "card", "number", "href", "src", "path", "file")
#: Words of which names are made when findings are generated, beside the corpus's own.
NAMES = ("your", "api", "key", "here", "change", "insert", "example", "user", "name", "file", "config", "default", "value", "index", "path", "client", "server", "request", "handler", "module", "image", "build", "version", "table")
FEATURES = ("length", "surprise", "transitions", "digits", "upper", "lower", "marks", "hex", "entropy", "distinct", "dictionary", "assigned", "quoted", "telling", "password", "harmless", "in_path", "private_block", "test_source")
AROUND = 40
#: Frequent words of the corpus that are kept; characters told apart, all others counting as one more.
DICTIONARY, CHARACTERS = 4000, 128


@dataclass
class Language:
    """What the corpus teaches: the surprise (bits) of each character after another, and its frequent words."""

    surprise: np.ndarray
    words: frozenset[str]

    def of(self, value: str) -> float:
        codes = [min(ord(c), CHARACTERS) for c in value]
        return float(self.surprise[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def covered(self, value: str) -> int:
        """Characters that frequent words cover, the longest first from the left."""
        total = 0
        for run in re.findall(r"[a-z]{4,}", value.lower()):
            at = 0
            while at <= len(run) - 4:
                n = next((n for n in range(min(12, len(run) - at), 3, -1) if run[at : at + n] in self.words), 0)
                total += n
                at += n or 1
        return total


def learned(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> Language:
    """Transition counts and word counts over all texts; what comes to the driver is bounded by the alphabet and ``size``."""
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    n = CHARACTERS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for b in batches:
            for text in base.text_bytes(b["text"]):
                codes = np.minimum(np.frombuffer(text, np.uint8), CHARACTERS).astype(np.int64)
                total += np.bincount(codes[:-1] * n + codes[1:], minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])

    pairs = texts.mapInArrow(base.rested(count), "counts array<long>").select(F.posexplode("counts").alias("pair", "n")).where("n > 0").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.full(n * n, 0.1)
    for r in pairs:
        counts[r["pair"]] += r["n"]
    counts = counts.reshape(n, n)
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,12}"), 0)).alias("word")).groupBy("word").count()
    top = words.orderBy(F.desc("count"), "word").limit(size).collect()
    return Language(-np.log2(counts / counts.sum(axis=1, keepdims=True)), frozenset(r["word"] for r in top if r["count"] > 1))


@dataclass
class Forest:
    """Trees as flat arrays: the feature of each node (-1: a leaf), its threshold, both children and the leaf's share."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    language: Language

    def rate(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                live = np.flatnonzero(f >= 0)
                if not len(live):
                    break
                go = x[live, f[live]] <= threshold[at[live]]
                at[live] = np.where(go, left[at[live]], right[at[live]])
            total += share[at]
        return total / max(1, len(self.trees))


def keylike(run: str) -> bool:
    """A run with a digit, or a longer one whose letters change their case as no name's do."""
    if any(map(str.isdigit, run)):
        return True
    letters = [c.isupper() for c in run if c.isalpha()]
    return len(letters) >= 20 and 4 * sum(a != b for a, b in zip(letters, letters[1:], strict=False)) >= len(letters)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, length) of what may be a secret, in order and without overlaps."""
    found = [(m.start(), m.end()) for m in PEM.finditer(text)] if "-----BEGIN " in text else []
    found += [(m.start(), m.end()) for m in RUN.finditer(text) if keylike(m[0])]
    found += [m.span(1) for m in VALUE.finditer(text) if keylike(m[1]) or any(w in text[max(0, m.start() - AROUND) : m.start()].lower() for w in TELLING)]
    out: list[tuple[int, int]] = []  # by place and without overlaps, so only a candidate's two neighbours can overlap it
    for s, e in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        at = bisect(out, (s, e))
        if (at == 0 or out[at - 1][1] <= s) and (at == len(out) or e <= out[at][0]):
            out.insert(at, (s, e))
    return [(s, e - s) for s, e in out]


def features(language: Language, text: str, start: int, length: int, source: str | None = None) -> list[float]:
    value = text[start : start + length]
    before, after = text[max(0, start - AROUND) : start].lower(), text[start + length : start + length + AROUND // 2].lower()
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    n, kinds, counts = max(1, length), Counter(kind), Counter(value)
    near = [*re.findall(r"[a-z]+", before[-30:])[-3:], *re.findall(r"[a-z]+", after)[:1]]
    return [
        float(length), language.of(value), sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, kinds["d"] / n, kinds["u"] / n, kinds["l"] / n, kinds["m"] / n,
        sum(c in string.hexdigits for c in value) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts) / n, language.covered(value) / n,
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before.endswith(('"', "'"))),
        float(any(t in w for t in TELLING for w in near)), float(any(w in x for w in ("password", "passwd", "pwd") for x in near)), float(any(w in HARMLESS for w in near)),
        float("://" in before[-30:] or before.endswith(("/", "\\")) or value.count("/") > 2), float(value.startswith("-----BEGIN") and "PRIVATE" in value[:60]),
        float(bool(source) and bool(re.search(r"test|example|sample|fixture", source.lower()))),
    ]


def generated_findings(words: list[str], sample: int = 4000, seed: int = 8) -> list[tuple[str, int, int, int, str | None, str]]:
    """(text, start, length, label, source, kind): secrets with and without telling words, and look-alikes with and without."""
    r = random.Random(seed)
    of = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    hexes, both = "0123456789abcdef", string.ascii_letters + string.digits
    words = [*words, *NAMES] if words else list(NAMES)
    word = lambda: r.choice(words if r.random() < 0.6 else NAMES)
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    lines = lambda: "\n".join(of(both + "+/", 64, 64) for _ in range(r.randint(2, 6)))
    name = lambda sep: sep.join(word() for _ in range(r.randint(2, 5)))
    keys = {
        "hex": lambda: of(hexes, 32, 64), "alphanumeric": lambda: of(both, 20, 48), "base64": lambda: of(both + "+/", 40, 64) + "=" * r.randint(0, 2),
        "cloud": lambda: of(string.ascii_uppercase[:4], 4, 4) + of(string.ascii_uppercase + string.digits, 16, 16), "prefixed": lambda: of("abcdefghij", 2, 4) + "_" + of(both, 30, 40), "letters": lambda: of(string.ascii_letters, 24, 44),
    }
    telling = lambda: r.choice(["", "api_", "aws_", "db.", "my-"]) + r.choice(TELLING) + r.choice(["", "_key", "_value", "_id"])
    assign = lambda: r.choice([" = ", "=", ": ", ' = "', "='", ': "'])
    secret = {
        "assigned": lambda: (f"{prose()} {telling()}{assign()}", r.choice(list(keys.values()))()),
        "beside": lambda: (f"{prose()} the {r.choice(TELLING)} {r.choice(['is ', 'was ', '', 'reads '])}", r.choice(list(keys.values()))()),
        "address": lambda: (f"{prose()} https://{word()}.{word()}/{word()}?{r.choice(['access_token', 'key', 'sig', 'auth'])}=", keys[r.choice(["hex", "alphanumeric", "prefixed"])]()),
        "bare": lambda: (f"{prose()} ", keys[r.choice(["base64", "alphanumeric", "prefixed", "cloud", "letters"])]()),
        "password": lambda: (f"{prose()} {r.choice(['db_', '', 'root '])}{r.choice(['password', 'passwd', 'pwd'])}{assign()}", of(both + "!#%&*@^", 10, 20) if r.random() < 0.7 else name("-")),
        "block": lambda: (f"{prose()}\n", f"-----BEGIN {(k := r.choice(['RSA ', 'EC ', '', 'OPENSSH ']))}PRIVATE KEY-----\n{lines()}\n-----END {k}PRIVATE KEY-----"),
    }
    harmless = {
        "number": lambda: (f"{prose()} {r.choice(['', 'card ', 'phone ', 'number: ', 'id='])}", of(string.digits, 16, 20)),
        "uuid": lambda: (f"{prose()} {r.choice(['uuid', 'guid', 'id', 'request', word()])}{r.choice([' ', ': ', '='])}", "-".join(of(hexes, n, n) for n in (8, 4, 4, 4, 12))),
        "digest": lambda: (f"{prose()} {r.choice(['sha', 'commit', 'checksum', 'md5', 'digest', 'hash'])}{r.choice([' ', ': ', '='])}", of(hexes, 40, 40) if r.random() < 0.6 else of(hexes, 32, 64)),
        "path": lambda: (f"{prose()} {r.choice(['', './', '/', 'https://' + word() + '.org/'])}", name("/") + "/" + name("-") + of(string.digits, 1, 4)),
        "name": lambda: (f"{prose()} ", "".join(x.title() for x in (word(), word(), word(), word())) + of(string.digits, 1, 2)),
        "identifier": lambda: (f"{prose()} {telling()}{assign()}", name(r.choice("_.")) + r.choice(["", "()", "1"])),
        "placeholder": lambda: (f"{prose()} {telling()}{assign()}", r.choice(["your-api-key-here-1", "insert_your_token_here1", "changeme12345678", "xxxxxxxxxxxxxxxx0000", "<your-key-0000>", "${SECRET_KEY_1}", "REPLACE_ME_123456"])),
        "word": lambda: (f"{prose()} ", word() + word() + word() + of(string.digits, 1, 2)),
        "date": lambda: (f"{prose()} {r.choice(['version', 'build', 'file'])}{r.choice([': ', '=', ' '])}", f"20{of(string.digits, 2, 2)}-{of('01', 2, 2)}-{of('012', 2, 2)}T{of('01', 2, 2)}-{of(string.digits, 2, 2)}"),
        "public": lambda: (f"{prose()}\n", f"-----BEGIN {(k := r.choice(['PUBLIC KEY', 'CERTIFICATE']))}-----\n{lines()}\n-----END {k}-----"),
    }
    out = []
    for i in range(sample):
        label = i % 2
        kind = r.choice(list(secret if label else harmless))
        left, value = (secret if label else harmless)[kind]()
        close = left[-1] if left[-1:] in ('"', "'") else ""
        out.append((f"{left}{value}{close} {prose()}", len(left), len(value), label, "tests/fixtures" if not label and r.random() < 0.1 else None, kind))
    return out


def fit(docs: DataFrame, findings: DataFrame | list[tuple] | None = None, sample: int = 4000, trees: int = 40, depth: int = 10, seed: int = 8) -> Forest:
    """A random forest over labelled findings (text, start, length, label, source), at most ``sample`` of a DataFrame's rows
    (those with the smallest hashes); the corpus ``docs`` teaches transitions and words."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark, language = docs.sparkSession, learned(docs)
    rows = generated_findings(sorted(language.words), sample, seed) if findings is None else findings
    if isinstance(rows, DataFrame):
        rows = rows.select("text", "start", "length", "label", "source").where("text is not null and label is not null")
        rows = [tuple(x) for x in rows.orderBy(F.xxhash64("text", "start", "length"), "text", "start", "length").limit(sample).collect()]
    frame = spark.createDataFrame([(features(language, t, s, n, src), float(y)) for t, s, n, y, src, *_ in rows if t is not None and y is not None], "x array<double>, label double")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(frame.select(array_to_vector("x").alias("features"), "label"))
    flat = []
    for tree in model.trees:
        feature, threshold, left, right, share = [], [], [], [], []

        def walk(node) -> int:
            at = len(feature)
            for column, value in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (share, 0.0)):
                column.append(value)
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                share[at] = stats[1] / max(1e-9, sum(stats))
            else:
                feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                left[at], right[at] = walk(node.leftChild()), walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        flat.append(tuple(np.array(c) for c in (feature, threshold, left, right, share)))
    return Forest(flat, language)


FOUND = "array<struct<start:int,length:int,score:double,secret:boolean>>"
FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64()), ("secret", pa.bool_())]))


def rated(forest: Forest, texts: list[str | None], sources: list[str | None], threshold: float) -> list[list[dict]]:
    """The candidates of each text of a batch with their scores. Places count characters of the whole text."""
    places = [candidates(t) if t else [] for t in texts]
    x = [features(forest.language, t, s, n, src) for t, p, src in zip(texts, places, sources, strict=True) for s, n in p]
    scores = iter(forest.rate(np.array(x)).tolist() if x else [])
    return [[{"start": s, "length": n, "score": (v := next(scores)), "secret": v >= threshold} for s, n in p] for p in places]


def source_of(docs: DataFrame) -> Column:
    """The column ``source`` where there is one of strings."""
    return F.col("source") if dict(docs.dtypes).get("source") == "string" else F.lit(None).cast("string")


def found(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> Column:
    """A column: every candidate of ``text`` with its score."""

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array(rated(forest, texts.to_pylist(), sources.to_pylist(), threshold), FOUND_ARROW)

    return scan("text", source_of(docs))


def masked(docs: DataFrame, forest: Forest, mask: str, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, with the secrets in ``text`` replaced by ``mask``."""

    @F.arrow_udf("string")
    def cover(texts: pa.Array, sources: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, hits in enumerate(rated(forest, out, sources.to_pylist(), threshold)):
            if any(h["secret"] for h in hits):
                parts, at = [], 0
                for h in hits:
                    if h["secret"]:
                        parts += [out[i][at : h["start"]], mask]
                        at = h["start"] + h["length"]
                out[i] = "".join([*parts, out[i][at:]])
        return pa.array(out, pa.string())

    return docs.withColumn("text", cover("text", source_of(docs)))


def findings(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, secrets): one row for each document."""
    rows = docs.select("doc_id", found(docs, forest, threshold).alias("found"))
    return rows.select("doc_id", F.size("found").alias("n_candidates"), F.filter("found", lambda x: x.secret).alias("secrets")).withColumn("n_secrets", F.size("secrets"))
