"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 1).

The search goes over the characters of the normalised text and keeps, for each place where a piece can end, one
survivor: the last piece and where it began. No piece is longer than ``longest`` characters, so only as many places
ahead can have a survivor, and those behind are reached through backpointers alone. Their backpointer paths are followed from time to time; where all have met,
the ids before that place are committed and everything before it is dropped.

A survivor is chosen by the model's kind. In a unigram model it is the path of the greatest sum of scores. In a BPE
model it is the piece that merging would leave there: a piece follows another if merging the two pieces' text leaves
just these two, so the survivors are the encodings of all prefixes and the last one is the text's. Both give the ids
of the sentencepiece library for the same model file, byte fallback included.

No piece holds a pair of neighbouring characters that no piece's text has; texts are cut there, and the parts' ids
are kept by each worker.

Nulls and ties: a null text is an empty one and has no ids; unigram ties go to the longer last piece; repeated rows
are encoded alike; an empty table gives an empty result. Only the named columns are read. Decoding gives the normalised text: what the
model's normalisation changes (none of the texts here, but for the character U+2581) is not restored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

SPACE = "▁"
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Parts whose ids a worker keeps, the longest that is kept, and how many characters pass between commits.
KEPT, KEPT_CHARS, COMMIT = 800_000, 48, 64
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Encoder:
    """``encode(text)`` gives ids, ``decode(ids)`` a text; for the model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.normaliser = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer = next(v for k, v in fields(model) if k == 2)
        self.kind = next((v for k, v in fields(trainer) if k == 3), UNIGRAM)
        sp = self.normaliser
        self.texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.texts))]
        self.ids = {t: i for i, t in enumerate(self.texts) if not special[i]}
        self.scores = [sp.get_score(i) for i in range(len(self.texts))]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.unknown, self.unknown_score = sp.unk_id(), min(self.scores[i] for i in self.ids.values()) - 10
        self.longest = max(map(len, self.ids))
        self.bonds = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        self.follow: dict[tuple[str, str], bool] = {}
        whole = (t for t in self.ids if self.kind != BPE or self.merged(t) == [t])  # others no merging gives
        self.coded = {t: self.ids[t].to_bytes(4, "little") for t in whole}
        self.begins = {t[:n] for t in self.coded for n in range(1, len(t) + 1)}
        self.plain = [t.replace(SPACE, " ") for t in self.texts]
        self.is_byte = np.array([i in self.value for i in range(len(self.texts))])

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best pair first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def search(self, text: str) -> list[str]:
        """The pieces of a text, which may be of any length: see the module's description."""
        out: list[str] = []
        # Of each place: where its last piece begins, that piece, and (unigram) the path's score.
        last: dict[int, tuple[int, str, float]] = {0: (0, "", 0.0)}
        done, n, pieces, begins, bpe, follow = 0, len(text), self.coded, self.begins, self.kind == BPE, self.follow
        for i in range(n):
            here = last.get(i)
            if here is not None:
                j = i + 1
                piece = text[i:j]
                while True:
                    if piece in pieces or j == i + 1:
                        if not bpe:
                            score = here[2] + (self.scores[self.ids[piece]] if piece in pieces else self.unknown_score)
                            if j not in last or score > last[j][2]:
                                last[j] = (i, piece, score)
                        elif j not in last:
                            key = (here[1], piece)
                            fits = follow.get(key)
                            if fits is None:
                                fits = follow[key] = not here[1] or self.merged(here[1] + piece) == [here[1], piece]
                            if fits:
                                last[j] = (i, piece, 0.0)
                    if j == n or piece not in begins:
                        break
                    j += 1
                    piece = text[i:j]
            if (i + 1) % COMMIT == 0 or i + 1 == n:
                # Every path goes on from a place that a piece from here or before can reach.
                live = {j for j in range(i + 1, min(n, i + self.longest) + 1) if j in last} if i + 1 < n else {n}
                while len(live) > 1:  # where do all survivors' paths meet?
                    top = max(live)
                    live.remove(top)
                    live.add(last[top][0])
                meet = here = live.pop()
                if meet > i + 1:  # not yet final: a later piece may still end there
                    continue
                path = []
                while here > done:
                    path.append(last[here][1])
                    here = last[here][0]
                out += reversed(path)
                done = meet
                last = {k: x for k, x in last.items() if k >= done}
        return out

    def _part(self, text: str) -> bytes:
        if len(self.follow) > KEPT:
            self.follow.clear()
        out: list[bytes] = []
        for piece in self.search(text):
            code = self.coded.get(piece)
            if code is not None:
                out.append(code)
            elif self.bytes:
                out += [self.bytes[b].to_bytes(4, "little") for b in piece.encode()]
            elif not out or out[-1] != self.unknown.to_bytes(4, "little"):  # neighbouring unknown characters are one piece
                out.append(self.unknown.to_bytes(4, "little"))
        return b"".join(out)

    def _stretch(self, text: str) -> bytes:
        if len(text) <= KEPT_CHARS:
            return self._part(text)
        out: list[bytes] = []
        start = 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in self.bonds:
                part = text[start:i]
                ids = self.known.get(part)
                if ids is None:
                    ids = self._part(part)
                    if len(part) <= KEPT_CHARS:
                        self.known[part] = ids
                out.append(ids)
                start = i
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text), "<u4").tolist()

    def encoded(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        out: list[bytes] = []
        for s in STRETCH.findall(self.normaliser.normalize(text)):
            ids = known.get(s)
            if ids is None:
                ids = self._stretch(s)
                if len(s) <= KEPT_CHARS:
                    known[s] = ids
            out.append(ids)
        if not self.bytes:
            coded = np.frombuffer(b"".join(out), "<u4")
            again = np.concatenate(([False], coded[1:] == coded[:-1])) & (coded == self.unknown) if len(coded) else coded == 0
            return coded[~again].tobytes()
        return b"".join(out)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if self.is_byte[ids].any():
            parts = (bytes([self.value[i]]) if i in self.value else self.plain[i].encode() for i in ids.tolist())
            text = b"".join(parts).decode(errors="replace")
        else:
            text = "".join(map(self.plain.__getitem__, ids.tolist()))
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each whole text. ``model_path`` is a file of the workers' machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([work.encode(t) for t in b["text"].to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return base.texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the column ``text`` decoded from their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(model_path)
        for b in batches:
            texts = [None if x is None else work.decode(x) for x in b[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    rows = rows.drop("text")
    return rows.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): from each text's ids, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b["text"].to_pylist()
                coded = [work.encoded(t) for t in texts]
                crc = [zlib.crc32(x) for x in coded]
                same = [work.decode(np.frombuffer(x, "<u4")) == t for x, t in zip(coded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return base.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
