"""Encoding with the tokenizers library, memoised by stretches that no token crosses.

Both public vocabularies cut a text before each run of white space (the word vocabulary also drops the run) and between a
letter or digit and a mark, so the ids of a text are the ids of its stretches ``white space + word`` or ``mark + what
follows``, one after the other. A batch's texts are cut where they lie, and Arrow numbers their distinct stretches and gathers
their ids, so Python sees a stretch once a batch and the library once for as long as it is kept; texts with unusual white space
are encoded whole by the library, since the cut is proved for ASCII white space only.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import base

ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]")
#: Which bytes are ASCII white space; in UTF-8 no other character has them.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
#: Which bytes are marks and ASCII letters or digits, and which end a letter of the block U+00C0 to U+00FF after the byte 0xC3.
MARKS = np.isin(np.arange(256), list(b".,;:!?"))
ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
LATIN = np.array([0x80 <= i < 0xC0 and i not in (0x97, 0xB7) for i in range(256)])
#: Stretches kept by a worker, and the longest that is kept.
KEPT, KEPT_CHARS = 1_000_000, 48
#: Words that are encoded as one text.
TOGETHER = 512


def cut(texts: pa.Array, odd: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts, one after the other, and where each text's begin among them; ``odd`` texts are one stretch."""
    at = np.frombuffer(texts.buffers()[1], "<i4", len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space = SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    marks = np.flatnonzero(MARKS[data[1:]]) + 1
    begins[marks] = ALNUM[data[marks - 1]] | (LATIN[data[marks - 1]] & (marks > 1) & (data[marks - 2] == 0xC3))
    for i in np.flatnonzero(odd):
        begins[at[i] : at[i + 1]] = False
    begins[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts, len(data)).astype("<i4")
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(starts, at)


class Encoder:
    """``ids(texts, end_id)`` gives the ids of all texts, each with the end id, one after the other, and the number of each text's.

    ``encode(texts)`` gives, for each text, its ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, drops_space: bool, kept: int = KEPT):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = drops_space
        self.known: dict[str, bytes] = {}
        # Ids that only the end of a word (word vocabulary) or only its space (byte vocabulary) can have.
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.borders = np.zeros(max(names.values()) + 1, bool)
        self.borders[[i for t, i in names.items() if (t.endswith("</w>") if drops_space else t.startswith("\u0120"))]] = True

    def _plain(self, part: str) -> bool:
        """Is ``part`` a word of letters, or one space and a word where the vocabulary keeps spaces?"""
        return part.isalpha() if self.lowers else part[0] == " " and bool(part[1:2].strip())

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each plain word: many are encoded as one text, and its ids are cut at the words' borders. Where
        these are not as many as the words, each is encoded by itself."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for group, raw in zip(groups, self._encode([(" " if self.lowers else "").join(g) for g in groups]), strict=True):
            cuts = 4 * np.flatnonzero(self.borders[np.frombuffer(raw, "<u4")])
            if len(cuts) != len(group) or (not self.lowers and cuts[0]):
                out += self._encode(group)
                continue
            at = [0, *(cuts + 4).tolist()] if self.lowers else [*cuts.tolist(), len(raw)]
            out += [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        return out

    def _encode(self, batch: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _core(self, stretch: str) -> str:
        """The word vocabulary drops white space, and lower-cases, so ASCII capitals need not be encoded again."""
        core = stretch.strip()
        return core.lower() if core.isascii() else core

    def _encode_new(self, stretches: list[str], any_odd: bool) -> list[bytes]:
        whole = set(filter(ODD_SPACE.search, stretches)) if any_odd else set()
        cores = [s if s in whole else self._core(s) for s in stretches] if self.lowers else stretches
        parts = list(set(cores)) if self.lowers else cores
        plain = [p for p in parts if self._plain(p) and p not in whole]
        coded = dict(zip(plain, self._encode_words(plain), strict=True))
        others = [p for p in parts if p not in coded]
        coded.update(zip(others, self._encode(others), strict=True))
        return [coded[c] for c in cores]

    def _look_up(self, stretches: list[str], any_odd: bool) -> list[bytes]:
        """The ids of distinct stretches."""
        known = self.known
        if len(known) > self.kept:
            known.clear()
        found = list(map(known.get, stretches))
        new = [s for s, x in zip(stretches, found, strict=True) if x is None]
        coded = self._encode_new(new, any_odd)
        known.update(x for x in zip(new, coded, strict=True) if len(x[0]) <= KEPT_CHARS)
        rest = iter(coded)
        return [next(rest) if x is None else x for x in found]

    def ids(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, "<i4"), np.empty(0, np.int64)
        texts = texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, ODD_SPACE.pattern).to_numpy(zero_copy_only=False)
        stretches, at = cut(texts, odd)
        stretches = stretches.dictionary_encode()
        coded = self._look_up(stretches.dictionary.to_numpy(zero_copy_only=False).tolist(), bool(odd.any()))
        coded.append(b"" if end_id is None else end_id.to_bytes(4, "little"))
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        # The end id is one more stretch, after each text's own.
        places = np.insert(stretches.indices.to_numpy(), at[1:], len(coded) - 1)
        out = base.list_array(np.frombuffer(b"".join(coded), "<i4"), lengths, pa.int32()).take(pa.array(places)).flatten()
        ends = np.append(0, np.cumsum(lengths[places]))[at + np.arange(len(at))]
        return out.to_numpy(), np.diff(ends)

    def encode(self, batch: list[str]) -> list[bytes]:
        ids, n = self.ids(pa.array(batch, pa.string()))
        at = np.append(0, np.cumsum(n)).tolist()
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool, kept: int = KEPT) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path, drops_space, kept)
