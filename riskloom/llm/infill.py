"""Fill-in-middle transformation with ropes (operator 12).

A text becomes a rope: a binary tree whose leaves are short parts of it and whose nodes cache how many units (by default code
points; or matches of a pattern, such as words or lines) and code points lie below them. The tree is split at two unit ranks into
prefix, middle and suffix, and these are put together in another order with marks between them, without touching
a leaf but the two that the cuts go through. The way back finds the marks in the output and splits its tree at code points.

A document's cuts and form follow from a hash of its id, so they are the same wherever and however often it is transformed. A text
that is empty or holds a mark stays plain, and so does a share of all others.

Nulls and ties: a null text is an empty one; a null id counts as the text "null"; rows with equal ids have the same hashes and
are transformed each for itself; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .blocks import arrow_schema

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of the texts that are transformed, and per cent of these that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Code points of a leaf.
LEAF = 512
SHAPE = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"


class Units:
    """How a text falls into units: code points, or matches of a pattern, each with what follows it unmatched (the first one also
    with what goes before it; a text without a match is one unit)."""

    def __init__(self, pattern: str | None = None):
        self.pattern = re.compile(pattern) if pattern else None

    def starts(self, text: str) -> Iterator[int]:
        """Where units begin but the first, which begins at 0."""
        return islice((m.start() for m in self.pattern.finditer(text) if m.end() > m.start()), 1, None)

    def leaves(self, text: str) -> list[Rope]:
        if self.pattern is None:
            return [Rope(part, len(part), len(part)) for part in (text[i : i + LEAF] for i in range(0, len(text), LEAF))]
        out, begin, units = [], 0, 1
        for at in self.starts(text):
            if at - begin >= LEAF:
                out.append(Rope(text[begin:at], units, at - begin))
                begin, units = at, 0
            units += 1
        return [*out, Rope(text[begin:], units, len(text) - begin)] if text else []

    def cut(self, leaf: Rope, rank: int) -> int:
        """Code points of the leaf's first ``rank`` units: more than none, fewer than all."""
        return rank if self.pattern is None else next(islice(self.starts(leaf.text), rank - 1, None))

    def rope(self, text: str) -> Rope:
        """A balanced tree."""
        level = self.leaves(text) or [EMPTY]
        while len(level) > 1:
            level = [joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    def parted(self, leaf: Rope, rank: int) -> tuple[Rope, Rope]:
        at = self.cut(leaf, rank)
        return Rope(leaf.text[:at], rank, at), Rope(leaf.text[at:], leaf.units - rank, leaf.points - at)

    def split(self, rope: Rope, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` units and the rest."""
        return split(rope, rank, "units", self.parted)


class Rope:
    """A leaf with a text, or an inner node with two ropes below it."""

    __slots__ = ("left", "points", "right", "text", "units")

    def __init__(self, text: str, units: int, points: int, left: Rope | None = None, right: Rope | None = None):
        self.text, self.units, self.points, self.left, self.right = text, units, points, left, right

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                parts.append(node.text)
            else:
                todo += (node.right, node.left)
        return "".join(parts)


EMPTY = Rope("", 0, 0)


def joined(*ropes: Rope) -> Rope:
    out = EMPTY
    for r in ropes:
        if out.points and r.points:
            out = Rope("", out.units + r.units, out.points + r.points, out, r)
        elif r.points:
            out = r
    return out


def split(rope: Rope, rank: int, measure: str, cut: Callable[[Rope, int], tuple[Rope, Rope]]) -> tuple[Rope, Rope]:
    """Two ropes, the first with ``rank`` of what is measured ("units" or "points"); ``cut(leaf, rank)`` parts a leaf.

    Goes down one path: what lies left and right of it is joined again on the way back.
    """
    path = []
    while rope.left is not None:
        first = getattr(rope.left, measure)
        path.append((rope, rank > first))
        rope, rank = (rope.right, rank - first) if rank > first else (rope.left, rank)
    a, b = (EMPTY, rope) if rank == 0 else (rope, EMPTY) if rank >= getattr(rope, measure) else cut(rope, rank)
    for node, right in reversed(path):
        a, b = (joined(node.left, a), b) if right else (a, joined(b, node.right))
    return a, b


def split_points(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points and the rest; units are not counted in the parts of a cut leaf."""
    return split(rope, rank, "points", lambda leaf, p: (Rope(leaf.text[:p], 0, p), Rope(leaf.text[p:], 0, leaf.points - p)))


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that are never mistaken: none holds its first character, or another mark's, anywhere but at its start."""
    if len(set(marks)) < 3 or not all(marks) or any(m[0] in x[1:] for m in marks for x in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError(f"marks {marks} cannot be told apart from the text between them")
    return marks


def rearranged(units: Units, whole: Rope, first: int, second: int, form: str, marks: tuple[str, str, str]) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle): the tree of a text cut at two unit ranks."""
    start, suffix = units.split(whole, max(first, second))
    prefix, middle = units.split(start, min(first, second))
    p, s, m = (Rope(x, 0, len(x)) for x in marks)
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return joined(*order), prefix.points, middle.points


def put_back(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text of an output: its tree is split before and after each mark."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    border = output.index(second, len(first))
    last = output.index(m, border + len(second))
    rest, middle = split_points(Units().rope(output), last + len(m))
    rest, _ = split_points(rest, last)
    rest, y = split_points(rest, border + len(second))
    rest, _ = split_points(rest, border)
    _, x = split_points(rest, len(first))
    return str(joined(x, middle, y) if form == "psm" else joined(y, middle, x))


def transformed(docs: DataFrame, unit: str | None = None, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SHAPE rows: the number of units, the form (plain, psm, spm), units and code points of prefix and middle (null if plain),
    and the output, for each whole text. ``unit`` is a pattern; without one, units are code points."""
    checked(marks)
    schema = arrow_schema(SHAPE)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    hashes = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = base.texts(docs, id_col, text_col).select("doc_id", "text", *hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Units(unit)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text, h1, h2, h3, h4 = (b[c][i].as_py() for c in ("text", "h1", "h2", "h3", "h4"))
                whole = kinds.rope(text)
                n = whole.units
                if not text or h3 % 100 >= rate or any(m in text for m in marks):
                    out.append((n, "plain", None, None, None, None, text))
                    continue
                cuts, form = (h1 % (n + 1), h2 % (n + 1)), "spm" if h4 % 100 < suffix_first else "psm"
                rope, prefix, middle = rearranged(kinds, whole, *cuts, form, marks)
                out.append((n, form, min(cuts), max(cuts) - min(cuts), prefix, middle, str(rope)))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True))], schema=schema)

    return rows.mapInArrow(base.rested(run), SHAPE)


def restored(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Adds ``restored``, the text rebuilt from the columns output and form alone."""

    @F.arrow_udf("string")
    def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([put_back(o.as_py(), f.as_py(), marks) for o, f in zip(outputs, forms, strict=True)], pa.string())

    return rows.withColumn("restored", rebuilt("output", "form"))
