"""Cutting-stock planning over a histogram of lengths, by column generation.

A pattern says how many items of each length fill one sequence. The linear program asks for the fewest sequences
that hold all items; it starts from patterns of one length each, and each round a knapsack dynamic program over
the dual prices, steadied by a share of the prices length / size, finds the pattern that helps most. The rounds end when no pattern helps or when the program is
within ``gap`` of the bound that the total length gives. Rounded-down patterns are used; what rounding leaves is
at most a few items for each of the basic patterns (one for each length), which are placed first-fit decreasing;
those of poorly filled bins are left to the caller, who lays them end to end and cuts them.

The size of everything here is bounded by the sequence length, not by the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def price(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: ``values[l]`` for an item of length l (index 0 unused), total length <= size."""
    best = np.zeros(size + 1)
    took = np.zeros(size + 1, np.int64)
    gains = np.append(values[: size + 1], np.full(max(0, size + 1 - len(values)), -1.0))
    for c in range(1, size + 1):
        options = best[c - 1 :: -1] if c > 1 else best[:1]
        options = options + gains[1 : c + 1]
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], took[c] = options[k], k + 1
        else:
            best[c], took[c] = best[c - 1], 0
    counts, c = np.zeros(size + 1, np.int64), size
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[size]), counts


def relaxed(lengths: np.ndarray, counts: np.ndarray, size: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each, a column for each length) and how often the linear program uses them."""
    m = len(lengths)
    basis = np.diag(size // lengths).astype(np.int64)
    inverse = np.diag(1.0 / (size // lengths))
    x = inverse @ counts
    bound = float((lengths * counts).sum()) / size
    natural, pull = lengths / size, 0.9
    while x.sum() > bound * (1 + gap):
        dual = inverse.sum(axis=0)
        values = np.full(size + 1, -1.0)
        values[lengths] = pull * natural + (1 - pull) * dual
        column = price(values, size)[1][lengths]
        if column @ dual <= 1 + 1e-9:  # no help at the true prices
            if not pull:
                break
            pull = pull / 2 if pull > 0.05 else 0.0
            continue
        direction = inverse @ column
        rising = direction > 1e-11
        ratios = np.full(m, np.inf)
        ratios[rising] = np.maximum(x[rising], 0) / direction[rising]
        leave = int(ratios.argmin())
        step = ratios[leave]
        x -= step * direction
        x[leave] = step
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        basis[leave] = column
    return basis, np.maximum(x, 0)


@dataclass
class Plan:
    """Where the items go. ``segments[l]``: (first rank, per sequence, times, first sequence, first slot) rows for the
    items of length l in rank order; ``rest[l]``: for each later rank (sequence, slot), or None for an item that is
    left for cutting. Slots number the items of a sequence from 0."""

    size: int
    sequences: int = 0
    segments: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)
    rest: dict[int, list[tuple[int, int] | None]] = field(default_factory=dict)


def first_fit(items: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers; items in descending length."""
    room, bins = np.empty(len(items), np.int64), []
    for k, length in enumerate(items):
        fits = np.flatnonzero(room[: len(bins)] >= length)
        if len(fits):
            at = int(fits[0])
            bins[at].append(k)
        else:
            at = len(bins)
            bins.append([k])
            room[at] = size
        room[at] -= length
    return bins


def plan(histogram: dict[int, int], size: int = 128, gap: float = 0.002, loose: float = 0.01) -> Plan:
    """Places all items of the histogram (length -> count, lengths 1 .. size, in units of the caller)."""
    out = Plan(size)
    lengths = np.array(sorted(l for l, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return out
    left = np.array([histogram[int(l)] for l in lengths], np.int64)
    patterns, use = relaxed(lengths, left.astype(float), size, gap)
    placed = np.zeros(len(lengths), np.int64)
    for pattern, times in zip(patterns, np.floor(use + 1e-7).astype(np.int64), strict=True):
        present = np.flatnonzero(pattern)
        times = int(min(times, (left[present] // pattern[present]).min()))
        if times < 1:
            continue
        slot = 0
        for k in present:
            n, length = int(pattern[k]), int(lengths[k])
            out.segments.setdefault(length, []).append((int(placed[k]), n, times, out.sequences, slot))
            placed[k] += n * times
            left[k] -= n * times
            slot += n
        out.sequences += times
    items = [int(l) for l, n in zip(lengths[::-1], left[::-1], strict=True) for _ in range(n)]
    where: list[tuple[int, int] | None] = [None] * len(items)
    for one in first_fit(items, size):
        if sum(items[k] for k in one) >= size * (1 - loose):
            for slot, k in enumerate(one):
                where[k] = (out.sequences, slot)
            out.sequences += 1
    for length, place in zip(items, where, strict=True):
        out.rest.setdefault(length, []).append(place)
    return out
