"""Cutting stock by column generation: fill bins of equal capacity with items of few different sizes."""

from __future__ import annotations

from collections import Counter

import numpy as np


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the fill of one bin with the largest value, by dynamic programming over capacity."""
    by_size = np.full(capacity + 1, -1.0)
    index = np.zeros(capacity + 1, np.int64)
    by_size[sizes] = values
    index[sizes] = np.arange(len(sizes))
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)  # size of the item put in last; 0: one unit left free
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        gain = by_size[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(gain.argmax())
        if by_size[k + 1] > 0 and gain[k] > best[c]:
            best[c], last[c] = gain[k], k + 1
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c]:
            pattern[index[last[c]]] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def plan_bins(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand[k]`` items of ``sizes[k]``, with few bins.

    The linear program over patterns starts from one pattern a size; its duals
    price the sizes, the knapsack finds the pattern that gains most, and it
    enters the basis (revised simplex).  It ends when no pattern gains, or the
    dual bound shows the optimum within ``gap``.  Uses are rounded down and the
    items left are put in by best fit, longest first.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    while True:
        duals = inverse.sum(axis=0)
        value, pattern = _best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * step, 0)
        x[r] = ratio[r]
        columns[:, r] = pattern
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
    uses = np.floor(x + 1e-9).astype(np.int64)
    plan = [(columns[:, j].astype(np.int64), int(uses[j])) for j in range(m) if uses[j]]
    left = demand.astype(np.int64) - sum((p * n for p, n in plan), np.zeros(m, np.int64))
    return plan + _best_fit(sizes, np.maximum(left, 0), capacity)


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The rest (a few items a size), longest first, each into the fullest bin that still holds it."""
    bins: list[np.ndarray] = []
    room: list[int] = []
    for k in np.argsort(-sizes):
        for _ in range(int(left[k])):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[k]]
            if fits:
                b = min(fits)[1]
            else:
                b = len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
                room.append(capacity)
            bins[b][k] += 1
            room[b] -= int(sizes[k])
    return [(np.array(p), n) for p, n in Counter(tuple(b) for b in bins).items()]
