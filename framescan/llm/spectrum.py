"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The block-diagonal factor D of L D Lᵀ = A - s I has as many negative
eigenvalues as A has below s (Sylvester's law of inertia).  Bisection on that
count isolates one leading eigenvalue after the other, Rayleigh quotient
iteration inside the interval finds it with its vector, and counts a hair above
and below certify that it is the one of that number.  Eigenvalues that no shift
of double precision tells apart are found as one cluster, with an orthonormal
basis of their common space.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + 17**0.5) / 8  # Bunch and Kaufman's bound between pivots of one and of two rows
ROUNDS = 30


class Inertia:
    """L D Lᵀ of a symmetric matrix with its rows in an order that keeps L small."""

    def __init__(self, a: np.ndarray):
        a = a.copy()
        n = len(a)
        tiny = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
        self.order = np.arange(n)
        self.lower = np.eye(n)
        self.blocks: list[tuple[int, int]] = []
        self.d = np.zeros((n, n))
        k = 0
        while k < n:
            size = self._pivot(a, k)
            b = a[k : k + size, k : k + size].copy()
            if size == 1 and abs(b[0, 0]) < tiny:
                b[0, 0] = tiny  # the shift is an eigenvalue itself: count it as not below
            rest = slice(k + size, n)
            l = np.linalg.solve(b, a[k : k + size, rest]).T
            a[rest, rest] -= l @ b @ l.T
            self.lower[rest, k : k + size] = l
            self.d[k : k + size, k : k + size] = b
            self.blocks.append((k, size))
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]
            self.lower[[i, j], : min(i, j)] = self.lower[[j, i], : min(i, j)]

    def _pivot(self, a: np.ndarray, k: int) -> int:
        """Bring a pivot of one or two rows to the front; its size."""
        n = len(a)
        if k == n - 1:
            return 1
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax())
        if below[r - k - 1] == 0 or abs(a[k, k]) >= ALPHA * below[r - k - 1]:
            return 1
        row = np.abs(a[k:, r])
        row[r - k] = 0
        if abs(a[k, k]) * row.max() >= ALPHA * below[r - k - 1] ** 2:
            return 1
        if abs(a[r, r]) >= ALPHA * row.max():
            self._swap(a, k, r)
            return 1
        self._swap(a, k + 1, r)
        return 2

    @property
    def negative(self) -> int:
        return sum(int((np.linalg.eigvalsh(self.d[k : k + m, k : k + m]) < 0).sum()) for k, m in self.blocks)

    def solve(self, v: np.ndarray) -> np.ndarray:
        x = v[self.order].copy()
        for k, m in self.blocks:
            x[k + m :] -= self.lower[k + m :, k : k + m] @ x[k : k + m]
        for k, m in self.blocks:
            x[k : k + m] = np.linalg.solve(self.d[k : k + m, k : k + m], x[k : k + m])
        for k, m in reversed(self.blocks):
            x[k : k + m] -= self.lower[k + m :, k : k + m].T @ x[k + m :]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues not below ``shift``."""
    return len(a) - Inertia(a - shift * np.eye(len(a))).negative


def isolate(a: np.ndarray, number: int, low: float, high: float, floor: float) -> tuple[float, float, int]:
    """(low, high, m): an interval with ``number - 1`` eigenvalues above it that holds m, those from ``number`` on; m is 1 unless they are closer than ``floor``."""
    while True:
        inside = above(a, low) - number + 1
        if inside == 1 or high - low <= floor:
            return low, high, inside
        middle = (low + high) / 2
        n = above(a, middle)
        if n >= number:
            low = middle
        else:
            high = middle


def _rayleigh(a: np.ndarray, low: float, high: float, found: np.ndarray, start: np.ndarray, floor: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of the interval; None if it leaves it."""
    n, shift, v = len(a), (low + high) / 2, start
    best = None
    for step in range(ROUNDS):
        v = Inertia(a - shift * np.eye(n)).solve(v)
        v = v - found @ (found.T @ v)
        length = np.linalg.norm(v)
        if not np.isfinite(length) or length == 0:
            return best
        v = v / length
        value = float(v @ a @ v)
        error = float(np.linalg.norm(a @ v - value * v))
        if best is not None and error >= best[2]:
            break
        inside = low - floor <= value <= high + floor
        if inside:
            best = (value, v, error)
        elif best is None and step >= 3:
            return None
        # the quotient is the next shift once its error bound lies inside the interval too
        shift = value if inside and (error < (high - low) / 4 or high - low <= 4 * floor) else (low + high) / 2
        if error == 0:
            break
    return None if best is None else best[:2]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as columns; each vector's largest component is positive."""
    n = len(a)
    count = min(count, n)
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    values, vectors = np.zeros(count), np.eye(n)[:, :count]
    if size == 0:
        return values, vectors
    floor = 8 * np.finfo(float).eps * size * n**0.5
    draw = np.random.default_rng(7)
    k = 0
    while k < count:
        low, high, m = isolate(a, k + 1, -size - floor, size + floor, floor)
        wide = (low, high)
        for j in range(m):
            if k == count:
                break
            found, hair = vectors[:, :k], floor
            while True:
                pair = _rayleigh(a, *wide, found, draw.standard_normal(n), hair)
                # counts certify the number: no more than those before it (and the rest of a cluster) lie above, it and they not below
                if pair is not None and above(a, pair[0] + hair) <= k + m - 1 and above(a, pair[0] - hair) > k:
                    break
                if wide[1] - wide[0] > floor:
                    wide = _halve(a, k + 1, *wide)
                else:
                    hair *= 2
            values[k], v = pair
            vectors[:, k] = v * np.sign(v[np.abs(v).argmax()])
            k += 1
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _halve(a: np.ndarray, number: int, low: float, high: float) -> tuple[float, float]:
    middle = (low + high) / 2
    return (middle, high) if above(a, middle) >= number else (low, middle)
