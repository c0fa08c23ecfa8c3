"""Leading eigenvalues and eigenvectors of a symmetric matrix: Householder, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Eigenvalues nearer than this share of the norm are a cluster: their vectors are made orthogonal to each other.
CLUSTER = 1e-3
ITERATIONS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal and the unit vectors of the reflections that lead to them, in order."""
    a = np.array(matrix, np.float64)
    n = len(a)
    reflections = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or not np.any(v[1:]):
            reflections.append(np.zeros(0))
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        reflections.append(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w = 2 * (w - (v @ w) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        column = a[k + 1 :, k]
        column -= 2 * (v @ column) * v
        a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, second: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: the number of eigenvalues below each x, as signs of the pivots of T - x."""
    tiny = np.finfo(np.float64).tiny / EPS
    squares = second**2
    pivot = diagonal[0] - x
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - x - squares[i - 1] / pivot
        count += pivot < 0
    return count


def largest(diagonal: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all at once."""
    n = len(diagonal)
    radius = np.concatenate([[0], np.abs(second)]) + np.concatenate([np.abs(second), [0]])
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    scale = max(abs(low[0]), abs(high[0]))
    low, high = low - 4 * EPS * scale, high + 4 * EPS * scale
    rank = n - 1 - np.arange(k)  # so many eigenvalues lie below the one sought
    while np.any(high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + np.finfo(np.float64).tiny):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        under = below(diagonal, second, middle) <= rank
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low + (high - low) / 2


def solver(diagonal: np.ndarray, second: np.ndarray, shift: float, least: float):
    """A function that solves (T - shift) y = b, by elimination with row exchanges."""
    n = len(diagonal)
    main = diagonal - shift
    upper = np.concatenate([second, [0.0]])
    upper2 = np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        under = second[i]
        if abs(main[i]) >= abs(under):
            factor[i] = under / main[i] if main[i] else 0.0
            main[i + 1] -= factor[i] * upper[i]
        else:
            swapped[i] = True
            factor[i] = main[i] / under
            main[i] = under
            upper[i], main[i + 1] = main[i + 1], upper[i] - factor[i] * main[i + 1]
            if i + 1 < n - 1:
                upper2[i] = upper[i + 1]
                upper[i + 1] = -factor[i] * upper2[i]
    main = np.where(np.abs(main) < least, np.copysign(least, main), main)

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            rest = y[i] - (upper[i] * y[i + 1] if i + 1 < n else 0) - (upper2[i] * y[i + 2] if i + 2 < n else 0)
            y[i] = rest / main[i]
        return y

    return solve


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The min(k, n) largest eigenvalues, falling, and their unit eigenvectors as columns."""
    n = len(matrix)
    k = min(k, n)
    size = float(np.abs(matrix).max(initial=0))
    if k == 0 or size == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    matrix = matrix / size
    diagonal, second, reflections = tridiagonal(matrix)
    values = largest(diagonal, second, k)
    norm = max(np.abs(diagonal).max() + (2 * np.abs(second).max() if n > 1 else 0), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(0)
    vectors = np.zeros((n, k))
    start = 0
    shift = np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            start = j
        shift = min(values[j], shift - 4 * EPS * norm) if j > start else values[j]  # equal values get shifts of their own
        solve = solver(diagonal, second, shift, EPS * norm)
        cluster = vectors[:, start:j]
        y = rng.normal(size=n)
        y /= np.linalg.norm(y)
        for _ in range(ITERATIONS):
            y = solve(y)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= cluster @ (cluster.T @ y)
            y /= np.linalg.norm(y)
            off = diagonal * y - values[j] * y
            off[:-1] += second * y[1:]
            off[1:] += second * y[:-1]
            if np.abs(off).max() <= 4 * EPS * norm:
                break
        vectors[:, j] = y
    for number in range(len(reflections) - 1, -1, -1):
        v = reflections[number]
        if len(v):
            vectors[number + 1 :] -= 2 * np.outer(v, v @ vectors[number + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)  # Rayleigh quotients
    order = np.argsort(-values, kind="stable")
    return values[order] * size, vectors[:, order]
