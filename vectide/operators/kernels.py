"""Numpy kernels on blocks of vectors; no Spark here."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

METRICS = ("l2", "l1", "chi2", "chi2_abs", "intersection", "dot")
#: Elements of a block of pairwise differences.
AT_ONCE = 1 << 22
#: Elements of a tile of pairs that are put in order of value, and its columns: ids of so many make a small dictionary in a file.
TILE, WIDE = 1 << 22, 8192
#: Pairs of a tile that are handed on together.
PAIRS = 1 << 18


def pairwise(q: np.ndarray, b: np.ndarray, metric: str = "l2") -> np.ndarray:
    """(queries, base) distances in double precision; squared for l2."""
    if metric == "l2":
        return np.maximum(0.0, (q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (q @ b.T))
    if metric == "dot":
        return q @ b.T
    out = np.empty((len(q), len(b)))
    step = max(1, AT_ONCE // max(1, b.size))
    for i in range(0, len(q), step):
        x, y = q[i : i + step, None], b[None]
        if metric == "l1":
            out[i : i + step] = np.abs(x - y).sum(2)
        elif metric == "intersection":
            out[i : i + step] = np.minimum(x, y).sum(2)
        elif metric in ("chi2", "chi2_abs"):
            s = x + y if metric == "chi2" else np.abs(x) + np.abs(y)
            out[i : i + step] = np.divide((x - y) ** 2, s, out=np.zeros(np.broadcast_shapes(x.shape, y.shape)), where=s != 0).sum(2)
        else:
            raise ValueError(f"unknown metric {metric}")
    return out


def gaussian(q: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    """exp(-distance^2 / (2 sigma^2)) of all pairs; by products, unless the vectors are so long that these cancel."""
    half, other = (q * q).sum(1) / 2, (b * b).sum(1) / 2
    if (half.max(initial=0) + other.max(initial=0)) * q.shape[1] < 1e4 * sigma * sigma:
        a = np.hstack((q, half[:, None], np.ones((len(q), 1)))) @ np.hstack((b, -np.ones((len(b), 1)), -other[:, None])).T
        a /= sigma * sigma
        return np.exp(np.minimum(a, 0, out=a), out=a)
    out = np.empty((len(q), len(b)))
    step = max(1, AT_ONCE // max(1, b.size))
    for i in range(0, len(q), step):
        out[i : i + step] = np.exp(exact(q[i : i + step, None], b[None], "l2") / (-2 * sigma * sigma))
    return out


def tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Rows and columns of the tiles of an n by m matrix."""
    cut = lambda size, most: list(itertools.starmap(slice, itertools.pairwise(np.linspace(0, size, -(-size // most) + 1).astype(int).tolist())))
    columns = cut(m, WIDE)
    return ((i, j) for j in columns for i in cut(n, max(1, TILE * len(columns) // m)))


def by_value(y: np.ndarray, there: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and flat places of a matrix (where ``there``, flat, is true) in the order of its values, in parts.

    Columnar files then hold equal values as runs, and take less than half of the bytes that they take by row and column."""
    with np.errstate(over="ignore"):
        bits = y.astype(np.float32).ravel().view(np.int32).astype(np.int64)
    np.bitwise_xor(bits, 0x7FFFFFFF, out=bits, where=bits < 0)
    bits <<= 32
    bits |= np.arange(bits.size)
    if there is not None:
        bits = bits[there]
    bits.sort()
    bits &= 0xFFFFFFFF
    for at in range(0, len(bits), PAIRS):
        places = bits[at : at + PAIRS]
        yield *np.divmod(places, y.shape[1]), places


def exact(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, without the cancellation of the expanded square."""
    if metric == "l2":
        return ((q - b) ** 2).sum(-1)
    if metric == "dot":
        return (q * b).sum(-1)
    if metric == "l1":
        return np.abs(q - b).sum(-1)
    if metric == "intersection":
        return np.minimum(q, b).sum(-1)
    s = q + b if metric == "chi2" else np.abs(q) + np.abs(b)
    return np.divide((q - b) ** 2, s, out=np.zeros_like(s), where=s != 0).sum(-1)


def top_k(q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, metric: str = "l2", weights: np.ndarray | None = None, slack: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For each query, positions of the k smallest in ``b`` by (distance, id), and the distances."""
    n, k = len(b), min(k, len(b))
    pos, dis = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    step = max(1, (1 << 23) // max(1, n))
    for i in range(0, len(q), step):
        d = pairwise(q[i : i + step], b, metric)
        if weights is not None:
            d = d * weights
        m = min(n, k + slack)
        at = np.argpartition(d, m - 1, axis=1)[:, :m] if m < n else np.broadcast_to(np.arange(n), d.shape)
        e = exact(q[i : i + step, None], b[at], metric)
        if weights is not None:
            e = e * weights[at]
        order = np.lexsort((ids[at], e), axis=1)[:, :k]
        pos[i : i + step], dis[i : i + step] = np.take_along_axis(at, order, 1), np.take_along_axis(e, order, 1)
    return pos, dis


def exponential(ids: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """An exponential variable for each id, seed and draw: mixed bits as a uniform variable."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed * 1_000_003 + draw + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)


def chi2_centroid(a: np.ndarray, tolerance: float = 1e-4, rounds: int = 1000) -> np.ndarray:
    """Column-wise x that makes the sum of (x - a)^2 / (x + a) least, for a >= 0; Newton steps, halved where they'd go below zero."""
    mean = a.mean(0)
    x = mean.copy()
    live = mean > 0
    for _ in range(rounds):
        if not live.any():
            break
        s = x[live] + a[:, live]
        s = np.where(s > 0, s, 1.0)
        d = ((x[live] - a[:, live]) * (x[live] + 3 * a[:, live]) / s**2).sum(0)
        dd = (8 * a[:, live] ** 2 / s**3).sum(0)
        new = x[live] - np.divide(d, dd, out=np.zeros_like(d), where=dd > 0)
        new = np.where(new < 0, x[live] / 2, new)
        moved = np.abs(new - x[live]) > tolerance * mean[live]
        x[live] = new
        at = np.flatnonzero(live)
        live[at[~moved]] = False
    return x
