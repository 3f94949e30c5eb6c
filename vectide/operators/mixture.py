"""Diagonal Gaussian mixtures by expectation maximisation, and Fisher vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V

from . import clustering
from .neighbours import dense, spread
from .rows import Rows

#: Terms of a softmax this far below the greatest (in nats) are zero.
CUT = 16.636
FLOOR = 1e-10


@dataclass
class Mixture:
    w: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray  # variances
    likelihood: list[float] = field(default_factory=list)

    def log_posteriors(self, x: np.ndarray) -> np.ndarray:
        s = 1 / self.sigma
        quad = (x * x) @ s.T - 2 * x @ (self.mu * s).T + (self.mu**2 * s).sum(1)
        return np.log(np.maximum(self.w, 1e-300)) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(self.sigma).sum(1) + quad)

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(component | x), and log p(x)."""
        log = self.log_posteriors(x)
        top = log.max(1, keepdims=True)
        p = np.where(log - top < -CUT, 0.0, np.exp(log - top))
        total = p.sum(1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(self.w[i]), [float(x) for x in self.mu[i]], [float(x) for x in self.sigma[i]]) for i in range(len(self.w))], "comp long, w double, mu array<double>, sigma array<double>")

    @classmethod
    def from_table(cls, df: DataFrame) -> Mixture:
        rows = df.orderBy("comp").collect()
        return cls(np.array([r["w"] for r in rows]), np.array([r["mu"] for r in rows]), np.array([r["sigma"] for r in rows]))

    def assign(self, df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        """key, p (posteriors)."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p, _ = shared.value.posteriors(dense(batch.column(1)))
                    offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=["id", "p"])

        return spread(df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v"))).mapInArrow(run, "id long, p array<double>")


def _statistics(data: Rows, g: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Sums of p, p x and p x^2 by component, the log likelihood and n."""
    k, d = g.mu.shape

    def sums(x: np.ndarray) -> np.ndarray:
        p, log = g.posteriors(x)
        return np.concatenate((p.sum(0), (p.T @ x).ravel(), (p.T @ (x * x)).ravel(), [log.sum(), len(x)]))

    flat = data.add_up(sums)
    return flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : -2].reshape(k, d), float(flat[-2]), int(flat[-1])


def _split_empty(g: Mixture) -> None:
    """An empty component takes half of a neighbour, apart along its widest dimension."""
    k = len(g.w)
    for j in np.flatnonzero(g.w <= 0):
        i = (j + 1_000_003) % k
        while g.w[i] <= 0 and i != j:
            i = (i + 1) % k
        if i == j:
            return
        wide = int(g.sigma[i].argmax())
        g.mu[j], g.sigma[j] = g.mu[i].copy(), g.sigma[i].copy()
        step = 0.5 * np.sqrt(g.sigma[i][wide])
        g.mu[j][wide] += step
        g.mu[i][wide] -= step
        g.w[j] = g.w[i] = g.w[i] / 2


def fit(df: DataFrame, k: int, rounds: int = 20, weights: bool = True, one_sigma: bool = False, init="hash", seed: int = 0, tolerance: float = 0.0, key: str = "id", v: str = "v") -> Mixture:
    """Starts from k-means (or given centroids): variances are its mean error, weights equal."""
    model = clustering.kmeans(df, k, rounds=20, init=init, seed=seed, key=key, v=v) if isinstance(init, str) else clustering.kmeans(df, k, rounds=1, init=init, key=key, v=v)
    mu = model.centroids if isinstance(init, str) else np.array(init, dtype=np.float64)
    data = Rows(df, v)
    d = mu.shape[1]
    g = Mixture(np.full(k, 1 / k), mu.copy(), np.full(mu.shape, max(model.errors[-1] / d, FLOOR)))
    for _ in range(rounds):
        p, px, pxx, log, n = _statistics(data, g)
        g.likelihood.append(log / max(1, n))
        filled = p > 0
        safe = np.where(filled, p, 1.0)[:, None]
        old = g.mu
        # variances are around the means before the update
        sigma = (pxx + old * (old * p[:, None] - 2 * px)) / safe
        if one_sigma:
            sigma = np.repeat(sigma.mean(1, keepdims=True), d, 1)
        g.mu = np.where(filled[:, None], px / safe, old)
        g.sigma = np.maximum(np.where(filled[:, None], sigma, g.sigma), FLOOR)
        g.w = p / p.sum() if weights else np.where(filled, 1.0, 0.0) / k
        if (g.w <= 0).any():
            _split_empty(g)
        if len(g.likelihood) > 1 and abs(g.likelihood[-1] - g.likelihood[-2]) <= tolerance:
            break
    return g


def fisher_size(g: Mixture, include: tuple[str, ...] = ("mu",)) -> int:
    k, d = g.mu.shape
    return ("w" in include) * (k - 1) + ("mu" in include) * k * d + ("sigma" in include) * k * d + ("one_sigma" in include) * k


def fisher_from_sums(g: Mixture, n: int, p: np.ndarray, px: np.ndarray, pxx: np.ndarray, include: tuple[str, ...] = ("mu",), normalize: bool = True) -> np.ndarray:
    """Gradients of the log likelihood, in the order w, mu, sigma, one sigma, scaled by the root of the Fisher information."""
    parts, (k, d) = [], g.mu.shape
    w = g.w
    if "w" in include:
        parts.append((p[1:] / w[1:] - p[0] / w[0]) / np.sqrt(n * (1 / w[1:] + 1 / w[0])))
    if "mu" in include:
        x = (px - g.mu * p[:, None]) / g.sigma
        parts.append((x / np.sqrt(n * w[:, None] / g.sigma) if normalize else x).ravel())
    if "sigma" in include:
        x = pxx - 2 * g.mu * px + p[:, None] * (g.mu**2 - g.sigma)
        parts.append((x / (g.sigma * np.sqrt(2 * n * w[:, None])) if normalize else x * g.sigma**-1.5).ravel())
    if "one_sigma" in include:
        x = ((pxx - 2 * g.mu * px + g.mu**2 * p[:, None]) / g.sigma - p[:, None]) / np.sqrt(g.sigma)
        x = x.sum(1)
        parts.append(x / np.sqrt(2 * d * n * w / g.sigma[:, 0]) if normalize else x)
    return np.concatenate(parts)


def fisher(df: DataFrame, g: Mixture, group: str, include: tuple[str, ...] = ("mu",), normalize: bool = True, v: str = "v") -> DataFrame:
    """group, n, fv: the Fisher vector of each group's vectors. Tasks add up statistics by group; only those are shuffled.

    For one vector to a group (per-element Fisher vectors) group by its key.
    """
    shared = df.sparkSession.sparkContext.broadcast(g)
    k, d = g.mu.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch.column(1))
            p, _ = shared.value.posteriors(x)
            flat = np.concatenate((np.ones((len(x), 1)), p, (p[:, :, None] * x[:, None]).reshape(len(x), -1), (p[:, :, None] * (x * x)[:, None]).reshape(len(x), -1)), 1)
            codes = batch.column(0).dictionary_encode()
            at = np.asarray(codes.indices)
            out = np.zeros((len(codes.dictionary), flat.shape[1]))
            np.add.at(out, at, flat)
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([codes.dictionary, pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[group, "s"])

    kind = df.schema[group].dataType.simpleString()
    parts = spread(df.where(F.col(group).isNotNull()).select(group, V.doubles(v).alias("v"))).mapInArrow(sums, f"{group} {kind}, s array<double>")
    added = parts.select(group, F.posexplode("s").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("x")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("s"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = dense(batch.column(1))
                fv = [fisher_from_sums(shared.value, int(r[0]), r[1 : 1 + k], r[1 + k : 1 + k + k * d].reshape(k, d), r[1 + k + k * d :].reshape(k, d), include, normalize).tolist() for r in s]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s[:, 0].astype(np.int64)), pa.array(fv)], names=[group, "n", "fv"])

    return added.mapInArrow(close, f"{group} {kind}, n long, fv array<double>")


def fisher_spatial(p: np.ndarray, places: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a spatial model by component: p (n, k) posteriors, places (n, s), mean and variance (k, s); for the mean and the variance."""
    n = len(p)
    q, ql, qll = p.sum(0)[:, None], p.T @ places, p.T @ (places * places)
    return (ql - q * mean) / n, (-qll + 2 * ql * mean + q * (variance - mean**2)) / n
