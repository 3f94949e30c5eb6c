"""K-means in several metrics, hierarchical k-means and spectral clustering.

In each round tasks add up what they assign to the centroids (k by d), and the driver gets the sums; small sets are
added up on the driver (see rows). Medians for L1 and Newton steps for chi-square need the members of a cluster; medians
are exact by dimension, Newton steps run on sums that tasks make for the current point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.sources.shared import written

from . import kernels, linalg
from .neighbours import LIMIT, _bytes, _side, against_matrix, block_by_block, dense, spread
from .rows import SMALL, Rows
from .tables import sample_rows

METRICS = {"l2": "l2", "l1": "l1", "chi2": "chi2", "cosine": "dot"}


@dataclass
class KMeans:
    centroids: np.ndarray
    metric: str = "l2"
    errors: list[float] = field(default_factory=list)  # mean distance by round
    sizes: np.ndarray | None = None

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "id long, v array<double>")

    def assign(self, df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        """id, cluster, dis."""
        c = self.centroids if self.metric != "cosine" else -self.centroids
        return against_matrix(df, np.arange(len(c)), c, 1, METRICS[self.metric], qid=key, qv=v).select(F.col("qid").alias("id"), F.col("bid").alias("cluster"), "dis")


def _distances(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    return -kernels.pairwise(x, c, "dot") if metric == "cosine" else kernels.pairwise(x, c, METRICS[metric])


def _round(data: Rows, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, sums and errors by cluster."""

    def sums(x: np.ndarray) -> np.ndarray:
        dis = _distances(x, c, metric)
        at = dis.argmin(1)
        e = kernels.exact(x, c[at], "l2") if metric == "l2" else dis[np.arange(len(x)), at]
        s = np.zeros(c.shape)
        np.add.at(s, at, x)
        return np.concatenate((np.bincount(at, minlength=len(c)), np.bincount(at, e, minlength=len(c)), s.ravel()))

    flat = data.add_up(sums)
    k = len(c)
    return flat[:k], flat[2 * k :].reshape(c.shape), flat[k : 2 * k]


def _medians(data: Rows, c: np.ndarray) -> np.ndarray:
    """Medians of each cluster's members by dimension."""
    return data.medians(lambda x: _distances(x, c, "l1").argmin(1), c)


# The tolerance of a chi-square centroid, relative to its start, and its Newton steps at most.
CHI2_TOLERANCE, CHI2_STEPS = 1e-4, 1000


def _chi2(data: Rows, c: np.ndarray, start: np.ndarray, steps: int = CHI2_STEPS) -> np.ndarray:
    """Newton steps for all clusters and dimensions at once, with sums over the rows for each step."""
    x = np.maximum(start, 0)
    floor = CHI2_TOLERANCE * np.maximum(x, 1e-12)
    for _ in range(steps):

        def slopes(a: np.ndarray, x=x) -> np.ndarray:
            d, dd = np.zeros(c.shape), np.zeros(c.shape)
            at = _distances(a, c, "chi2").argmin(1)
            s = x[at] + a
            s = np.where(s > 0, s, 1.0)
            np.add.at(d, at, (x[at] - a) * (x[at] + 3 * a) / s**2)
            np.add.at(dd, at, 8 * a * a / s**3)
            return np.stack((d, dd)).ravel()

        d, dd = data.add_up(slopes).reshape(2, *c.shape)
        new = x - np.divide(d, dd, out=np.zeros_like(d), where=dd > 0)
        new = np.where(new < 0, x / 2, new)
        moved = np.abs(new - x) > floor
        x = new
        if not moved.any():
            break
    return x


def _split_empty(c: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> int:
    """Give each empty cluster half of another, chosen by n^2 - 1 (a fixed value), by moving both a little apart."""
    empty = np.flatnonzero(n == 0)
    for i in empty:
        p = np.where(n >= 2, n * n - 1, 0.0)
        if not p.sum():
            break
        j = rng.choice(len(n), p=p / p.sum())
        eps = 1e-7 * np.linalg.norm(c[j]) * rng.standard_normal(c.shape[1])
        c[i], c[j] = c[j] + eps, c[j] - eps
        n[i] = n[j] = n[j] / 2
    return len(empty)


def _first(data: DataFrame, df: DataFrame, k: int, init, key: str, v: str, seed: int, metric: str) -> np.ndarray:
    if not isinstance(init, str):
        return np.array(init, dtype=np.float64)
    if init == "first":
        rows = df.orderBy(key).limit(k)
    elif init == "hash":
        rows = sample_rows(df, k, key, seed)
    elif init == "plusplus":
        return _plus_plus(df, k, key, v, seed, metric)
    else:
        raise ValueError(f"unknown init {init}")
    ids, m = _side(rows, key, v)
    if len(ids) < k:
        raise ValueError("fewer vectors than clusters")
    return m[np.argsort(ids)]


def _plus_plus(df: DataFrame, k: int, key: str, v: str, seed: int, metric: str) -> np.ndarray:
    """D^2 sampling from all rows. Each row draws an exponential variable, fixed by key, seed and draw, over its distance to
    what is chosen; the least is a draw in proportion to the distances, and tasks give one row each."""
    kind = METRICS[metric] if metric != "cosine" else "l2"
    rows = df.select(F.col(key).cast("bigint").alias("k"), V.doubles(v).alias("v"))
    held = _side(rows, "k", "v") if _bytes(rows, "v") <= SMALL else None

    def least(ids: np.ndarray, x: np.ndarray, chosen: np.ndarray) -> tuple[float, int, np.ndarray]:
        far = kernels.pairwise(x, chosen, kind).min(1) if len(chosen) else np.ones(len(x))
        drawn = kernels.exponential(ids, seed, len(chosen))
        score = np.where(far > 0, drawn / np.where(far > 0, far, 1.0), 1e300 + 1e290 * drawn)  # a row that is chosen comes last
        at = np.lexsort((ids, score))[0]
        return float(score[at]), int(ids[at]), x[at]

    chosen = np.zeros((0, 0))
    while len(chosen) < k:
        if held is not None:
            row = least(*held, chosen)[2]
        else:

            def run(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
                found = [least(np.asarray(b.column(0)), dense(b.column(1)), chosen) for b in batches if b.num_rows]
                if found:
                    score, i, x = min(found, key=lambda r: r[:2])
                    yield pa.RecordBatch.from_pydict({"score": [score], "k": [i], "v": [x.tolist()]})

            row = np.array(spread(rows).mapInArrow(run, "score double, k long, v array<double>").orderBy("score", "k").first()["v"])
        chosen = np.vstack((chosen.reshape(len(chosen), len(row)), row))
    return chosen


def kmeans(
    df: DataFrame | None, k: int, metric: str = "l2", rounds: int = 30, init="hash", redo: int = 1, normalize: bool = False, seed: int = 0, key: str = "id", v: str = "v", data: Rows | None = None, after: Callable[[int, KMeans], bool | None] | None = None
) -> KMeans:
    """Lloyd's rounds until nothing changes or ``rounds`` are done; the best of ``redo`` runs.

    init: "first" (the smallest keys), "hash" (rows fixed by key and seed), "plusplus", or k given centroids.
    ``errors`` and ``sizes`` refer to the centroids before the last update, as they are measured on assignment.
    ``after`` is called with the number of each round and the model; the run ends if it gives False. ``data`` are the
    rows where the driver has them, with given centroids.
    """
    data = data or Rows(df, v)
    best: KMeans | None = None
    for run in range(redo if isinstance(init, str) else 1):
        rng = np.random.default_rng(seed + run)
        c = _first(data, df, k, init, key, v, seed + run, metric)
        if metric == "cosine":
            c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-300)[:, None]
        model = KMeans(c, metric)
        for _ in range(rounds):
            n, s, e = _round(data, c, metric)
            model.sizes = n.copy()
            model.errors.append(float(e.sum() / max(1, n.sum())))
            if len(model.errors) > 1 and model.errors[-1] == model.errors[-2]:
                break
            filled = n > 0
            new = c.copy()
            new[filled] = s[filled] / n[filled, None]
            if metric == "l1":
                new = _medians(data, c)
            elif metric == "chi2":
                new = np.where(filled[:, None], _chi2(data, c, new), c)
            if normalize or metric == "cosine":
                size = np.abs(new).sum(1) if metric == "l1" else np.linalg.norm(new, axis=1)
                new = new / np.where(size > 0, size, 1.0)[:, None]
            _split_empty(new, n, rng)
            model.centroids = c = new
            if after is not None and after(len(model.errors), model) is False:
                break
        if best is None or model.errors[-1] < best.errors[-1]:
            best = model
    return best


def kmeans_table(df: DataFrame, k: int, **kw) -> DataFrame:
    """cluster, pos, x of the centroids."""
    c = kmeans(df, k, **kw).centroids
    return df.sparkSession.createDataFrame([(i, j, float(x)) for i, row in enumerate(c) for j, x in enumerate(row)], "cluster long, pos long, x double")


@dataclass
class Hierarchy:
    """Centroids of levels; a node's number is parent * branches + child."""

    levels: list[dict[int, np.ndarray]]  # by node of the level above
    branches: int

    def table(self, spark) -> DataFrame:
        """level, node (of the level above), child, v."""
        rows = [(k, node, i, [float(x) for x in c]) for k, level in enumerate(self.levels) for node, m in level.items() for i, c in enumerate(m)]
        return spark.createDataFrame(rows, "level int, node long, child int, v array<double>")

    @classmethod
    def from_table(cls, df: DataFrame) -> Hierarchy:
        rows = df.orderBy("level", "node", "child").collect()  # the centroids
        levels: list[dict[int, list]] = [{} for _ in range(max(r["level"] for r in rows) + 1)]
        for r in rows:
            levels[r["level"]].setdefault(r["node"], []).append(r["v"])
        return cls([{k: np.array(m) for k, m in level.items()} for level in levels], max(r["child"] for r in rows) + 1)

    def quantize(self, df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        """id, leaf."""
        shared = df.sparkSession.sparkContext.broadcast((self.levels, self.branches))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, branches = shared.value
            for batch in batches:
                if batch.num_rows:
                    x, node = dense(batch.column(1)), np.zeros(batch.num_rows, np.int64)
                    for level in levels:
                        child = np.zeros(len(x), np.int64)
                        for parent in np.unique(node):
                            at = node == parent
                            child[at] = kernels.pairwise(x[at], level[int(parent)], "l2").argmin(1)
                        node = node * branches + child
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node)], names=["id", "leaf"])

        return spread(df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v"))).mapInArrow(run, "id long, leaf long")


def hierarchical(df: DataFrame, branches: int, levels: int, rounds: int = 10, init="hash", seed: int = 0, key: str = "id", v: str = "v") -> Hierarchy:
    """branches^levels leaves, each level learnt within the nodes of the one above."""
    made = Hierarchy([], branches)
    for _ in range(levels):
        nodes = made.quantize(df, key, v) if made.levels else df.select(F.col(key).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("leaf"))
        placed = df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v")).join(nodes, "id")
        level = {}
        for node in sorted(r["leaf"] for r in nodes.select("leaf").distinct().collect()):  # at most branches^level rows
            level[node] = kmeans(placed.where(F.col("leaf") == node), branches, rounds=rounds, init=init, seed=seed, key="id", v="v").centroids
        made.levels.append(level)
    return made


def gaussian_kernel(df: DataFrame, sigma: float, key: str = "id", v: str = "v", limit: int = LIMIT) -> DataFrame:
    """aid, bid, x = exp(-distance^2 / (2 sigma^2)) for all pairs, zero on the diagonal; rows go to the tasks in blocks of at most ``limit`` bytes."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v"))

    def against(part: DataFrame):
        shared = df.sparkSession.sparkContext.broadcast(_side(part, "id", "v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for batch in batches:
                own, x = np.asarray(batch.column(0)), dense(batch.column(1))
                for i, j in kernels.tiles(len(own), len(ids)):
                    a = kernels.gaussian(x[i], m[j], sigma)
                    a[own[i][:, None] == ids[j][None]] = 0
                    for row, column, places in kernels.by_value(a):
                        yield pa.RecordBatch.from_arrays([pa.array(own[i][row]), pa.array(ids[j][column]), pa.array(a.ravel()[places])], names=["aid", "bid", "x"])

        return spread(rows).mapInArrow(run, "aid long, bid long, x double"), shared

    return block_by_block(rows, "id", _bytes(rows, "v"), limit, against)


#: Rows of the kernel that are made together; columns are four times as many, so that a tile stays in the cache.
TILE = 256
#: Vectors up to which the kernel is one matrix on the driver.
DENSE = 5_000


def _kernel_sums(rows: DataFrame, sigma: float, columns: list[str], weigh: Callable[..., np.ndarray], width: int, limit: int) -> DataFrame:
    """id, y: sums of kernel times weigh(columns) over all other rows. Blocks of rows are sent to the tasks, one after the other."""

    def against(block: DataFrame):
        t = block.select("id", "v", *columns).toArrow().combine_chunks()
        held = [dense(t[c].combine_chunks()) if t.num_rows else np.zeros((0, 1)) for c in ("v", *columns)]
        ids = np.asarray(t["id"].combine_chunks()) if t.num_rows else np.zeros(0, np.int64)
        shared = rows.sparkSession.sparkContext.broadcast((ids, held[0], weigh(*held[1:])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, e = shared.value
            order = np.argsort(ids, kind="stable")
            ids, m, e = ids[order], m[order], np.ascontiguousarray(e[order])
            for whole in batches:
                for i in range(0, whole.num_rows if len(ids) else 0, TILE):
                    batch = whole.slice(i, TILE)
                    own, q = np.asarray(batch.column(0)), dense(batch.column(1))
                    y = np.zeros((len(q), e.shape[1]))
                    for at in range(0, len(ids), 4 * TILE):
                        some = slice(at, at + 4 * TILE)
                        a = kernels.gaussian(q, m[some], sigma)
                        first, last = (np.searchsorted(ids[some], own, x) for x in ("left", "right"))
                        for again in range((last - first).max()):
                            r = np.flatnonzero(first + again < last)
                            a[r, first[r] + again] = 0
                        y += a @ e[some]
                    offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=["id", "y"])

        return spread(rows.select("id", "v")).mapInArrow(run, "id long, y array<double>"), shared

    found = block_by_block(rows, "id", sum(_bytes(rows, c) for c in ("v", *columns)), limit, against)
    return found.groupBy("id").agg(F.array(*[F.sum(F.get("y", F.lit(j))) for j in range(width)]).alias("y"))


def _leading(df: DataFrame, k: int, sigma: float, seed: int, limit: int, steps: int, tolerance: float) -> DataFrame:
    """id, e: the k leading eigenvectors of the normalised kernel, by Rayleigh-Ritz over a block Krylov space with some vectors to spare.

    Rows keep the start and all products so far, z; directions are combinations of those, and only the Gram matrix of z
    comes to the driver. After ``KEPT`` products the space starts anew from the best combinations."""
    p = k + 8
    noise = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(2**40)) / 2.0**39 - 1.0)
    rows = written(df.withColumn("one", F.array(F.lit(1.0))), "kernel")
    degrees = _kernel_sums(rows, sigma, ["one"], lambda one: one, 1, limit)
    rows = written(rows.join(degrees, "id").select("id", "v", F.array(1 / F.sqrt(F.greatest(F.get("y", F.lit(0)), F.lit(1e-300)))).alias("s"), noise.alias("z")), "kernel")
    gram = linalg.moments(rows, "z").gram
    basis = np.zeros((p, 0))  # the directions that have been multiplied, as combinations of z
    turn = _orthonormal(gram, np.eye(p))
    before = None
    for _ in range(steps):
        y = _kernel_sums(rows, sigma, ["s", "z"], lambda s, z, turn=turn: s * (z @ turn), turn.shape[1], limit)
        scaled = F.transform("y", lambda x: x * F.get("s", F.lit(0)))
        rows = written(rows.join(y, "id").select("id", "v", "s", F.concat("z", scaled).alias("z")), "kernel")
        gram = linalg.moments(rows, "z").gram
        grow = lambda c: np.vstack((c, np.zeros((len(gram) - len(c), c.shape[1]))))
        basis = np.hstack((grow(basis), grow(turn)))
        images = np.eye(len(gram))[:, p:]  # products stand in the order of their directions
        ritz = basis.T @ gram @ images
        values, vectors = linalg.eigen((ritz + ritz.T) / 2)
        found = basis @ vectors[:k].T
        if before is not None and np.abs(values[:k] - before[:k]).max() <= tolerance:
            break
        before = values
        if basis.shape[1] >= KEPT * p:
            rows = linalg.project(rows, (basis @ vectors[:p].T).T, key="id", v="z").withColumnRenamed("p", "z").join(rows.select("id", "v", "s"), "id")
            rows = written(rows.select("id", "v", "s", "z"), "kernel")
            gram, basis, found = linalg.moments(rows, "z").gram, np.zeros((p, 0)), np.eye(p)[:, :k]
            turn, before = _orthonormal(gram, np.eye(p)), None  # the next values are these once more
            continue
        rest = images[:, -turn.shape[1] :]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ gram @ rest)
        turn = _orthonormal(gram, rest, gram[-turn.shape[1] :, -turn.shape[1] :].trace())
        if not turn.shape[1]:  # the space holds all its products
            break
    return linalg.project(rows, found.T, key="id", v="z").select("id", F.col("p").alias("e"))


#: Products whose directions are held together.
KEPT = 24


def _orthonormal(gram: np.ndarray, c: np.ndarray, size: float = 0.0) -> np.ndarray:
    """Combinations that span those in the columns of c, orthonormal under gram, less those that are nothing beside ``size``."""
    w, x = np.linalg.eigh(c.T @ gram @ c)
    some = w > 1e-13 * max(size, w[-1], 1e-300)
    return (c @ x)[:, some] / np.sqrt(w[some])


def spectral(df: DataFrame, k: int, sigma: float, rounds: int = 30, seed: int = 0, key: str = "id", v: str = "v", dense_rows: int = DENSE, limit: int = LIMIT, steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """id, cluster from the normalised kernel's k leading eigenvectors, rows scaled to unit length.

    Up to ``dense_rows`` vectors the kernel is a matrix on the driver; beyond, it is never held: its products with some
    vectors are made in blocks, until the eigenvalues stand still."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v"))
    if rows.count() > dense_rows:
        found = _leading(rows, k, sigma, seed, limit, steps, tolerance)
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
        embedded = written(found.select("id", F.transform("e", lambda x: x / F.greatest(norm, F.lit(1e-300))).alias("v")), "embedded")
    else:
        ids, m = _side(rows, "id", "v")
        a = np.exp(-kernels.pairwise(m, m, "l2") / (2 * sigma * sigma))
        np.fill_diagonal(a, 0)
        s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-300))
        _, e = linalg.eigen(a * s[:, None] * s[None], k)
        unit = e.T / np.maximum(np.linalg.norm(e.T, axis=1), 1e-300)[:, None]
        embedded = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, unit, strict=True)], "id long, v array<double>")
    return kmeans(embedded, k, rounds=rounds, init="plusplus", redo=5, seed=seed).assign(embedded).select("id", "cluster")
