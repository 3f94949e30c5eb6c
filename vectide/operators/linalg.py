"""Matrices whose rows are the vectors of a DataFrame.

Sums over rows (Gram matrices, means) are made in the tasks, one partial result each, and added up by position; what
comes to the driver is d by d. Decompositions of that happen there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions import vectors as V

from . import kernels
from .neighbours import LIMIT, dense, spread
from .rows import Rows


def random_orthogonal(d: int, seed: int = 0) -> np.ndarray:
    """Q of a Gaussian matrix, with a positive diagonal of R so that it is unique."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def hadamard(d: int) -> np.ndarray:
    if d & (d - 1):
        raise ValueError("the order must be a power of two")
    i = np.arange(d)
    return np.where(np.bitwise_count(i[:, None] & i[None]) % 2, -1.0, 1.0)


@dataclass
class Moments:
    """Mergeable sums of vectors: number, sum, and sum of outer products."""

    n: int
    total: np.ndarray
    gram: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def merge(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.gram + other.gram)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def covariance(self, unbiased: bool = False, centered: bool = False) -> np.ndarray:
        """Over n, or n - 1; ``centered`` takes the mean as zero."""
        c = self.gram / self.n - (0 if centered else np.outer(self.mean, self.mean))
        return c * self.n / (self.n - 1) if unbiased else c


def moments(df: DataFrame, v: str = "v") -> Moments:
    flat = Rows(df, v).add_up(lambda x: np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())))
    if not len(flat) or not flat[0]:
        raise ValueError("no vectors")
    d = int(((4 * len(flat) - 3) ** 0.5 - 1) / 2 + 0.5)  # 1 + d + d * d numbers
    return Moments(int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d))


def covariance_table(df: DataFrame, v: str = "v", unbiased: bool = False) -> DataFrame:
    """i, j, c."""
    c = moments(df, v).covariance(unbiased)
    return df.sparkSession.createDataFrame([(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))], "i long, j long, c double")


def eigen(m: np.ndarray, n: int | None = None, largest: bool = True, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and rows of eigenvectors of a symmetric matrix (of m x = w B x with ``second`` = B), in order; the largest element of each is positive."""
    if second is None:
        w, x = np.linalg.eigh(m)
    else:
        root = np.linalg.inv(np.linalg.cholesky(second))
        w, x = np.linalg.eigh(root @ m @ root.T)
        x = root.T @ x
    order = np.argsort(w)[::-1] if largest else np.argsort(w)
    w, x = w[order][:n], x.T[order][:n]
    return w, x * np.sign(x[np.arange(len(x)), np.abs(x).argmax(1)])[:, None]


@dataclass
class PCA:
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a row each
    n: int

    @property
    def singular_values(self) -> np.ndarray:
        """Of the centred data."""
        return np.sqrt(np.maximum(0, self.values) * self.n)

    def project(self, df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        return project(df, self.vectors, self.mean, key, v)


def pca(df: DataFrame, n: int | None = None, v: str = "v", unbiased: bool = False) -> PCA:
    m = moments(df, v)
    w, x = eigen(m.covariance(unbiased), n)
    return PCA(m.mean, w, x, m.n)


def svd(df: DataFrame, n: int, v: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """The n largest singular values and right singular vectors (rows) of the matrix of all vectors."""
    w, x = eigen(moments(df, v).gram, n)
    return np.sqrt(np.maximum(0, w)), x


def left_singular(df: DataFrame, values: np.ndarray, vectors: np.ndarray, key: str = "id", v: str = "v") -> DataFrame:
    return project(df, vectors / np.where(values > 0, values, 1.0)[:, None], key=key, v=v)


def project(df: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, key: str = "id", v: str = "v") -> DataFrame:
    """key, p = matrix (v - mean); the matrix has a row for each output."""
    shared = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(matrix.T), mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mean = shared.value
        for batch in batches:
            if batch.num_rows:
                x = dense(batch.column(1))
                y = (x if mean is None else x - mean) @ m
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[key, "p"])

    return spread(df.select(key, V.doubles(v).alias("v"))).mapInArrow(run, df.select(key, V.doubles(v).alias("p")).schema)


def center(df: DataFrame, key: str = "id", v: str = "v") -> tuple[DataFrame, np.ndarray]:
    """The vectors less their mean, and the mean."""
    mean = moments(df, v).mean
    return df.withColumn(v, V.subtract(v, F.array(*[F.lit(float(x)) for x in mean]))), mean


#: Rows and columns of a block of a product at most, and its depth.
SIDE, DEPTH = 8192, 512
#: Products of elements from which blocks are multiplied.
DENSE = 1 << 22
#: Products of a row and a column that a task makes, about, where one side is sent to all tasks.
MADE = 1 << 27


def matmul(left: DataFrame, right: DataFrame, i: str = "i", k: str = "k", j: str = "j", x: str = "x", transpose_left: bool = False, transpose_right: bool = False, dense_from: int = DENSE, side: int = SIDE, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """i, j, x of the product of matrices in long form: left (i, k, x), right (k, j, x), either transposed.

    A place is in the result if the row and the column share a k; products with a null don't count. Small and sparse
    products are joined by k and added up. Others are made of dense blocks. A right side of at most ``limit`` bytes is
    sent to all tasks, and rows of the left are shuffled once; else each block is packed once and meets the blocks of the
    other side, and sums are shuffled only where there is more than one block along k."""
    a = left.select(F.col(k if transpose_left else i).alias("o"), F.col(i if transpose_left else k).alias("k"), F.col(x).cast("double").alias("x")).where("k IS NOT NULL")
    b = right.select(F.col(j if transpose_right else k).alias("k"), F.col(k if transpose_right else j).alias("o"), F.col(x).cast("double").alias("x")).where("k IS NOT NULL")
    met = a.groupBy("k").agg(F.count("*").alias("n")).join(b.groupBy("k").agg(F.count("*").alias("m")), "k")
    ks, products = met.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).first()
    # keys with fractions have two zeros, which a join takes as one
    if products < dense_from or any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for t in (a, b) for f in (t.schema["o"], t.schema["k"])):
        return _joined(a, b, i, j, x)
    n, m = (t.agg(F.approx_count_distinct("o")).first()[0] for t in (a, b))
    if products * 16 < float(n) * m * ks:
        return _joined(a, b, i, j, x)
    kind = a.select("k").union(b.select("k")).schema["k"].dataType
    a, b = (t.withColumn("k", F.col("k").cast(kind)) for t in (a, b))
    out = T.StructType([T.StructField(i, a.schema["o"].dataType), T.StructField(j, b.schema["o"].dataType), T.StructField(x, T.DoubleType())])
    least = lambda n: max(min(16, -(-n // 512)), 1)
    if 9.0 * m * ks <= limit:
        tasks = min(20_000, max(least(n), -(-n * m // MADE), -(-n * ks // DENSE)))
        return _against_right(a, _packed(b, -(-m // side), 1), tasks, out)
    blocks = lambda n: max(-(-n // side), least(n))
    across, down, along = blocks(n), blocks(m), -(-ks // depth)
    a, b = (_packed(t, parts, along) for t, parts in ((a, across), (b, down)))
    tasks = min(2000, across * down * along)
    meet = lambda t, own, other, n: t.withColumnRenamed("part", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(tasks, "p", "q", "along")
    a = meet(a, "p", "q", down).select("p", "q", "along", "o", "k", "x", "seen")
    b = meet(b, "q", "p", across).select("p", "q", "along", *[F.col(c).alias(f"{c}2") for c in ("o", "k", "x", "seen")])
    pairs = a.join(b, ["p", "q", "along"])
    found = pairs.select("o", "k", "x", "seen", "o2", "k2", "x2", "seen2").mapInArrow(_multiply, out)
    return found if along == 1 else found.groupBy(i, j).agg(F.sum(x).alias(x))


def _joined(a: DataFrame, b: DataFrame, i: str, j: str, x: str) -> DataFrame:
    pairs = a.select(F.col("o").alias("__i"), "k", F.col("x").alias("__a")).join(b.select("k", F.col("o").alias("__j"), F.col("x").alias("__b")), "k")
    return pairs.groupBy(F.col("__i").alias(i), F.col("__j").alias(j)).agg(F.sum(F.col("__a") * F.col("__b")).alias(x))


def _packed(t: DataFrame, parts: int, along: int) -> DataFrame:
    """A row for each block: its outer keys and its k, a dense matrix of sums (row for each outer key), and what is in
    each place (0 nothing, 1 nulls, 2 numbers), or null if that is numbers everywhere."""
    keyed = t.select("o", "k", "x", F.pmod(F.xxhash64("o"), F.lit(parts)).cast("int").alias("part"), F.pmod(F.xxhash64("k"), F.lit(along)).cast("int").alias("along"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("along", T.IntegerType()), *[T.StructField(c, T.ArrayType(t.schema[c].dataType)) for c in ("o", "k")], T.StructField("x", T.BinaryType()), T.StructField("seen", T.BinaryType())])

    def pack(rows: pa.Table) -> pa.Table:
        o, k, x, seen = _pack(rows)
        one = lambda y: pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), y)
        return pa.table({"part": rows["part"].slice(0, 1), "along": rows["along"].slice(0, 1), "o": one(o), "k": one(k), "x": pa.array([x.tobytes()], pa.binary()), "seen": pa.array([None if seen is None else seen.tobytes()], pa.binary())})

    return keyed.groupBy("part", "along").applyInArrow(pack, schema)


def _pack(rows: pa.Table) -> tuple:
    """A block as _block has it, of at least one row o, k, x."""
    rows = rows.combine_chunks()
    (o, at), (k, to) = ((d.dictionary, np.asarray(d.indices)) for d in (pc.dictionary_encode(rows[c].combine_chunks(), null_encoding="encode") for c in ("o", "k")))
    place = at.astype(np.int64) * len(k) + to
    x = rows["x"].combine_chunks()
    sums = np.bincount(place, np.asarray(x.fill_null(0.0)), len(o) * len(k))
    seen = np.zeros(len(sums), np.uint8)
    seen[place] = 1
    seen[place[np.asarray(x.is_valid())]] = 2
    return o, k, sums.reshape(len(o), len(k)), None if seen.min() == 2 else seen.reshape(len(o), len(k))


def _against_right(a: DataFrame, b: DataFrame, tasks: int, out: T.StructType) -> DataFrame:
    """The product with packed blocks that are sent to all tasks; all k of a row of the left come to one task."""
    sink = pa.BufferOutputStream()
    table = b.select("o", "k", "x", "seen").toArrow()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    shared = a.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            left = _pack(pa.Table.from_batches(held))
            del held
            for blocks in pa.ipc.open_stream(shared.value):
                for r in range(blocks.num_rows):
                    yield from _product(left, _block(blocks, r, 0))

    return a.repartition(tasks, "o").mapInArrow(run, out)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield from _product(_block(batch, r, 0), _block(batch, r, 4))


def _product(left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
    (o, k, x, seen), (o2, k2, x2, seen2) = left, right
    to = pc.index_in(k, value_set=k2)
    own = np.flatnonzero(np.asarray(to.is_valid()))
    to = np.asarray(to.drop_null())
    x, x2 = np.ascontiguousarray(x[:, own]), np.ascontiguousarray(x2[:, to])
    if seen is not None or seen2 is not None:
        seen, seen2 = (np.full(y.shape, 2, np.uint8) if s is None else s[:, c] for y, s, c in ((x, seen, own), (x2, seen2, to)))
    for at, down in kernels.tiles(len(o) if len(own) else 0, len(o2)):
        if seen is None:
            y, there, valid = x[at] @ x2[down].T, None, None
        else:
            y, there, valid = _partly(x[at], x2[down], seen[at], seen2[down])
        for rows, columns, places in kernels.by_value(y, there):
            yield pa.RecordBatch.from_arrays([o.take(pa.array(rows + at.start)), o2.take(pa.array(columns + down.start)), pa.array(y.ravel()[places], mask=None if valid is None else ~valid[places])], names=["i", "j", "x"])


def _block(batch: pa.RecordBatch, r: int, c: int) -> tuple:
    o, k = batch.column(c)[r].values, batch.column(c + 1)[r].values
    x, seen = (batch.column(c + at)[r].as_buffer() for at in (2, 3))
    shaped = lambda buffer, kind: None if buffer is None else np.frombuffer(buffer, kind).reshape(len(o), len(k))
    return o, k, shaped(x, np.float64), shaped(seen, np.uint8)


def _partly(x: np.ndarray, x2: np.ndarray, seen: np.ndarray, seen2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product, which places of it (flat) there are, and which aren't null."""
    share = lambda least: (((seen >= least).astype(np.float32) @ (seen2 >= least).T.astype(np.float32)) > 0).ravel()
    if np.isfinite(x).all() and np.isfinite(x2).all():
        y = x @ x2.T
    else:  # nothing times infinity is nothing
        y = np.zeros((len(x), len(x2)))
        for c in range(x.shape[1]):
            a, b = np.flatnonzero(seen[:, c] == 2), np.flatnonzero(seen2[:, c] == 2)
            y[np.ix_(a, b)] += np.outer(x[a, c], x2[b, c])
    return y, share(1), share(2)


def least_squares(df: DataFrame, v: str = "v", y: str = "y") -> np.ndarray:
    """x that makes the sum of (v x - y)^2 least, from sums over rows."""
    m = moments(df.select(F.concat(V.doubles(v), F.array(F.col(y).cast("double"))).alias("__z")), "__z").gram
    return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]


def power_iteration(apply, n: int, d: int, rounds: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues (by size) and eigenvectors of a symmetric operator given by ``apply`` (columns in, columns out)."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, n)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(apply(q))[0]
    w, x = np.linalg.eigh(q.T @ apply(q))
    order = np.argsort(-np.abs(w))
    return w[order], (q @ x).T[order]
