"""Nearest neighbours and cross distances.

Which side is sent to all tasks depends on measured sizes: a base of at most ``limit`` bytes, else queries of at
most ``limit`` bytes (each task then keeps its k best per query and they are merged), else queries in blocks of
that size, each against all base rows. Blocks are taken one after the other: a block's result is written to the shared
folder and the block is dropped, on the driver and in the tasks, before the next one is fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.core.broadcast import Broadcast

from vectide.functions import vectors as V
from vectide.sources.shared import written

from . import kernels
from .ordered import top_per_group

#: Bytes of the side that is sent to all tasks.
LIMIT = 256 << 20
#: Rows of an Arrow batch that a kernel takes together.
ROWS = 4096

RESULT = "qid long, rank long, bid long, dis double"


def dense(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; fails on vectors of different lengths."""
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if n and len(flat) % n or len(set(np.diff(np.asarray(column.offsets))[:n].tolist())) > 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


def _side(df: DataFrame, key: str, v: str) -> tuple[np.ndarray, np.ndarray]:
    table = df.select(F.col(key).cast("bigint").alias("k"), V.doubles(v).alias("v")).toArrow().combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return np.asarray(table["k"].combine_chunks()), dense(table["v"].combine_chunks())


def _bytes(df: DataFrame, v: str) -> int:
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(v)), F.lit(0)).alias("x")).first()
    return 8 * (row["n"] + row["x"])


def _blocks(df: DataFrame, key: str, size: int, limit: int) -> list[DataFrame]:
    n = max(1, -(-size // limit))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def block_by_block(df: DataFrame, key: str, size: int, limit: int, against: Callable[[DataFrame], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """All results of ``against``, which sends a block to all tasks; no more than one block is held at a time."""
    blocks = _blocks(df, key, size, limit)
    if len(blocks) == 1:
        return against(df)[0]
    parts = []
    for block in blocks:
        result, sent = against(block)
        parts.append(written(result, "block"))
        sent.destroy()
    return reduce(DataFrame.unionAll, parts)


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if the source comes in fewer partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", qid: str = "id", qv: str = "v", bid: str = "id", bv: str = "v", weights: str | None = None, limit: int = LIMIT) -> DataFrame:
    """qid, rank (from 1), bid, dis: the k smallest distances of each query, ties by bid; ``weights`` multiply them by base row."""
    if metric not in kernels.METRICS:
        raise ValueError(f"unknown metric {metric}")
    b_size = _bytes(base, bv)
    if b_size <= limit:
        return _against_base(queries, base, k, metric, qid, qv, bid, bv, weights)
    return block_by_block(queries, qid, _bytes(queries, qv), limit, lambda block: _against_queries(block, base, k, metric, qid, qv, bid, bv, weights))


def _against_base(queries, base, k, metric, qid, qv, bid, bv, weights) -> DataFrame:
    names = [F.col(bid).cast("bigint").alias("k"), V.doubles(bv).alias("v")] + ([F.col(weights).cast("double").alias("w")] if weights else [])
    table = base.select(*names).toArrow()
    ids = np.asarray(table["k"].combine_chunks()) if table.num_rows else np.zeros(0, np.int64)
    matrix = dense(table["v"].combine_chunks()) if table.num_rows else np.zeros((0, 1))
    w = np.asarray(table["w"].combine_chunks()) if weights and table.num_rows else None
    return against_matrix(queries, ids, matrix, k, metric, qid, qv, w)


def against_matrix(queries: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str = "l2", qid: str = "id", qv: str = "v", w: np.ndarray | None = None) -> DataFrame:
    """knn against rows that the driver has, such as a codebook."""
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, w = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows if len(ids) else 0, ROWS):
                batch = whole.slice(i, ROWS)
                pos, dis = kernels.top_k(dense(batch.column(1)), matrix, ids, k, metric, w)
                m = pos.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(batch.column(0)), m)), pa.array(np.tile(np.arange(1, m + 1), len(pos))), pa.array(ids[pos].ravel()), pa.array(dis.ravel())], names=["qid", "rank", "bid", "dis"]
                )

    return spread(queries.select(F.col(qid).cast("bigint").alias("qid"), V.doubles(qv).alias("v"))).mapInArrow(run, RESULT)


def _against_queries(queries, base, k, metric, qid, qv, bid, bv, weights) -> tuple[DataFrame, Broadcast]:
    shared = base.sparkSession.sparkContext.broadcast(_side(queries, qid, qv))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best_id, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for whole in batches:
            for i in range(0, whole.num_rows if len(q) else 0, ROWS):
                batch = whole.slice(i, ROWS)
                ids = np.asarray(batch.column(0))
                pos, dis = kernels.top_k(q, dense(batch.column(1)), ids, k, metric, np.asarray(batch.column(2)) if weights else None)
                best_id, best = np.concatenate((best_id, ids[pos]), 1), np.concatenate((best, dis), 1)
                order = np.lexsort((best_id, best), axis=1)[:, :k]
                best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
        m = best.shape[1]
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, m)), pa.array(best_id.ravel()), pa.array(best.ravel())], names=["qid", "bid", "dis"])

    columns = [F.col(bid).cast("bigint").alias("bid"), V.doubles(bv).alias("v")] + ([F.col(weights).cast("double").alias("w")] if weights else [])
    found = spread(base.select(*columns)).mapInArrow(run, "qid long, bid long, dis double")
    return top_per_group(found, k, ["qid"], [F.col("dis"), F.col("bid")]).select("qid", "rank", "bid", "dis"), shared


def nearest(queries: DataFrame, base: DataFrame, **kw) -> DataFrame:
    """qid, bid, dis of the nearest base vector."""
    return knn(queries, base, 1, **kw).select("qid", "bid", "dis")


def cross_distances(a: DataFrame, b: DataFrame, metric: str = "l2", aid: str = "id", av: str = "v", bid: str = "id", bv: str = "v", limit: int = LIMIT) -> DataFrame:
    """aid, bid, dis for all pairs; ``b`` goes to the tasks in blocks of at most ``limit`` bytes."""

    def against(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        shared = a.sparkSession.sparkContext.broadcast(_side(part, bid, bv))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            step = max(1, (1 << 20) // max(1, len(ids)))
            for whole in batches:
                for i in range(0, whole.num_rows if len(ids) else 0, step):
                    batch = whole.slice(i, step)
                    d = kernels.exact(dense(batch.column(1))[:, None], m[None], metric) if metric == "l2" else kernels.pairwise(dense(batch.column(1)), m, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), len(ids))), pa.array(np.tile(ids, len(d))), pa.array(d.ravel())], names=["aid", "bid", "dis"])

        return spread(a.select(F.col(aid).cast("bigint").alias("aid"), V.doubles(av).alias("v"))).mapInArrow(run, "aid long, bid long, dis double"), shared

    return block_by_block(b, bid, _bytes(b, bv), limit, against)


def rerank(shortlist: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", qid: str = "id", qv: str = "v", bid: str = "id", bv: str = "v") -> DataFrame:
    """The k best of each query's shortlist (qid, bid) by exact distance."""
    q = queries.select(F.col(qid).alias("qid"), F.col(qv).alias("__q"))
    b = base.select(F.col(bid).alias("bid"), F.col(bv).alias("__b"))
    met = shortlist.select("qid", "bid").distinct().join(q, "qid").join(b, "bid").select("qid", "bid", V.distance(metric, "__q", "__b").alias("dis"))
    return top_per_group(met, k, ["qid"], [F.col("dis"), F.col("bid")]).select("qid", "rank", "bid", "dis")
