"""Hamming range joins on binary codes (arrays of 64-bit words).

Codes within ``radius`` of each other agree on one of radius + 1 bands of bits, so pairs are found by joining on
(band, bits) and verified; each pair is counted in the first band it agrees on. With few bits to a band that join
is no better than comparing everything, so then blocks of codes are compared by exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V

from .neighbours import block_by_block, dense, spread

#: Bits of a band from which the band join is taken.
LEAST_BITS = 12
LIMIT = 128 << 20
#: Entries of a list that go to one task.
LIST = 1 << 16


def _words(df: DataFrame, code: str) -> int:
    row = df.select(F.size(code).alias("n")).first()
    return row["n"] if row else 1


def _bits(code: Column, first: int, n: int) -> Column:
    """n bits from ``first`` on, as whole words shifted and masked."""
    parts, at, shift = [], first, 0
    while at < first + n:
        k = min(64 - at % 64, first + n - at)
        word = F.shiftrightunsigned(F.get(code, at // 64), at % 64)
        parts.append(word if k == 64 else word.bitwiseAND(F.lit((1 << k) - 1).cast("bigint")))
        at, shift = at + k, shift + k
    return F.concat_ws(",", *[p.cast("string") for p in parts]) if len(parts) > 1 else parts[0].cast("string")


def range_join(a: DataFrame, b: DataFrame, radius: int, aid: str = "id", acode: str = "code", bid: str = "id", bcode: str = "code", limit: int = LIMIT, on: str | None = None) -> DataFrame:
    """qid, bid, score for all pairs with at most ``radius`` differing bits; and equal values of ``on``, which then comes along."""
    words = _words(a, acode)
    bits = 64 * words
    keys = [on] if on else []
    if radius < 0:
        return a.where("false").select(F.col(aid).cast("bigint").alias("qid"), F.lit(0).cast("bigint").alias("bid"), *keys, F.lit(0).cast("bigint").alias("score"))
    if bits // (radius + 1) < LEAST_BITS:
        if not on:
            return _compared(a, b, radius, aid, acode, bid, bcode, limit)
        # a list of more than LIST entries is dealt to parts, and its queries go to all of them
        parts = b.groupBy(on).agg(F.ceil(F.count("*") / LIST).cast("int").alias("__parts"))
        x = a.join(parts, on).select(on, F.col(aid).cast("bigint").alias("qid"), F.col(acode).alias("__a"), F.explode(F.expr("sequence(0, __parts - 1)")).alias("__part"))
        y = b.join(parts, on).select(on, F.col(bid).cast("bigint").alias("bid"), F.col(bcode).alias("__b"), F.pmod(F.xxhash64(bid), F.col("__parts")).cast("int").alias("__part"))
        return x.join(y, [on, "__part"]).withColumn("score", V.hamming("__a", "__b")).where(F.col("score") <= radius).select("qid", "bid", on, "score")
    n = radius + 1
    cuts = [bits * i // n for i in range(n + 1)]
    band = lambda code: F.array(*[F.struct(F.lit(i).alias("band"), _bits(F.col(code), cuts[i], cuts[i + 1] - cuts[i]).alias("bits")) for i in range(n)])
    x = a.select(F.col(aid).cast("bigint").alias("qid"), F.col(acode).alias("__a"), F.explode(band(acode)).alias("k"), *keys).select("qid", "__a", "k.*", *keys)
    y = b.select(F.col(bid).cast("bigint").alias("bid"), F.col(bcode).alias("__b"), F.explode(band(bcode)).alias("k"), *keys).select("bid", "__b", "k.*", *keys)
    equal = lambda i: _bits(F.col("__a"), cuts[i], cuts[i + 1] - cuts[i]) == _bits(F.col("__b"), cuts[i], cuts[i + 1] - cuts[i])
    before = reduce(lambda p, i: p | (equal(i) & (F.col("band") > i)), range(n - 1), F.lit(False))
    met = x.join(y, ["band", "bits", *keys]).withColumn("score", V.hamming("__a", "__b"))
    return met.where((F.col("score") <= radius) & ~before).select("qid", "bid", *keys, "score")


def _compared(a, b, radius, aid, acode, bid, bcode, limit) -> DataFrame:
    from pyspark.sql.types import LongType, StructField, StructType

    size = 8 * b.count() * (1 + _words(b, bcode))

    def against(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        table = part.select(F.col(bid).cast("bigint").alias("k"), V.longs(bcode).alias("c")).toArrow()
        ids = np.asarray(table["k"].combine_chunks()) if table.num_rows else np.zeros(0, np.int64)
        codes = _codes(table["c"].combine_chunks()) if table.num_rows else np.zeros((0, 1), np.uint64)
        shared = a.sparkSession.sparkContext.broadcast((ids, codes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, codes = shared.value
            step = max(1, (1 << 22) // max(1, len(ids)))
            for batch in batches:
                own, q = np.asarray(batch.column(0)), _codes(batch.column(1)) if batch.num_rows else np.zeros((0, 1), np.uint64)
                for i in range(0, len(own) if len(ids) else 0, step):
                    d = sum(np.bitwise_count(q[i : i + step, w, None] ^ codes[None, :, w]).astype(np.int64) for w in range(q.shape[1]))
                    x, y = np.nonzero(d <= radius)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i : i + step][x]), pa.array(ids[y]), pa.array(d[x, y])], names=["qid", "bid", "score"])

        schema = StructType([StructField(x, LongType()) for x in ("qid", "bid", "score")])
        return spread(a.select(F.col(aid).cast("bigint").alias("qid"), V.longs(acode).alias("c"))).mapInArrow(run, schema), shared

    return block_by_block(b, bid, size, limit, against)


def _codes(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1).view(np.uint64) if n else np.zeros((0, 1), np.uint64)


def self_join(df: DataFrame, radius: int, key: str = "id", code: str = "code") -> DataFrame:
    """Pairs of rows with qid < bid and at most ``radius`` differing bits."""
    return range_join(df, df, radius, key, code, key, code).where("qid < bid")


def distances(a: DataFrame, b: DataFrame, aid: str = "id", acode: str = "code", bid: str = "id", bcode: str = "code") -> DataFrame:
    """qid, bid, score for all pairs."""
    return range_join(a, b, 64 * _words(a, acode), aid, acode, bid, bcode)


def count_within(a: DataFrame, b: DataFrame, radius: int, **kw) -> DataFrame:
    return range_join(a, b, radius, **kw).agg(F.count("*").alias("n"))


__all__ = ["count_within", "dense", "distances", "range_join", "self_join"]
