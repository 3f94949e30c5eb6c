"""Running states over streams: the k best of each group, and moments for online PCA.

``running_top`` merges batches into a table by foreachBatch. A batch that is replayed after a failure replaces its own
earlier version: versions are folders named by the batch. ``top_stream`` keeps the same in the stream's own state.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from vectide.operators import linalg
from vectide.operators.ordered import merge_top, top_per_group


def running_top(path: str, k: int, group: list[str], order: Callable[[], list]) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch that keeps the k best rows of each group under path/batch=n."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = batch
        if number:
            best = merge_top(spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}"), batch, k, group, order())
        else:
            best = top_per_group(batch, k, group, order()).select(*batch.columns)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def top_stream(stream: DataFrame, k: int, group: list[str], value: str, tie: str, largest: bool = False) -> DataFrame:
    """group, rank, value, tie: the k best rows of each group so far, given again whenever a batch has rows of the group
    (output mode update). The state of a group is its k best (value, tie), kept in the stream's checkpoint; ties go by ``tie``.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    result = StructType([*(StructField(g, kinds[g]) for g in group), StructField("rank", LongType()), StructField(value, DoubleType()), StructField(tie, LongType())])
    held = StructType([StructField("values", ArrayType(DoubleType())), StructField("ties", ArrayType(LongType()))])
    sign = -1.0 if largest else 1.0

    def best(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            rows = heapq.nsmallest(k, [*rows, *zip(frame[value], frame[tie], strict=True)], key=lambda r: (sign * r[0], r[1]))
        values, ties = [float(x) for x, _ in rows], [int(x) for _, x in rows]
        state.update((values, ties))
        yield pd.DataFrame({**{g: [x] * len(rows) for g, x in zip(group, key, strict=True)}, "rank": range(1, len(rows) + 1), value: values, tie: ties})

    some = stream.select(*group, F.col(value).cast("double").alias(value), F.col(tie).cast("bigint").alias(tie)).where(F.col(value).isNotNull() & F.col(tie).isNotNull())
    return some.groupBy(*group).applyInPandasWithState(best, result, held, "update", GroupStateTimeout.NoTimeout)


def current(spark, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={number}")


class OnlineMoments:
    """Moments of all vectors seen; add() merges another DataFrame's, pca() gives the components so far."""

    def __init__(self, d: int):
        self.state = linalg.Moments.empty(d)

    def add(self, df: DataFrame, v: str = "v") -> None:
        if df.limit(1).count():
            self.state = self.state.merge(linalg.moments(df, v))

    def pca(self, n: int | None = None) -> linalg.PCA:
        w, x = linalg.eigen(self.state.covariance(unbiased=True), n)
        return linalg.PCA(self.state.mean, w, x, self.state.n)

    def covariance(self) -> np.ndarray:
        return self.state.covariance(unbiased=True)

