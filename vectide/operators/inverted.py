"""Inverted files with binary signatures: lists of (key, id, code), probed by key and verified by Hamming distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V

from . import clustering, hamming, linalg, tables
from .neighbours import nearest


@dataclass
class InvertedFile:
    """A table (key, id, code). Adding makes a new one; save() writes Parquet clustered by key, so a probe of few keys reads few row groups."""

    table: DataFrame
    keys: int

    @classmethod
    def build(cls, rows: DataFrame, keys: int) -> InvertedFile:
        """Keys from 0 to ``keys`` (1-based ones fit too); others fail when the table is read."""
        ok = (F.col("key") >= 0) & (F.col("key") <= keys)
        key = F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit("key outside the inverted file")).cast("bigint"))
        return cls(rows.select(key.cast("bigint").alias("key"), F.col("id").cast("bigint").alias("id"), V.longs("code").alias("code")), keys)

    def add(self, rows: DataFrame) -> InvertedFile:
        return InvertedFile(self.table.unionByName(InvertedFile.build(rows, self.keys).table), self.keys)

    def save(self, path: str) -> None:
        self.table.repartitionByRange("key").sortWithinPartitions("key", "id").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, keys: int) -> InvertedFile:
        return cls(spark.read.parquet(path), keys)

    def sizes(self) -> DataFrame:
        """key, n for all keys below ``keys``, empty lists too."""
        counts = self.table.groupBy("key").agg(F.count("*").alias("n"))
        return self.table.sparkSession.range(self.keys).withColumnRenamed("id", "key").join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))

    def imbalance(self) -> DataFrame:
        n = F.col("n").cast("double")
        return self.sizes().agg((F.count("*") * F.sum(n * n) / F.pow(F.sum(n), F.lit(2.0))).alias("factor"))

    def find(self, wanted: DataFrame) -> DataFrame:
        """Codes of (key, id) rows; rows that aren't there have a null code."""
        return wanted.join(self.table, ["key", "id"], "left")

    def probe(self, queries: DataFrame, radius: int) -> DataFrame:
        """qid, bid, key, score for queries (qid, key, code) and entries of their key within ``radius`` bits."""
        return hamming.range_join(queries, self.table, radius, aid="qid", on="key").select("qid", "bid", "key", "score")

    def probe_weighted(self, queries: DataFrame, radius: int, score_map: list[float] | None = None, list_weights: DataFrame | None = None) -> DataFrame:
        """The same with score = score_map[bits] * weight of the list (key, w); by default the bits and 1."""
        met = self.probe(queries, radius)
        score: Column = F.col("score").cast("double") if score_map is None else F.get(F.array(*map(F.lit, map(float, score_map))), F.col("score").cast("int"))
        if list_weights is not None:
            met = met.join(list_weights.select("key", F.col("w").alias("__w")), "key", "left")
            score = score * F.coalesce("__w", F.lit(1.0))
        return met.select("qid", "bid", "key", score.alias("score"))

    def crossmatches(self, radius: int, symmetric: bool = False) -> DataFrame:
        """key, aid, bid, score within each list: a before b, or both ways and with itself."""
        met = hamming.range_join(self.table, self.table, radius, on="key").withColumnRenamed("qid", "aid")
        return (met if symmetric else met.where("aid < bid")).select("key", "aid", "bid", "score")


def falling_scores(radius: int) -> list[float]:
    """(1 - h / radius)^3 for h up to the radius."""
    return [(1 - h / radius) ** 3 for h in range(radius + 1)]


@dataclass
class HammingEmbedding:
    """Coarse quantiser, rotation and medians per cell: signatures whose bit j is rotated v[j] > median[cell][j]."""

    centroids: DataFrame  # id, v
    rotation: np.ndarray
    medians: DataFrame  # key, medians

    @classmethod
    def learn(cls, vectors: DataFrame, cells: int, bits: int, rounds: int = 10, seed: int = 0, key: str = "id", v: str = "v", centroids: DataFrame | None = None, rotation: np.ndarray | None = None) -> HammingEmbedding:
        """By k-means and a random rotation, unless ``centroids`` (id, v) or a ``rotation`` are given."""
        if centroids is None:
            centroids = clustering.kmeans(vectors, cells, rounds=rounds, key=key, v=v, init="hash", seed=seed).table(vectors.sparkSession)
        if rotation is None:
            rotation = linalg.random_orthogonal(len(centroids.first()["v"]), seed)[:bits]
        turned = cls(centroids, rotation, None).turned(vectors, key, v)
        mid = tables.medians(turned.select("key", F.posexplode("r").alias("pos", "x")), ["key", "pos"], "x").withColumnRenamed("median", "m")
        medians = mid.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("medians"))
        return cls(centroids, rotation, medians)

    def turned(self, vectors: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        """id, key (cell), r (rotated)."""
        cell = nearest(vectors, self.centroids, qid=key, qv=v).select(F.col("qid").alias("id"), F.col("bid").alias("key"))
        return linalg.project(vectors, self.rotation, key=key, v=v).select(F.col(key).cast("bigint").alias("id"), F.col("p").alias("r")).join(cell, "id")

    def signatures(self, vectors: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        """id, key, code; cells without medians use zero."""
        zero = F.array_repeat(F.lit(0.0), len(self.rotation))
        rows = self.turned(vectors, key, v).join(self.medians, "key", "left")
        return rows.select("id", "key", V.sign_words("r", F.coalesce("medians", zero)).alias("code"))
