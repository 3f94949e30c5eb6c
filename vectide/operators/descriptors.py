"""Descriptors of sets of vectors against a codebook: residual sums and counts by nearest centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V

from .neighbours import knn


def assigned(df: DataFrame, centroids: DataFrame, group: str, k: int = 1, key: str = "id", v: str = "v") -> DataFrame:
    """group, key, cluster, v, c for each vector and each of its k nearest centroids (id, v)."""
    near = knn(df, centroids, k, qid=key, qv=v).select(F.col("qid").alias(key), F.col("bid").alias("cluster"))
    c = centroids.select(F.col("id").cast("bigint").alias("cluster"), V.doubles("v").alias("__c"))
    return df.select(group, F.col(key).cast("bigint").alias(key), V.doubles(v).alias("__v")).join(near, key).join(c, "cluster")


def _grid(df: DataFrame, centroids: DataFrame, group: str) -> DataFrame:
    """group, cluster: all centroids for all groups, from an array of the centroids' ids in each row."""
    ids = centroids.agg(F.sort_array(F.collect_list(F.col("id").cast("bigint"))).alias("ids")).first()["ids"]  # the codebook
    return df.select(group).distinct().select(group, F.explode(F.array(*[F.lit(x).cast("bigint") for x in ids])).alias("cluster"))


def vlad(df: DataFrame, centroids: DataFrame, group: str, weight: str | None = None, key: str = "id", v: str = "v") -> DataFrame:
    """group, cluster, pos, x: residuals added up by group and nearest centroid, zero where there are none."""
    rows = assigned(df, centroids, group, key=key, v=v)
    residual = V.subtract("__v", "__c")
    if weight:
        rows = rows.join(df.select(F.col(key).cast("bigint").alias(key), F.col(weight).alias("__w")), key)
        residual = V.scale(residual, F.col("__w"))
    sums = rows.select(group, "cluster", F.posexplode(residual).alias("pos", "x")).groupBy(group, "cluster", "pos").agg(F.sum("x").alias("x"))
    grid = _grid(df, centroids, group).join(centroids.select(F.col("id").cast("bigint").alias("cluster"), F.explode(F.sequence(F.lit(0), F.size("v") - 1)).alias("pos")), "cluster")
    return grid.join(sums, [group, "cluster", "pos"], "left").select(group, "cluster", F.col("pos").cast("bigint").alias("pos"), F.coalesce("x", F.lit(0.0)).alias("x"))


def vlad_subsets(df: DataFrame, centroids: DataFrame, subsets: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
    """The same for subsets (subset, key) of the vectors; a vector may be in many."""
    return vlad(df.join(subsets, key).withColumn("__id", F.xxhash64("subset", key)), centroids, "subset", key="__id", v=v)


def bag_of_features(df: DataFrame, centroids: DataFrame, group: str, k: int = 1, key: str = "id", v: str = "v") -> DataFrame:
    """group, cluster, n: how many of the group's vectors have the centroid among their k nearest."""
    near = knn(df, centroids, k, qid=key, qv=v).select(F.col("qid").alias("__k"), F.col("bid").alias("cluster"))
    counts = df.select(group, F.col(key).cast("bigint").alias("__k")).join(near, "__k").groupBy(group, "cluster").agg(F.count("*").alias("n"))
    return _grid(df, centroids, group).join(counts, [group, "cluster"], "left").select(group, "cluster", F.coalesce("n", F.lit(0)).alias("n"))


def modulated(df: DataFrame, theta: str, coefficients: list[float], degree: int = 1, group: str | None = None, key: str = "id", v: str = "v") -> DataFrame:
    """Polynomial embedding of each vector, modulated by its angle; added up by group if there is one."""
    embedded = {1: V.doubles(v), 2: V.poly2(v), 3: V.poly3(v)}[degree]
    rows = df.withColumn("m", V.angular(embedded, F.col(theta).cast("double"), coefficients))
    if group is None:
        return rows.select(key, "m")
    sums = rows.select(group, F.posexplode("m").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("x"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
