"""Command-line jobs over vector files: ``python -m vectide.jobs knn|kmeans|gmm|dump|pca ...``."""

from __future__ import annotations

import argparse
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import clustering, linalg, mixture, neighbours, tables
from vectide.sources import models, vecfiles


def load(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """id, v from a vector file, or a .txt file of numbers (ids by order in one file)."""
    if path.endswith(".txt"):
        text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id")).where(F.trim("value") != "")
        df = text.select("id", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("v"))
    else:
        df = vecfiles.read_vectors(spark, path, **({"last": rows} if rows else {})).select(F.col("idx").alias("id"), V.doubles("v").alias("v"))
    return df.where(F.col("id") < rows) if rows else df


def knn(spark: SparkSession, base: str, query: str, k: int, metric: str, out: str, nb: int | None = None, nq: int | None = None, step: int | None = None) -> None:
    """Exact neighbours; NaN counts as 2. Writes Parquet (qid, rank, bid, dis), ``step`` queries at a time if given, a folder for each slice."""
    b, q = (load(spark, p, n).withColumn("v", V.replace_nan("v", 2.0)) for p, n in ((base, nb), (query, nq)))
    if not step:
        neighbours.knn(q, b, k, metric).write.mode("overwrite").parquet(out)
        return
    last = q.agg(F.max("id")).first()[0]
    for at in range(0, -1 if last is None else last + 1, step):
        part = q.where((F.col("id") >= at) & (F.col("id") < at + step))
        neighbours.knn(part, b, k, metric).write.mode("overwrite").parquet(f"{out}/first={at}")


def kmeans(spark: SparkSession, data: str, k: int, metric: str, rounds: int, out: str, seed: int = 0, redo: int = 1) -> None:
    """Writes the centroids as a vector file, in one part."""
    model = clustering.kmeans(load(spark, data), k, metric, rounds=rounds, init="plusplus", redo=redo, seed=seed)
    vecfiles.write_vectors(model.table(spark).select("v").coalesce(1), out)


def gmm(spark: SparkSession, data: list[str], k: int, out: str, n: int | None = None, rounds: int = 30, seed: int = 0, siftgeo: bool = False) -> mixture.Mixture:
    """A mixture of all files' vectors (``n`` sampled ones, 100 for each component by default), written as a model file."""
    parts = [vecfiles.read_vectors(spark, x, **({"format": "siftgeo"} if siftgeo else {})).select(F.xxhash64("file", "idx").alias("id"), V.doubles("v").alias("v")) for x in data]
    model = mixture.fit(tables.sample_rows(reduce(DataFrame.unionAll, parts), n or 100 * k, "id", seed), k, rounds=rounds, seed=seed)
    models.write_mixture(model, out)
    return model


def dump(spark: SparkSession, data: str, out: str) -> None:
    """One line of numbers for each vector."""
    vecfiles.write_text(load(spark, data).orderBy("id"), out)


def prepared(df: DataFrame, power: float, norm: float | None) -> DataFrame:
    """Signed power, then norm, then NaN to 0."""
    v = V.doubles("v") if power == 1 else V.signed_power("v", power)
    return df.withColumn("v", V.replace_nan(v if norm is None else V.normalize(v, norm), 0.0))


def pca(spark: SparkSession, data: str, n: int, out: str, power: float = 1.0, norm: float | None = None) -> linalg.PCA:
    """Components of prepared vectors; projections are written as a vector file."""
    df = prepared(load(spark, data), power, norm)
    model = linalg.pca(df, n, unbiased=True)
    vecfiles.write_vectors(model.project(df).select(F.col("p").alias("v")), out)
    return model


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="vectide.jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("knn")
    a.add_argument("--base", required=True)
    a.add_argument("--query", required=True)
    a.add_argument("--k", type=int, default=1)
    a.add_argument("--metric", default="l2")
    a.add_argument("--nb", type=int)
    a.add_argument("--nq", type=int)
    a.add_argument("--step", type=int)
    a.add_argument("--out", required=True)
    a = jobs.add_parser("kmeans")
    a.add_argument("--data", required=True)
    a.add_argument("--k", type=int, required=True)
    a.add_argument("--metric", default="l2")
    a.add_argument("--rounds", type=int, default=30)
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--redo", type=int, default=1)
    a.add_argument("--out", required=True)
    a = jobs.add_parser("gmm")
    a.add_argument("--data", required=True, nargs="+")
    a.add_argument("--k", type=int, default=16)
    a.add_argument("--n", type=int)
    a.add_argument("--rounds", type=int, default=30)
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--siftgeo", action="store_true")
    a.add_argument("--out", required=True)
    a = jobs.add_parser("dump")
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a = jobs.add_parser("pca")
    a.add_argument("--data", required=True)
    a.add_argument("--n", type=int, required=True)
    a.add_argument("--power", type=float, default=1.0)
    a.add_argument("--norm", type=float)
    a.add_argument("--out", required=True)
    given = vars(top.parse_args(args))
    job = given.pop("job")
    spark = SparkSession.builder.appName(f"vectide-{job}").getOrCreate()
    found = {"knn": knn, "kmeans": kmeans, "gmm": gmm, "dump": dump, "pca": pca}[job](spark, **given)
    if isinstance(found, linalg.PCA):
        print("explained", np.round(found.values, 6).tolist())


if __name__ == "__main__":
    main()
