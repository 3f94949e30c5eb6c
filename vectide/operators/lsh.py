"""K-means LSH: several codebooks cut the space into cells; exact search within the cells nearest to a query."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.sources.shared import written

from . import clustering, kernels
from .neighbours import ROWS, _side, dense, knn, spread
from .ordered import top_per_group
from .rows import Rows
from .tables import sample_rows

#: Share of the true neighbours to be found; some more than the 0.9 that is asked for, as it is set by a sample.
RECALL = 0.95


@dataclass
class Codebooks:
    books: list[np.ndarray]

    @classmethod
    def learn(cls, df: DataFrame, hashes: int, cells: int, sample: int = 0, rounds: int = 8, seed: int = 0, key: str = "id", v: str = "v") -> Codebooks:
        """One codebook per hash, learnt from one sample of ``sample`` rows (0: 50 per cell) with starts of their own."""
        ids, m = _side(sample_rows(df, sample or 50 * cells, key, seed), key, v)
        m = m[np.argsort(ids)]
        if len(m) < cells:
            raise ValueError("fewer vectors than cells")
        data, rng = Rows.of(m), np.random.default_rng(seed)
        return cls([clustering.kmeans(None, cells, rounds=rounds, init=m[rng.choice(len(m), cells, replace=False)], seed=seed + h, data=data).centroids for h in range(hashes)])

    def index(self, df: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
        """hash, cell, id; one pass for all codebooks."""
        shared = df.sparkSession.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids, x = np.asarray(batch.column(0)), dense(batch.column(1))
                    cells = [kernels.top_k(x, c, np.arange(len(c)), 1)[0][:, 0] for c in shared.value]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(cells), dtype=np.int32), len(ids))), pa.array(np.concatenate(cells)), pa.array(np.tile(ids, len(cells)))], names=["hash", "cell", "id"])

        return spread(df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v"))).mapInArrow(run, "hash int, cell long, id long")

    def probe(self, df: DataFrame, sizes: DataFrame, probes: int, least: int = 0, key: str = "id", v: str = "v") -> DataFrame:
        """hash, cell, id, rank: for each row and hash the ``probes`` nearest of the cells in ``sizes`` (see cell_sizes), and more until they hold ``least`` rows."""
        counts = [np.zeros(len(c), np.int64) for c in self.books]
        for r in sizes.collect():  # a row for each cell
            counts[r["hash"]][r["cell"]] = r["n"]
        shared = df.sparkSession.sparkContext.broadcast([(np.flatnonzero(n), c[n > 0], n[n > 0]) for c, n in zip(self.books, counts, strict=True)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    ids, x = np.asarray(part.column(0)), dense(part.column(1))
                    for h, (cells, c, n) in enumerate(shared.value):
                        # cells have a row at least, so that ``least`` of them are enough
                        near = kernels.top_k(x, c, cells, max(probes, least))[0]
                        held = np.cumsum(n[near], axis=1) - n[near]
                        row, rank = np.nonzero((np.arange(near.shape[1]) < probes) | (held < least))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), h, np.int32)), pa.array(cells[near[row, rank]]), pa.array(ids[row]), pa.array(rank + 1)], names=["hash", "cell", "id", "rank"])

        return spread(df.select(F.col(key).cast("bigint").alias("id"), V.doubles(v).alias("v"))).mapInArrow(run, "hash int, cell long, id long, rank long")

    def probes_for(self, queries: DataFrame, base: DataFrame, b_index: DataFrame, k: int, recall: float, sample: int = 200, seed: int = 0, key: str = "id", v: str = "v") -> int:
        """The fewest probes that find ``recall`` of the true neighbours of ``sample`` queries, by exact search for those. Equal vectors are found by any and don't count."""
        some = sample_rows(queries, sample, key, seed)
        ranks = self.probe(some, cell_sizes(b_index), max(map(len, self.books)), key=key, v=v)
        true = knn(some, base, k + 1, qid=key, qv=v, bid=key, bv=v).where("dis > 0").select("qid", "bid")
        met = true.join(b_index.withColumnRenamed("id", "bid"), "bid").join(ranks.withColumnRenamed("id", "qid"), ["qid", "hash", "cell"])
        found = sorted(r["rank"] for r in met.groupBy("qid", "bid").agg(F.min("rank").alias("rank")).collect())  # at most sample * (k + 1) rows
        return found[max(0, math.ceil(recall * len(found)) - 1)] if found else 1

    def save(self, spark, path: str) -> None:
        rows = [(h, c, [float(x) for x in row]) for h, book in enumerate(self.books) for c, row in enumerate(book)]
        spark.createDataFrame(rows, "hash int, cell long, v array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Codebooks:
        rows = spark.read.parquet(path).orderBy("hash", "cell").collect()  # the codebooks
        return cls([np.array([r["v"] for r in rows if r["hash"] == h]) for h in sorted({r["hash"] for r in rows})])


def cell_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("hash", "cell").agg(F.count("*").alias("n"))


#: Rows of a cell that go to one task.
LIST = 1 << 16


def match(queries: DataFrame, base: DataFrame, q_index: DataFrame, b_index: DataFrame, k: int, metric: str = "l2", key: str = "id", v: str = "v") -> DataFrame:
    """qid, rank, bid, dis: the k best of what shares a cell with the query in any hash; pairs are joined and measured once.
    A cell of more than ``LIST`` rows is dealt to parts, and its queries go to all of them."""
    parts = cell_sizes(b_index).select("hash", "cell", F.ceil(F.col("n") / LIST).cast("int").alias("parts"))
    asked = q_index.join(parts, ["hash", "cell"]).select("hash", "cell", F.col("id").alias("qid"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    listed = b_index.join(parts, ["hash", "cell"]).select("hash", "cell", F.col("id").alias("bid"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    pairs = asked.join(listed, ["hash", "cell", "part"]).select("qid", "bid").distinct()
    q = queries.select(F.col(key).cast("bigint").alias("qid"), F.col(v).alias("__q"))
    b = base.select(F.col(key).cast("bigint").alias("bid"), F.col(v).alias("__b"))
    met = pairs.join(q, "qid").join(b, "bid").select("qid", "bid", V.distance(metric, "__q", "__b").alias("dis"))
    return top_per_group(met, k, ["qid"], [F.col("dis"), F.col("bid")]).select("qid", "rank", "bid", "dis")


def approximate_knn(queries: DataFrame, base: DataFrame, k: int, hashes: int = 4, seed: int = 0, key: str = "id", v: str = "v", recall: float = RECALL) -> DataFrame:
    """Codebooks of sqrt(n) cells, learnt from 100 rows per cell. As many nearest cells per codebook are probed as find ``recall`` of the
    true neighbours of a sample of the queries, and more where those hold fewer than k rows."""
    n = base.count()
    cells = max(1, int(n**0.5))
    books = Codebooks.learn(base, hashes, cells, min(n, 100 * cells), seed=seed, key=key, v=v)
    index = written(books.index(base, key, v), "lsh-index")
    probes = books.probes_for(queries, base, index, k, recall, seed=seed, key=key, v=v)
    return match(queries, base, books.probe(queries, cell_sizes(index), probes, k, key, v), index, k, key=key, v=v)
