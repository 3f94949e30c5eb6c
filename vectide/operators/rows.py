"""The vectors of a DataFrame as something to add up over, whatever their number.

Sets of at most ``SMALL`` bytes, by measure, are held as one matrix on the driver: iterative methods then don't pay
for a job in each round. Larger ones stay distributed: tasks add up what they hold, and one row for each position of
the sum and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V

from .neighbours import _bytes, dense, spread
from .tables import medians

SMALL = 64 << 20
#: Rows that a kernel takes together.
TOGETHER = 8192


class Rows:
    def __init__(self, df: DataFrame, v: str = "v", small: int = SMALL):
        self.data = df.select(V.doubles(v).alias("v"))
        self.matrix: np.ndarray | None = None
        if _bytes(self.data, "v") <= small:
            table = self.data.toArrow()
            self.matrix = dense(table["v"].combine_chunks()) if table.num_rows else np.zeros((0, 1))
        else:
            self.data = spread(self.data)

    @classmethod
    def of(cls, matrix: np.ndarray) -> Rows:
        """Rows that the driver has."""
        rows = cls.__new__(cls)
        rows.matrix, rows.data = matrix, None
        return rows

    def add_up(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of f over blocks of rows; f gives a flat array of one size."""
        if self.matrix is not None:
            total = f(self.matrix[:TOGETHER])
            for i in range(TOGETHER, len(self.matrix), TOGETHER):
                total = total + f(self.matrix[i : i + TOGETHER])
            return total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(0, batch.num_rows, TOGETHER):
                    part = f(dense(batch.slice(i, TOGETHER).column(0)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pos", "x"])

        table = self.data.mapInArrow(run, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(table.num_rows)
        out[np.asarray(table["pos"])] = np.asarray(table["x"])
        return out

    def medians(self, cells: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> np.ndarray:
        """Medians by cell and dimension; cells without rows keep ``start``."""
        out = start.copy()
        if self.matrix is not None:
            at = cells(self.matrix)
            for c in np.unique(at):
                out[c] = np.median(self.matrix[at == c], axis=0)
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(i, TOGETHER)
                    yield pa.RecordBatch.from_arrays([pa.array(cells(dense(part.column(0)))), part.column(0)], names=["c", "v"])

        long = self.data.mapInArrow(run, "c long, v array<double>").select("c", F.posexplode("v").alias("pos", "x"))
        for r in medians(long, ["c", "pos"], "x").collect():  # a row for each cell and dimension
            out[r["c"], r["pos"]] = r["median"]
        return out
