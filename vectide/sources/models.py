"""Binary files of models: mixtures, hierarchies, codebooks and inverted files, on any file system that vecfiles opens.

All numbers are little-endian, 32 bits wide; a vector is its length and its elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators.clustering import Hierarchy
from vectide.operators.inverted import InvertedFile
from vectide.operators.lsh import Codebooks
from vectide.operators.mixture import Mixture

from .vecfiles import _open, _place

# Fixed value: what an inverted file starts with.
IVF_MARK = 0xF0F0F0FA
#: Entries of an inverted file that a task reads together.
ENTRIES = 1 << 20


def _bytes(x, kind: str) -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def _vector(x: np.ndarray) -> bytes:
    return _bytes([x.size], "<i4") + _bytes(x, "<f4")


def _take(f, n: int, kind: str) -> np.ndarray:
    got = f.read(n * np.dtype(kind).itemsize)
    if len(got) != n * np.dtype(kind).itemsize:
        raise ValueError("the file ends early")
    return np.frombuffer(got, kind)


def _take_vector(f, n: int) -> np.ndarray:
    if (found := int(_take(f, 1, "<i4")[0])) != n:
        raise ValueError(f"a vector of {found} elements where {n} are due")
    return _take(f, n, "<f4").astype(float)


def _write(path: str, parts: Iterator[bytes] | list[bytes]) -> None:
    system, _, inner = _place(path)
    with system.open_output_stream(inner) as f:
        for part in parts:
            f.write(part)


def write_mixture(g: Mixture, path: str) -> None:
    """Dimension, components, weights, means, variances."""
    k, d = g.mu.shape
    _write(path, [_bytes([d, k], "<i4"), *(_bytes(x, "<f4") for x in (g.w, g.mu, g.sigma))])


def read_mixture(path: str) -> Mixture:
    with _open(path) as f:
        d, k = _take(f, 2, "<i4").tolist()
        w, mu, sigma = (_take(f, n, "<f4").astype(float) for n in (k, k * d, k * d))
    return Mixture(w, mu.reshape(k, d), sigma.reshape(k, d))


def write_hierarchy(h: Hierarchy, path: str) -> None:
    """Levels, branches, dimension; then the centroids of each level in order of their numbers, one vector a level. A
    node without centroids has zeros."""
    d = next(iter(h.levels[0].values())).shape[1]
    parts = [_bytes([len(h.levels), h.branches, d], "<i4")]
    for depth, level in enumerate(h.levels):
        m = np.zeros((h.branches**depth, h.branches, d))
        for node, c in level.items():
            m[node, : len(c)] = c
        parts.append(_vector(m))
    _write(path, parts)


def read_hierarchy(path: str) -> Hierarchy:
    levels = []
    with _open(path) as f:
        n, branches, d = _take(f, 3, "<i4").tolist()
        for depth in range(n):
            m = _take_vector(f, branches ** (depth + 1) * d).reshape(branches**depth, branches, d)
            levels.append({node: m[node] for node in range(len(m))})
    return Hierarchy(levels, branches)


def write_codebooks(books: Codebooks, path: str) -> None:
    """One vector of all centroids for each codebook."""
    _write(path, [_vector(c) for c in books.books])


def read_codebooks(path: str, hashes: int, cells: int, d: int) -> Codebooks:
    with _open(path) as f:
        return Codebooks([_take_vector(f, cells * d).reshape(cells, d) for _ in range(hashes)])


def write_inverted(file: InvertedFile, path: str) -> None:
    """Mark, lists, entries, bytes of a code; the lists' sizes; all ids by list; all codes by list. A list for each key below
    ``keys``. The driver writes the one file as rows arrive in order, a partition at a time."""
    sizes = [r["n"] for r in file.sizes().orderBy("key").collect()]
    first = file.table.select(F.size("code").alias("n")).first()
    width = 8 * first["n"] if first else 0
    rows = file.table.where(F.col("key") < file.keys).orderBy("key", "id")

    def parts() -> Iterator[bytes]:
        yield _bytes([IVF_MARK], "<u4") + _bytes([file.keys, sum(sizes), width], "<i4") + _bytes(sizes, "<i4")
        for r in rows.select("id").toLocalIterator():
            yield _bytes([r["id"]], "<i4")
        for r in rows.select("code").toLocalIterator():
            yield _bytes(r["code"], "<i8")

    _write(path, parts())


def read_inverted(spark: SparkSession, path: str) -> InvertedFile:
    """The driver reads the sizes of the lists; tasks read ranges of ids and codes."""
    with _open(path) as f:
        if _take(f, 1, "<u4")[0] != IVF_MARK:
            raise ValueError(f"{path}: not an inverted file")
        keys, n, width = _take(f, 3, "<i4").tolist()
        ends = np.cumsum(_take(f, keys, "<i4").astype(np.int64))
    if keys and ends[-1] != n or width % 8:
        raise ValueError(f"{path}: lists of {ends[-1] if keys else 0} entries, {n} are due, with codes of {width} bytes")
    start = 16 + 4 * keys
    shared = spark.sparkContext.broadcast(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                m = min(ENTRIES, n - at)
                with _open(path) as f:
                    f.seek(start + 4 * at)
                    ids = _take(f, m, "<i4").astype(np.int64)
                    f.seek(start + 4 * n + width * at)
                    words = _take(f, m * width // 8, "<i8")
                key = np.searchsorted(shared.value, np.arange(at, at + m), "right")
                offsets = pa.array(np.arange(m + 1, dtype=np.int32) * (width // 8))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(words))], names=["key", "id", "code"])

    places = spark.range(0, n, ENTRIES, max(1, -(-n // ENTRIES)))
    return InvertedFile(places.mapInArrow(run, "key long, id long, code array<long>"), keys)
