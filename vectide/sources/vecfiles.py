"""Binary vector files as a data source: ``spark.read``, ``spark.readStream`` and ``df.write`` with ``format("xvecs")``.

Options: path; elem: f32, i32, u8 or i64 (by default from .fvecs, .ivecs, .bvecs, .lvecs); format: vecs (a length
before each vector), raw (no lengths; dim needed), sparse (.spfvecs) or siftgeo; dim: fail on other lengths;
first and last: records [first, last) of each file; split: bytes of a partition.

Records have one size per file, so files are cut between records; a filter on idx = n is read by a seek. Paths can be
globs, on any file system that all executors reach: a mounted one (plain paths, file:), or one that pyarrow opens by its
URI (hdfs://, s3://, gs:// and others).
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ELEMENTS = {"f32": ("<f4", "float"), "i32": ("<i4", "int"), "u8": ("u1", "smallint"), "i64": ("<i8", "bigint")}
SUFFIXES = {".fvecs": "f32", ".ivecs": "i32", ".bvecs": "u8", ".lvecs": "i64"}
GEOMETRY = ("x", "y", "scale", "angle", "mi11", "mi12", "mi21", "mi22", "cornerness")
BATCH = 4096


_URI = re.compile(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]*://")


def _place(path: str) -> tuple[files.FileSystem, str, str]:
    """The file system of a path, what its paths lack of a whole URI, and the path in it."""
    if _URI.match(path):
        system, inner = files.FileSystem.from_uri(path)
        return system, path.removesuffix(inner), inner
    return files.LocalFileSystem(), "", re.sub("^file:(//)?", "", path)


def _open(path: str):
    system, _, inner = _place(path)
    return system.open_input_file(inner)


def _size(path: str) -> int:
    system, _, inner = _place(path)
    return system.get_file_info(inner).size


def file_size(path: str, elem: str = "f32") -> tuple[int, int]:
    """Length of the vectors and their number; (-1, 0) for an empty file."""
    size, width = _size(path), np.dtype(ELEMENTS[elem][0]).itemsize
    if not size:
        return -1, 0
    with _open(path) as f:
        d = struct.unpack("<i", f.read(4))[0]
    if d <= 0 or size % (4 + d * width):
        raise ValueError(f"{path}: not whole records of {d} elements")
    return d, size // (4 + d * width)


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int
    d: int


def _files(path: str) -> list[str]:
    """The files of a path, a folder or a pattern, but hidden ones."""
    # a pattern can't be part of a URI: its folder is asked for
    plain = re.split(r"[*?\[]", path)[0]
    folder = path if plain == path else plain.rpartition("/")[0] or ("/" if path.startswith("/") else ".")
    system, prefix, inner = _place(folder)
    info = system.get_file_info(inner)
    if info.type == files.FileType.Directory:
        found = system.get_file_info(files.FileSelector(inner, recursive=plain != path))
        paths = [x.path for x in found if x.type == files.FileType.File]
        if plain != path:
            pattern = posixpath.normpath(path if folder == "." else inner + path[len(folder) :])
            depth = pattern.count("/")
            paths = [x for x in paths if posixpath.normpath(x).count("/") == depth and fnmatch.fnmatchcase(posixpath.normpath(x), pattern)]
    else:
        paths = [inner] if info.type == files.FileType.File else []
    paths = sorted(x for x in paths if posixpath.basename(x)[0] not in "._")
    if not paths:
        raise FileNotFoundError(path)
    return [prefix + x for x in paths]


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xvecs"

    def _elem(self) -> str:
        path = self.options.get("path", "")
        return self.options.get("elem") or SUFFIXES.get(os.path.splitext(path.rstrip("/*"))[1], "f32")

    def schema(self) -> str:
        kind = self.options.get("format", "vecs")
        if kind == "sparse":
            return "file string, idx long, v array<struct<idx bigint, val double>>"
        if kind == "siftgeo":
            return "file string, idx long, " + ", ".join(f"{x} float" for x in GEOMETRY) + ", v array<smallint>"
        return f"file string, idx long, v array<{ELEMENTS[self._elem()][1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(dict(self.options), self._elem())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return VectorStream(dict(self.options), self._elem())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VectorWriter(dict(self.options), self._elem(), overwrite)


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str], elem: str):
        self.options, self.elem = options, elem
        self.kind = options.get("format", "vecs")
        self.only: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("idx",):
                self.only = int(f.value)
            yield f

    def _record(self, d: int) -> np.dtype:
        if self.kind == "siftgeo":
            return np.dtype([("g", "<f4", 9), ("d", "<i4"), ("v", "u1", (d,))])
        v = ("v", ELEMENTS[self.elem][0], (d,))
        return np.dtype([v] if self.kind == "raw" else [("d", "<i4"), v])

    def partitions(self) -> list[Part]:
        return self.parts_of(_files(self.options["path"]))

    def parts_of(self, paths: list[str]) -> list[Part]:
        out: list[Part] = []
        for path in paths:
            size = _size(path)
            if self.kind == "sparse":
                out.append(Part(path, 0, -1, 0))
                continue
            if not size:
                continue
            if self.kind == "raw":
                d = int(self.options["dim"])
            else:
                with _open(path) as f:
                    f.seek(36 if self.kind == "siftgeo" else 0)
                    d = struct.unpack("<i", f.read(4))[0]
            if not 0 < d < 100_000_000 or "dim" in self.options and d != int(self.options["dim"]):
                raise ValueError(f"{path}: vectors of {d} elements")
            width = self._record(d).itemsize
            if size % width:
                raise ValueError(f"{path}: not whole records of {d} elements")
            first, last = int(self.options.get("first", 0)), min(size // width, int(self.options.get("last", size // width)))
            if self.only is not None:
                first, last = max(first, self.only), min(last, self.only + 1)
            step = max(1, int(self.options.get("split", 64 << 20)) // width)
            out += [Part(path, i, min(i + step, last), d) for i in range(first, last, step)]
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no records
            return
        if self.kind == "sparse":
            yield from self._sparse(part.path)
            return
        record = self._record(part.d)
        with _open(part.path) as f:
            f.seek(part.first * record.itemsize)
            for at in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - at)
                rows = np.frombuffer(f.read(n * record.itemsize), record)
                if self.kind != "raw" and (rows["d"] != part.d).any():
                    raise ValueError(f"{part.path}: vectors differ in length")
                flat = rows["v"].ravel()
                flat = flat.astype(np.int16) if flat.dtype == np.uint8 else flat
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.d), pa.array(np.ascontiguousarray(flat)))
                columns = {"file": pa.array([part.path] * n), "idx": pa.array(np.arange(at, at + n))}
                if self.kind == "siftgeo":
                    columns |= {x: pa.array(np.ascontiguousarray(rows["g"][:, k])) for k, x in enumerate(GEOMETRY)}
                yield pa.RecordBatch.from_pydict(columns | {"v": v})

    def _sparse(self, path: str) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("idx", pa.int64()), ("val", pa.float64())]))
        rows, at = [], 0
        with _open(path) as f:
            while head := f.read(4):
                n = struct.unpack("<i", head)[0]
                idx = np.frombuffer(f.read(4 * n), "<i4")
                if struct.unpack("<i", f.read(4))[0] != n:
                    raise ValueError(f"{path}: positions and values differ in number")
                rows.append([{"idx": int(i), "val": float(x)} for i, x in zip(idx, np.frombuffer(f.read(4 * n), "<f4"), strict=True)])
                if len(rows) == BATCH:
                    yield self._sparse_batch(path, at, rows, kind)
                    rows, at = [], at + BATCH
        if rows:
            yield self._sparse_batch(path, at, rows, kind)

    def _sparse_batch(self, path, at, rows, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": pa.array([path] * len(rows)), "idx": pa.array(range(at, at + len(rows)), pa.int64()), "v": pa.array(rows, kind)})


class VectorStream(DataSourceStreamReader):
    """Files as they come, in order of their time and name. Offsets count files, so files are to be moved in whole and
    stay where they are while the stream's checkpoint is in use."""

    def __init__(self, options: dict[str, str], elem: str):
        self.options, self.reader = options, VectorReader(options, elem)

    def _ordered(self) -> list[str]:
        try:
            paths = _files(self.options["path"])
        except FileNotFoundError:
            return []
        placed = [(_place(x), x) for x in paths]
        return [x for _, x in sorted((system.get_file_info(inner).mtime_ns or 0, x) for (system, _, inner), x in placed)]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._ordered())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.reader.parts_of(self._ordered()[start["files"] : end["files"]])

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return self.reader.read(part)


class VectorWriter(DataSourceArrowWriter):
    """One file for each task; files can be strung together. Column v holds the vectors."""

    def __init__(self, options: dict[str, str], elem: str, overwrite: bool):
        self.options, self.elem = options, elem
        self.path = options["path"].rstrip("/")
        system, _, inner = _place(self.path)
        if overwrite and system.get_file_info(inner).type == files.FileType.Directory:
            for x in system.get_file_info(files.FileSelector(inner)):
                if x.type == files.FileType.File:
                    system.delete_file(x.path)
        system.create_dir(inner, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, _, inner = _place(self.path)
        name = f"part-{context.partitionId():06d}{ {k: s for s, k in SUFFIXES.items()}[self.elem] }"
        hidden = f"{inner}/.{name}-{context.taskAttemptId()}"
        with system.open_output_stream(hidden) as f:
            for batch in batches:
                for v in batch.column(batch.schema.get_field_index("v")):
                    x = np.asarray(v.values).astype(ELEMENTS[self.elem][0])
                    if self.options.get("format", "vecs") != "raw":
                        f.write(struct.pack("<i", len(x)))
                    f.write(x.tobytes())
        system.move(hidden, f"{inner}/{name}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        system, _, inner = _place(self.path)
        system.open_output_stream(f"{inner}/_SUCCESS").close()

    def abort(self, messages) -> None:
        return None


def register(spark) -> None:
    """Make the format known; Python sources only get filters if the session lets them."""
    spark.dataSource.register(VectorFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_vectors(spark, path: str, **options):
    register(spark)
    reader = spark.read.format("xvecs")
    for k, x in options.items():
        reader = reader.option(k, x)
    return reader.load(path)


def stream_vectors(spark, path: str, **options):
    """A stream of the vectors of a folder's files, also of those that come later."""
    register(spark)
    reader = spark.readStream.format("xvecs")
    for k, x in options.items():
        reader = reader.option(k, x)
    return reader.load(path)


def write_vectors(df, path: str, elem: str = "f32", mode: str = "overwrite", **options) -> None:
    register(df.sparkSession)
    writer = df.select("v").write.format("xvecs").mode(mode).option("elem", elem)
    for k, x in options.items():
        writer = writer.option(k, x)
    writer.save(path)


def read_text(spark, path: str, d: int | None = None):
    """idx, v from lines of numbers; other lengths than ``d`` fail."""
    from pyspark.sql import functions as F

    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(v.alias("v"))
    return rows if d is None else rows.select(F.when(F.size("v") == d, F.col("v")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>")).alias("v"))


def write_text(df, path: str, mode: str = "overwrite") -> None:
    from pyspark.sql import functions as F

    df.select(F.array_join(F.col("v").cast("array<string>"), " ").alias("value")).write.mode(mode).text(path)
