"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of this subpackage define it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_OWN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; a
    cluster has no folder that all its machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = f"file://{tempfile.mkdtemp(prefix='vectide-')}"
            atexit.register(shutil.rmtree, _OWN[application].removeprefix("file://"), ignore_errors=True)
        found = _OWN[application]
    return found.rstrip("/")


#: Shuffle files of a finished write go at once; else they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows and bytes of an Arrow batch: texts are long, and a task holds a batch several times over.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
BATCH_SIZE, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"

_CURRENT: ContextVar[Tables | None] = ContextVar("tables", default=None)


class Tables:
    """What operators write inside ``with Tables(spark) as own``: ``own.paths``, in order. ``own.drop()`` deletes it once
    nothing reads it any more; other threads' and other blocks' tables aren't touched."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        self._token = _CURRENT.set(self)
        return self

    def __exit__(self, *_) -> None:
        _CURRENT.reset(self._token)

    def drop(self, but: int = 0) -> None:
        """Delete all tables but the last ``but``."""
        while len(self.paths) > but:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[0])
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            del self.paths[0]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true", BATCH: BATCH_ROWS, BATCH_SIZE: BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    if (own := _CURRENT.get()) is not None:
        own.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small fixed table, as an expression: rows of strings."""
    names = columns.split()
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("r")).select("r.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORKER: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. Workers are shared: what another operator kept goes."""
    if owner not in _WORKER:
        _WORKER.clear()
    return _WORKER.setdefault(owner, {})
