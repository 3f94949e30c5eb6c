"""Vector files, text files and running states."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators.ordered import top_per_group
from vectide.sources import vecfiles
from vectide.streaming.state import OnlineMoments, current, running_top, top_stream


def write(path, records, kind):
    with open(path, "wb") as f:
        for r in records:
            f.write(struct.pack("<i", len(r)) + np.asarray(r, kind).tobytes())


@pytest.mark.parametrize("suffix,kind", [(".fvecs", "<f4"), (".ivecs", "<i4"), (".bvecs", "u1"), (".lvecs", "<i8")])
def test_read_and_split(spark, tmp_path, suffix, kind):
    m = np.arange(300).reshape(60, 5) % 250
    path = f"{tmp_path}/x{suffix}"
    write(path, m, kind)
    assert vecfiles.file_size(path, vecfiles.SUFFIXES[suffix]) == (5, 60)
    df = vecfiles.read_vectors(spark, path, split=100)
    assert [r["v"] for r in df.orderBy("idx").collect()] == m.tolist()
    assert df.rdd.getNumPartitions() > 5
    assert df.where("idx = 37").collect()[0]["v"] == m[37].tolist()
    assert [r["idx"] for r in vecfiles.read_vectors(spark, path, first=10, last=13).collect()] == [10, 11, 12]
    with pytest.raises(Exception, match="vectors of 5"):
        vecfiles.read_vectors(spark, path, dim=6).collect()


def test_bad_files(spark, tmp_path):
    write(f"{tmp_path}/bad.fvecs", [[1.0, 2.0], [1.0]], "<f4")
    with pytest.raises(Exception, match="whole records|differ in length"):
        vecfiles.read_vectors(spark, f"{tmp_path}/bad.fvecs").collect()
    write(f"{tmp_path}/empty.fvecs", [], "<f4")
    assert vecfiles.read_vectors(spark, f"{tmp_path}/empty.fvecs").count() == 0 and vecfiles.file_size(f"{tmp_path}/empty.fvecs") == (-1, 0)


def test_write_and_raw(spark, tmp_path):
    df = spark.range(10).select(F.array(F.col("id").cast("float"), F.lit(2.5)).alias("v")).repartition(3)
    vecfiles.write_vectors(df, f"{tmp_path}/out")
    assert sorted(r["v"] for r in vecfiles.read_vectors(spark, f"{tmp_path}/out").collect()) == [[float(i), 2.5] for i in range(10)]
    vecfiles.write_vectors(df, f"{tmp_path}/raw", format="raw")
    assert vecfiles.read_vectors(spark, f"{tmp_path}/raw", format="raw", dim=2).count() == 10


def test_patterns_and_hidden_files(tmp_path):
    for name in ("a1.fvecs", "a2.fvecs", "b1.fvecs", ".a3.fvecs", "_a4.fvecs", "sub/a5.fvecs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        write(f"{tmp_path}/{name}", [[1.0]], "<f4")
    names = lambda path: [x.removeprefix(f"{tmp_path}/") for x in vecfiles._files(path)]
    assert names(f"{tmp_path}/a*.fvecs") == ["a1.fvecs", "a2.fvecs"] == names(f"file:{tmp_path}/a[12].fvecs")
    assert names(str(tmp_path)) == ["a1.fvecs", "a2.fvecs", "b1.fvecs"] and names(f"{tmp_path}/*/a*") == ["sub/a5.fvecs"]
    with pytest.raises(FileNotFoundError):
        vecfiles._files(f"{tmp_path}/c*")


def test_other_file_systems(tmp_path, monkeypatch):
    """Readers and writers only use what pyarrow's file systems offer."""
    from pyarrow import fs

    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(vecfiles, "_place", lambda path: (system, "store://", path.removeprefix("store://")))
    system.create_dir("box")
    with system.open_output_stream("box/x.fvecs") as f:
        f.write(b"".join(struct.pack("<iff", 2, i, -i) for i in range(50)))
    reader = vecfiles.VectorReader({"path": "store://box", "split": "120"}, "f32")
    parts = reader.partitions()
    assert len(parts) == 5 and parts[0].path == "store://box/x.fvecs"
    assert [v for p in parts for b in reader.read(p) for v in b.column(2).to_pylist()] == [[float(i), float(-i)] for i in range(50)]
    assert vecfiles.file_size("store://box/x.fvecs") == (2, 50)


def test_siftgeo_and_sparse(spark, tmp_path):
    with open(f"{tmp_path}/x.siftgeo", "wb") as f:
        for i in range(3):
            f.write(np.arange(9, dtype="<f4").tobytes() + struct.pack("<i", 4) + bytes([i, 255, 0, 1]))
    rows = vecfiles.read_vectors(spark, f"{tmp_path}/x.siftgeo", format="siftgeo").collect()
    assert [r["v"] for r in rows] == [[i, 255, 0, 1] for i in range(3)] and rows[0]["scale"] == 2.0 and rows[0]["cornerness"] == 8.0
    with open(f"{tmp_path}/x.spfvecs", "wb") as f:
        f.write(struct.pack("<iiiiff", 2, 1, 4, 2, 0.5, -1.0) + struct.pack("<ii", 0, 0))
    rows = vecfiles.read_vectors(spark, f"{tmp_path}/x.spfvecs", format="sparse").collect()
    assert [[tuple(e) for e in r["v"]] for r in rows] == [[(1, 0.5), (4, -1.0)], []]


def test_text(spark, tmp_path):
    df = spark.createDataFrame([([1.5, -2.0],), ([3.0, 4.0],)], "v array<double>")
    vecfiles.write_text(df, f"{tmp_path}/t")
    assert sorted(r["v"] for r in vecfiles.read_text(spark, f"{tmp_path}/t", 2).collect()) == [[1.5, -2.0], [3.0, 4.0]]
    with pytest.raises(Exception, match="differ in length"):
        vecfiles.read_text(spark, f"{tmp_path}/t", 3).collect()


def test_running_top_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    events.repartitionByRange(4, "event_id").write.parquet(f"{tmp_path}/in")
    order = lambda: [F.asc("value"), F.asc("event_id")]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merge = running_top(f"{tmp_path}/top", 2, ["user_id"], order)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = query.lastProgress["batchId"]
    got = sorted(map(tuple, current(spark, f"{tmp_path}/top", last).collect()))
    want = sorted(map(tuple, top_per_group(events, 2, ["user_id"], order()).select("user_id", "event_id", "value").collect()))
    assert got == want


def test_top_of_a_stream_with_state(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    events.repartitionByRange(4, "event_id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    keep = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")
    for _ in range(2):  # a query that starts again goes on from its checkpoint
        query = top_stream(stream, 2, ["user_id"], "value", "event_id").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(180)
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.join(out.groupBy("user_id").agg(F.max("n").alias("n")), ["user_id", "n"])
    want = [(r["user_id"], r["event_id"]) for r in top_per_group(events, 2, ["user_id"], [F.asc("value"), F.asc("event_id")]).collect()]
    assert sorted((r["user_id"], r["event_id"]) for r in last.collect()) == sorted(want) and out.select("n").distinct().count() > 1


def test_stream_of_vector_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def run():
        stream = vecfiles.stream_vectors(spark, f"{tmp_path}/in", elem="f32")
        query = stream.writeStream.foreachBatch(lambda batch, n: seen.extend(r["v"] for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)

    write(f"{tmp_path}/in/b.fvecs", [[1.0, 2.0], [3.0, 4.0]], "<f4")
    run()
    assert sorted(seen) == [[1.0, 2.0], [3.0, 4.0]]
    write(f"{tmp_path}/in/a.fvecs", [[5.0, 6.0]], "<f4")
    run()
    assert sorted(seen) == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]


def test_online_moments(spark):
    m = np.random.default_rng(1).random((90, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")
    state = OnlineMoments(4)
    for i in range(3):
        state.add(df.where(f"id % 3 = {i}"))
    state.add(df.where("false"))
    assert np.allclose(state.covariance(), np.cov(m.T)) and state.pca(2).vectors.shape == (2, 4)
