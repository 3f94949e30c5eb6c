import struct

import numpy as np
import pytest

from vectide import jobs
from vectide.operators import clustering
from vectide.sources import vecfiles


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    m = np.random.default_rng(3).random((60, 4)).astype("<f4")
    path = f"{tmp_path_factory.mktemp('vectors')}/x.fvecs"
    with open(path, "wb") as f:
        for r in m:
            f.write(struct.pack("<i", 4) + r.tobytes())
    return path, m.astype(float)


def test_jobs(spark, data, tmp_path):
    path, m = data
    jobs.main(["knn", "--base", path, "--query", path, "--k", "2", "--nq", "5", "--out", f"{tmp_path}/knn"])
    rows = spark.read.parquet(f"{tmp_path}/knn").orderBy("qid", "rank").collect()
    d = ((m[:5, None] - m[None]) ** 2).sum(2)
    assert [r["bid"] for r in rows] == np.argsort(d, 1)[:, :2].ravel().tolist()
    jobs.main(["kmeans", "--data", path, "--k", "3", "--rounds", "5", "--out", f"{tmp_path}/c"])
    assert vecfiles.read_vectors(spark, f"{tmp_path}/c").count() == 3
    jobs.main(["dump", "--data", path, "--out", f"{tmp_path}/t"])
    assert np.allclose([r["v"] for r in vecfiles.read_text(spark, f"{tmp_path}/t").collect()][0], m[0]) or vecfiles.read_text(spark, f"{tmp_path}/t").count() == 60
    jobs.main(["pca", "--data", path, "--n", "2", "--power", "0.5", "--norm", "2", "--out", f"{tmp_path}/p"])
    assert len(vecfiles.read_vectors(spark, f"{tmp_path}/p").first()["v"]) == 2
    assert jobs.load(spark, f"{tmp_path}/t/*.txt").count() == 60


def test_hierarchy_round_trip(spark, data):
    _, m = data
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")
    made = clustering.hierarchical(df, 2, 2, rounds=3)
    back = clustering.Hierarchy.from_table(made.table(spark))
    assert sorted(map(tuple, back.quantize(df).collect())) == sorted(map(tuple, made.quantize(df).collect()))


def test_queries_in_slices(spark, data, tmp_path):
    path, _ = data
    jobs.main(["knn", "--base", path, "--query", path, "--k", "3", "--out", f"{tmp_path}/whole"])
    jobs.main(["knn", "--base", path, "--query", path, "--k", "3", "--step", "25", "--out", f"{tmp_path}/slices"])
    rows = lambda x: sorted((r["qid"], r["rank"], r["bid"]) for r in spark.read.parquet(f"{tmp_path}/{x}").collect())
    assert rows("whole") == rows("slices") and spark.read.parquet(f"{tmp_path}/slices").select("first").distinct().count() == 3


def test_model_files(spark, data, tmp_path):
    from vectide.operators import inverted, lsh
    from vectide.sources import models

    path, m = data
    jobs.main(["gmm", "--data", path, path, "--k", "2", "--n", "50", "--out", f"{tmp_path}/x.gmm"])
    g = models.read_mixture(f"{tmp_path}/x.gmm")
    raw = open(f"{tmp_path}/x.gmm", "rb").read()
    assert struct.unpack("<ii", raw[:8]) == (4, 2) and len(raw) == 8 + 4 * (2 + 8 + 8) and abs(g.w.sum() - 1) < 1e-6
    models.write_mixture(g, f"{tmp_path}/y.gmm")
    assert open(f"{tmp_path}/y.gmm", "rb").read() == raw
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    h = clustering.hierarchical(df, 2, 2, rounds=3)
    models.write_hierarchy(h, f"{tmp_path}/h")
    again = models.read_hierarchy(f"{tmp_path}/h")
    assert all(np.allclose(a[k], b[k]) for a, b in zip(h.levels, again.levels, strict=True) for k in a) and len(open(f"{tmp_path}/h", "rb").read()) == 12 + 4 + 4 * 8 + 4 + 4 * 16
    books = lsh.Codebooks.learn(df, 2, 3)
    models.write_codebooks(books, f"{tmp_path}/b")
    assert all(np.allclose(a, b) for a, b in zip(books.books, models.read_codebooks(f"{tmp_path}/b", 2, 3, 4).books, strict=True))
    rows = [(i % 3, i, [i * 7 - 100, -i]) for i in range(50)]
    file = inverted.InvertedFile.build(spark.createDataFrame(rows, "key long, id long, code array<long>"), 5)
    models.write_inverted(file, f"{tmp_path}/i")
    found = models.read_inverted(spark, f"{tmp_path}/i")
    assert found.keys == 5 and sorted((r["key"], r["id"], r["code"]) for r in found.table.collect()) == sorted(rows)
    assert len(open(f"{tmp_path}/i", "rb").read()) == 16 + 20 + 50 * (4 + 16)
