"""Operators against numpy, and properties that must hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import clustering, descriptors, hamming, inverted, kernels, linalg, lsh, mixture, neighbours, ordered, rows, tables
from vectide.plans.queries import E


def frame(spark, m, **extra):
    return spark.createDataFrame([(i, [float(x) for x in r], *(v[i] for v in extra.values())) for i, r in enumerate(m)], "id long, v array<double>" + "".join(f", {k} long" for k in extra))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(c, 0.3, (40, 6)) for c in ([0] * 6, [3] * 6, [0, 0, 0, 4, 4, 4])])


def test_ramp_neighbours(spark):
    base = frame(spark, [[i, i + 1, i + 2, i + 3] for i in range(5)])
    queries = frame(spark, [[i + 0.25, i + 1.25, i + 2.25, i + 3.25] for i in range(3)])
    got = {(r["qid"], r["rank"]): (r["bid"], r["dis"]) for r in neighbours.knn(queries, base, 2, "l1").collect()}
    assert got == {(i, k): (i + k - 1, [1.0, 3.0][k - 1]) for i in range(3) for k in (1, 2)}


@pytest.mark.parametrize("metric", kernels.METRICS)
def test_all_search_plans_agree(spark, points, metric):
    df = frame(spark, np.abs(points)).withColumn("w", F.lit(2.0))
    q = df.where("id % 7 = 0")
    want = sorted(map(tuple, neighbours.knn(q, df, 4, metric, weights="w").collect()))
    assert np.allclose(sorted(map(tuple, neighbours.knn(q, df, 4, metric, weights="w", limit=2000).collect())), want)
    m = np.abs(points)
    d = 2 * np.array([[kernels.exact(m[i], m[j], metric) for j in range(len(m))] for i in range(0, len(m), 7)])
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert [r[2] for r in want] == order.ravel().tolist()


def test_search_edges(spark):
    base = frame(spark, [[1.0, 0], [1.0, 0], [0, 1.0]])
    assert [(r["bid"], r["rank"]) for r in neighbours.knn(base.where("id = 0"), base, 9).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert neighbours.knn(base, base.where("false"), 2).count() == 0 and neighbours.knn(base.where("false"), base, 2).count() == 0
    with pytest.raises(ValueError, match="metric"):
        neighbours.knn(base, base, 1, "l7")
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        neighbours.knn(ragged, ragged, 1).collect()


def test_range_join_plans_agree(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, (30, 2))
    near = base.copy()
    for i, r in enumerate(near):
        for _ in range(i % 6):
            r[rng.integers(2)] ^= 1 << int(rng.integers(62))
    m = np.concatenate((base, near))
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(m)], "id long, code array<bigint>")
    d = np.bitwise_count(m[:, None].view(np.uint64) ^ m[None].view(np.uint64)).sum(2)
    for radius in (0, 3, 5, 40, 128):
        want = sorted((i, j, int(d[i, j])) for i, j in zip(*np.nonzero(d <= radius), strict=True))
        assert sorted(map(tuple, hamming.range_join(df, df, radius).collect())) == want
        keyed = df.withColumn("key", F.col("id") % 3)
        assert sorted((r["qid"], r["bid"], r["score"]) for r in hamming.range_join(keyed, keyed, radius, on="key").collect()) == [x for x in want if (x[0] - x[1]) % 3 == 0]
        assert hamming.self_join(df, radius).count() == sum(i < j for i, j, _ in want)
    assert hamming.distances(df, df).count() == len(m) ** 2 and hamming.range_join(df, df, -1).count() == 0


def test_kmeans_properties(spark, points):
    df = frame(spark, points)
    for metric in ("l2", "l1"):
        model = clustering.kmeans(df, 3, metric, rounds=15, init="plusplus")
        assert all(b <= a + 1e-9 for a, b in zip(model.errors, model.errors[1:], strict=False))
        assert model.sizes.sum() == len(points)
    near = model.assign(df).toPandas().sort_values("id")["cluster"].to_numpy().reshape(3, 40)
    assert all(len(set(x)) == 1 for x in near.tolist())
    given = clustering.kmeans(df, 3, init=points[[0, 40, 80]], rounds=1)
    at = ((points[:, None] - points[[0, 40, 80]]) ** 2).sum(2).argmin(1)
    assert np.allclose(given.centroids, [points[at == k].mean(0) for k in range(3)])
    with pytest.raises(ValueError, match="fewer"):
        clustering.kmeans(df, 500, init="first")


def test_each_metric_wins_on_its_own_error(spark):
    rng = np.random.default_rng(3)
    m = rng.random((300, 8)) ** 3
    df = frame(spark, m)
    models = {k: clustering.kmeans(df, 4, k, rounds=12, init="first") for k in ("l2", "l1", "chi2")}
    for metric in ("l1", "chi2"):
        error = {k: kernels.pairwise(m, x.centroids, metric).min(1).mean() for k, x in models.items()}
        assert error[metric] <= error["l2"] + 1e-3


def test_chi2_steps_find_the_centroid(spark):
    a = np.random.default_rng(0).random((50, 3))
    x = kernels.chi2_centroid(a)
    f = lambda y: ((y - a) ** 2 / (y + a)).sum(0)
    assert (f(x) <= f(x * 1.01) + 1e-9).all() and (f(x) <= f(x * 0.99) + 1e-9).all()
    model = clustering.kmeans(frame(spark, a), 1, "chi2", init=a[:1], rounds=1)
    assert np.allclose(model.centroids[0], x, rtol=1e-2)


def test_small_and_large_sets_agree(spark, points):
    df = frame(spark, points)
    f = lambda x: np.concatenate(([len(x)], x.sum(0)))
    assert np.allclose(rows.Rows(df).add_up(f), rows.Rows(df, small=0).add_up(f))
    cells = lambda x: (x[:, 0] > 1.5).astype(np.int64)
    start = np.zeros((3, 6))
    assert np.allclose(rows.Rows(df).medians(cells, start), rows.Rows(df, small=0).medians(cells, start))


def test_hierarchy_and_spectral(spark, points):
    df = frame(spark, points)
    leaves = clustering.hierarchical(df, 2, 2, rounds=5).quantize(df).toPandas()
    assert len(leaves) == len(points) and leaves["leaf"].between(0, 3).all()
    arcs = [[np.cos(0.1 * i), np.sin(0.1 * i)] for i in range(20)] + [[2 * np.cos(0.1 * i), 2 * np.sin(0.1 * i)] for i in range(30)]
    got = clustering.spectral(frame(spark, arcs), 2, 0.25).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(set(got[:20])) == 1 and len(set(got[20:])) == 1 and got[0] != got[-1]


def test_mixture_properties(spark, points):
    df = frame(spark, points, g=[i % 5 for i in range(len(points))])
    g = mixture.fit(df, 3, rounds=15, init=points[[0, 40, 80]])
    assert all(b >= a - 1e-6 for a, b in zip(g.likelihood[1:], g.likelihood[2:], strict=False)) and abs(g.w.sum() - 1) < 1e-9
    back = mixture.Mixture.from_table(g.table(spark))
    assert np.allclose(back.mu, g.mu) and np.allclose(back.sigma, g.sigma)
    p = np.array([r["p"] for r in g.assign(df).orderBy("id").collect()])
    assert np.allclose(p.sum(1), 1) and np.allclose(p, g.posteriors(points)[0])
    include = ("w", "mu", "sigma", "one_sigma")
    sets = {r["g"]: np.array(r["fv"]) for r in mixture.fisher(df, g, "g", include).collect()}
    each = {r["id"]: np.array(r["fv"]) for r in mixture.fisher(df, g, "id", include).collect()}
    assert len(sets[0]) == mixture.fisher_size(g, include)
    for k, fv in sets.items():
        own = [each[i] for i in range(len(points)) if i % 5 == k]
        assert np.allclose(fv, sum(own) / len(own) ** 0.5)  # additive over elements
    q, place = g.posteriors(points)[0], points[:, :2]
    mean, var = mixture.fisher_spatial(q, place, np.zeros((3, 2)), np.ones((3, 2)))
    assert np.allclose(mean, q.T @ place / len(points)) and np.allclose(var, q.T @ (1 - place**2) / len(points))


def test_linear_algebra(spark, points):
    df = frame(spark, points)
    m = linalg.moments(df)
    assert np.allclose(m.covariance(), np.cov(points.T, bias=True)) and np.allclose(m.covariance(unbiased=True), np.cov(points.T))
    p = linalg.pca(df, 3)
    for w, x in zip(p.values, p.vectors, strict=True):
        assert np.linalg.norm(m.covariance() @ x - w * x) < 1e-9
    u, s, v = np.linalg.svd(points - points.mean(0), full_matrices=False)
    assert np.allclose(p.singular_values, s[:3])
    s2, v2 = linalg.svd(df, 2)
    u, s, v = np.linalg.svd(points, full_matrices=False)
    assert np.allclose(s2, s[:2]) and np.allclose(np.abs(v2), np.abs(v[:2]))
    left = np.array([r["p"] for r in linalg.left_singular(df, s2, v2).orderBy("id").collect()])
    assert np.allclose(np.abs(left), np.abs(u[:, :2]))
    b = m.covariance() + np.eye(6)
    for w, x in zip(*linalg.eigen(m.gram, second=b), strict=True):
        assert np.linalg.norm(m.gram @ x - w * (b @ x)) < 1e-6
    w, _ = linalg.power_iteration(lambda q: m.gram @ q, 2, 6)
    assert np.allclose(w, linalg.eigen(m.gram, 2)[0])
    q = linalg.random_orthogonal(7, 3)
    assert np.allclose(q @ q.T, np.eye(7)) and np.allclose(linalg.hadamard(8) @ linalg.hadamard(8).T, 8 * np.eye(8))
    with pytest.raises(ValueError, match="no vectors"):
        linalg.moments(df.where("false"))


def test_hamming_embedding_and_inverted_file(spark, points, tmp_path):
    df = frame(spark, points)
    he = inverted.HammingEmbedding.learn(df, 3, 6, rounds=5)
    signed = he.signatures(df)
    index = inverted.InvertedFile.build(signed, 3)
    index.save(f"file://{tmp_path}/ivf")
    back = inverted.InvertedFile.load(spark, f"file://{tmp_path}/ivf", 3)
    queries = signed.select(F.col("id").alias("qid"), "key", "code")
    met = back.probe(queries, 0)
    assert met.where("qid = bid").count() == len(points)
    assert back.add(signed.limit(1)).table.count() == len(points) + 1
    assert back.find(spark.createDataFrame([(0, 10_000)], "key long, id long")).first()["code"] is None
    with pytest.raises(Exception, match="outside"):
        inverted.InvertedFile.build(signed.withColumn("key", F.lit(9)), 3).table.collect()


def test_lsh_recall_grows(spark, sf_dir):
    e = E(spark, sf_dir).select("id", "v")
    q = e.where("id % 25 = 0")
    exact = {(r["qid"], r["bid"]) for r in neighbours.knn(q, e, 5).collect()}
    found = [len(exact & {(r["qid"], r["bid"]) for r in lsh.approximate_knn(q, e, 5, hashes=h).collect()}) / len(exact) for h in (1, 6)]
    assert found[0] < found[1] and found[1] > 0.4


def test_lsh_recall_of_the_query(spark, sf_dir):
    from vectide.plans.queries import QUERIES

    e = E(spark, sf_dir).select("id", "v")
    exact = {(r["qid"], r["bid"]) for r in neighbours.knn(e.where("id % 50 = 0"), e, 5).collect()}
    got = {(r["qid"], r["bid"]) for r in QUERIES["lsh_knn"](spark, sf_dir).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


def test_descriptor_subsets(spark, points):
    df = frame(spark, points)
    c = frame(spark, points[[0, 40, 80]])
    subsets = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 90)], "subset long, id long")
    got = descriptors.vlad_subsets(df, c, subsets)
    total = np.zeros((2, 3, 6))
    for r in got.collect():
        total[r["subset"], r["cluster"], r["pos"]] = r["x"]
    assert np.allclose(total[0, 0], points[1] + points[2] - 2 * points[0]) and np.allclose(total[1, 2], points[90] - points[80])
    m = descriptors.modulated(df.withColumn("g", F.lit(1)).withColumn("a", F.lit(0.0)), "a", [1.0, 1.0], 2, "g").first()["m"]
    assert len(m) == 3 * 21 and np.allclose(m[21:42], m[:21])


def test_rows_and_order(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.0), (4, float("nan"))], "id long, x double")
    got = {r["p"]: (r["min_rank"], r["max_rank"]) for r in ordered.ranks_of(df, spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "p double"), "x", "p").collect()}
    assert got == {1.0: (1, 3), 2.0: (1, 1), 9.0: (0, 0)}
    places = tables.random_permutation(df, "id", 4)
    assert sorted(r["place"] for r in places.collect()) == [0, 1, 2, 3]
    assert {r["id"] for r in tables.sample_rows(df, 2, "id", 1).collect()} == {r["id"] for r in tables.sample_rows(df, 2, "id", 1).collect()}
    with pytest.raises(Exception, match="outside the bins"):
        tables.histogram(df, F.col("id"), 3).collect()
    x = np.array([r["v"] for r in tables.random_vectors(spark, 2000, 4, 2, normal=True).collect()])
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    x = np.array([r["v"] for r in tables.random_vectors(spark, 2000, 4, 2).collect()])
    assert abs(x.mean() - 0.5) < 0.02 and x.min() >= 0 and x.max() < 1
    assert V.DISTANCES.keys() == set(kernels.METRICS)


def partition(rows):
    groups = {}
    for i, c in rows:
        groups.setdefault(c, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_spectral_plans_agree(spark):
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 3))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    got = [partition((r["id"], r["cluster"]) for r in clustering.spectral(df, 3, 0.7, **kw).collect()) for kw in ({}, {"dense_rows": 10}, {"dense_rows": 10, "limit": 6000, "steps": 4})]
    assert got[0] == got[1] == got[2] == [list(range(25 * i, 25 * i + 25)) for i in range(3)]


def test_exact_medians(spark):
    rng = np.random.default_rng(5)
    data = {0: rng.normal(size=2001), 1: np.repeat([1.0, 2.0, 3.0], [700, 2, 700]), 2: rng.integers(0, 3, 5000).astype(float), 3: np.array([4.0]), 4: np.array([1.0, 2.0]), 5: rng.random(30_000)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [(6, None), (0, None)], "g long, x double")
    got = {r["g"]: r["median"] for r in tables.medians(df, ["g"], "x").collect()}
    assert got == {g: pytest.approx(float(np.median(xs))) for g, xs in data.items()}


def test_running_values_of_one_large_group(spark):
    rows = [("a" if i % 10 else None, i // 2, i, None if i % 7 == 0 else float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t long, i long, x double").repartition(5)
    run = {r["i"]: r["running"] for r in ordered.running_sum(df, "x", ["t", "i"], ["g"]).collect()}
    dif = {r["i"]: r["difference"] for r in ordered.differences(df, "x", ["t", "i"], ["g"]).collect()}
    probes = df.select("g", F.col("i").alias("k"), (F.col("t") + 1).alias("at"))
    seen = {r["k"]: r["i"] for r in ordered.as_of(probes, df.where("i % 13 = 0"), "at", "t", ["g"], ["i"]).collect()}
    for g in ("a", None):
        total, before = None, 0
        own = [r for r in rows if r[0] == g]
        for _, t, i, x in own:
            total = total if x is None else (total or 0) + x
            assert run[i] == total and dif[i] == (None if x is None else x - (before or 0))
            before = x
            assert seen[i] == max((j for h, u, j, _ in own if j % 13 == 0 and u <= t + 1), default=None)


def test_blocks_are_taken_one_by_one(spark, points):
    df, m = frame(spark, points), points
    whole = sorted(map(tuple, neighbours.knn(df, df, 3).collect()))
    assert sorted(map(tuple, neighbours.knn(df, df, 3, limit=2000).collect())) == [(a, b, c, pytest.approx(d)) for a, b, c, d in whole]
    assert neighbours.cross_distances(df, df, limit=2000).count() == len(m) ** 2


def test_kmeans_callback_and_plus_plus(spark, points, monkeypatch):
    df = frame(spark, points)
    seen = []
    clustering.kmeans(df, 3, "cosine", rounds=9, init="first", after=lambda n, model: seen.append((n, model.centroids.shape)) or n < 4)
    assert [n for n, _ in seen] == [1, 2, 3, 4]
    small = clustering._plus_plus(df, 5, "id", "v", 3, "l2")
    monkeypatch.setattr(clustering, "SMALL", 0)
    assert np.allclose(small, clustering._plus_plus(df, 5, "id", "v", 3, "l2")) and len(np.unique(small, axis=0)) == 5


def test_products_in_blocks_equal_joined_ones(spark):
    """Nulls, places that are missing or stand twice, infinities, null rows and keys of two types; in several blocks along each side."""
    rng = np.random.default_rng(5)
    a = [(i, k, float(rng.standard_normal())) for i in range(40) for k in range(30) if rng.random() < 0.7]
    a += [(3, 4, 2.0), (3, 4, None), (None, 7, 1.5), (None, None, 9.0), (41, 2, None), (42, 99, 1.0), (5, 6, float("inf"))]
    b = [(k, f"c{j}", float(rng.standard_normal())) for k in range(30) for j in range(25) if rng.random() < 0.7]
    b += [(4, "c1", 1.0), (7, None, 2.0), (98, "x", 1.0), (None, "c1", 5.0), (2, "n", None)]
    left, right = spark.createDataFrame(a, "i long, k int, x double"), spark.createDataFrame(b, "k long, j string, x double")
    get = lambda **kw: sorted(((r["i"], r["j"], r["x"]) for r in linalg.matmul(left, right, **kw).collect()), key=str)
    want = get(dense_from=2**62)
    for kw in ({}, {"side": 9, "depth": 7}, {"depth": 7}):
        got = get(dense_from=0, **kw)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == [pytest.approx(x[2], abs=1e-9) if x[2] is not None else None for x in want]
    whole = [[(i, k, 1.0 + i * k) for i in range(30) for k in range(20)], [(k, j, 1.0 - j * k) for k in range(20) for j in range(10)]]
    left, right = spark.createDataFrame(whole[0], "i long, k int, x double"), spark.createDataFrame(whole[1], "k int, j int, x double")
    assert get(dense_from=0) == get(dense_from=2**62)
    assert "MapInArrow" in linalg.matmul(left, right, dense_from=0)._jdf.queryExecution().toString()


def test_gaussian_kernels_far_away_and_in_blocks(spark):
    """Vectors far from the origin and near each other, with the rows sent in several blocks."""
    rng = np.random.default_rng(6)
    for m in (rng.normal(size=(40, 5)), 1e6 + rng.normal(size=(40, 5))):
        want = np.exp(-((m[:, None] - m[None]) ** 2).sum(2) / (2 * 0.7 * 0.7))
        assert kernels.gaussian(m, m, 0.7) == pytest.approx(want, abs=1e-12)
        np.fill_diagonal(want, 0)
        df = spark.createDataFrame([(3 * i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
        for limit in (2**28, 800):
            got = clustering.gaussian_kernel(df, 0.7, limit=limit).collect()
            assert len(got) == 1600 and {(r["aid"], r["bid"]) for r in got} == {(3 * i, 3 * j) for i in range(40) for j in range(40)}
            assert all(abs(r["x"] - want[r["aid"] // 3, r["bid"] // 3]) < 1e-12 for r in got)


def _runs(x):
    """Runs of equal values, rounded."""
    return 1 + np.count_nonzero(np.diff(np.round(x, 2)))


def test_kernels_hand_on_equal_values_together(spark):
    """Files then hold them as runs; each pair is there once."""
    m = np.random.default_rng(8).normal(size=(150, 8)) / 8**0.5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    a, b, x = (np.asarray(c.combine_chunks()) for c in clustering.gaussian_kernel(df, 0.7).toArrow().columns)
    assert len(np.unique(a * 150 + b)) == len(x) == 150**2
    assert _runs(x) < len(x) / 10


@pytest.mark.parametrize("flags", ["nn", "nt", "tn", "tt"])
def test_products_shuffle_one_side_once(spark, flags):
    """A right side that can be sent to all tasks isn't shuffled to each block of the left, and equal values come together; the same in every transposition, and by blocks where it can't."""
    n = 150
    m = np.random.default_rng(9).normal(size=(n, 8)) / 8**0.5
    long = spark.createDataFrame([(i, k, float(x)) for i, r in enumerate(m) for k, x in enumerate(r)], "o long, k int, x double")
    left = long.toDF(*(("i", "k", "x") if flags[0] == "n" else ("k", "i", "x")))
    right = long.toDF(*(("j", "k", "x") if flags[1] == "n" else ("k", "j", "x")))
    get = lambda **kw: linalg.matmul(left, right, transpose_left=flags[0] == "t", transpose_right=flags[1] == "t", dense_from=0, **kw)
    sent = get()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    blocks = get(limit=0, side=n // 2, depth=5)
    assert "Join" in blocks._jdf.queryExecution().executedPlan().toString()
    for df in (sent, blocks):
        i, j, x = (np.asarray(c.combine_chunks()) for c in df.toArrow().columns)
        y = np.full((n, n), np.nan)
        y[i, j] = x
        assert len(x) == n * n and np.abs(y - m @ m.T).max() < 1e-12
        assert df is blocks or _runs(x) < len(x) / 10


def test_products_by_blocks_where_the_right_side_is_too_large(spark):
    """Nulls, places that stand twice and infinities, by blocks that are joined and by blocks that are sent."""
    rng = np.random.default_rng(5)
    a = [(i, k, float(rng.standard_normal())) for i in range(40) for k in range(30) if rng.random() < 0.7] + [(3, 4, 2.0), (3, 4, None), (None, 7, 1.5), (41, 2, None), (42, 99, 1.0), (5, 6, float("-inf"))]
    b = [(k, j, float(rng.standard_normal())) for k in range(30) for j in range(25) if rng.random() < 0.7] + [(4, 1, 1.0), (7, None, 2.0), (98, 77, 1.0), (2, 88, None)]
    left, right = spark.createDataFrame(a, "i long, k int, x double"), spark.createDataFrame(b, "k long, j long, x double")
    get = lambda **kw: sorted(((r["i"], r["j"], r["x"]) for r in linalg.matmul(left, right, **kw).collect()), key=str)
    want = get(dense_from=2**62)
    for kw in ({}, {"side": 9}, {"limit": 0}, {"limit": 0, "side": 9, "depth": 7}, {"limit": 0, "depth": 7}):
        got = get(dense_from=0, **kw)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == [pytest.approx(x[2], abs=1e-9) if x[2] is not None else None for x in want]


def test_tiles_and_order_of_value(monkeypatch):
    """Every place once, in order, with infinities, zeros and places that aren't there."""
    monkeypatch.setattr(kernels, "TILE", 12)
    monkeypatch.setattr(kernels, "WIDE", 5)
    monkeypatch.setattr(kernels, "PAIRS", 7)
    for n, m in ((0, 3), (3, 0), (1, 1), (7, 11), (40, 5)):
        seen = np.zeros((n, m), int)
        for i, j in kernels.tiles(n, m):
            assert 0 < (i.stop - i.start) * (j.stop - j.start) <= 12
            seen[i, j] += 1
        assert (seen == 1).all()
    y = np.random.default_rng(1).normal(size=(9, 8))
    y[2, 3], y[4, 5], y[6] = np.inf, -1e300, 0
    there = np.arange(72) % 5 > 0
    for some in (None, there):
        parts = list(kernels.by_value(y, some))
        rows, columns, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        assert max(len(p[0]) for p in parts) <= 7 and (rows * 8 + columns == places).all()
        assert sorted(places) == np.flatnonzero(np.ones(72) if some is None else some).tolist()
        assert (np.diff(np.clip(y.ravel()[places], -1e30, 1e30).astype(np.float32)) >= 0).all()


@pytest.mark.parametrize("kept, spread", [(24, 1.0), (2, 0.3)])
def test_leading_vectors_in_few_products(spark, monkeypatch, kept, spread):
    """Eigenvalues near the rest of the spectrum take a dozen or two products with the kernel, not a hundred; spaces that start anew find the same."""
    rng = np.random.default_rng(7)
    m = np.eye(12)[np.arange(240) % 3] * (2 if spread < 1 else 0) + spread * rng.normal(size=(240, 12)) / 12**0.5
    a = np.exp(-((m[:, None] - m[None]) ** 2).sum(2) / (2 * 0.7 * 0.7))
    np.fill_diagonal(a, 0)
    s = 1 / np.sqrt(a.sum(1))
    a = a * s[:, None] * s
    calls, sums = [], clustering._kernel_sums
    monkeypatch.setattr(clustering, "_kernel_sums", lambda *x: calls.append(1) or sums(*x))
    monkeypatch.setattr(clustering, "KEPT", kept)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    e = np.array([r["e"] for r in clustering._leading(df, 3, 0.7, 0, 2**28, 200, 1e-9).orderBy("id").collect()])
    assert e.T @ e == pytest.approx(np.eye(3), abs=1e-6) and np.diag(e.T @ a @ e) == pytest.approx(np.linalg.eigvalsh(a)[::-1][:3], abs=1e-6)
    assert len(calls) <= 25
