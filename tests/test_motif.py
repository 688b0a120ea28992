from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from cohortframe.operators import clustering, motif


def test_assignment():
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        cost = r.random((n, n))
        best = min(permutations(range(n)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
        assert motif.assignment(cost).tolist() == list(best)


def test_fit_and_assign(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(300):
        k = i % 3
        rows.append((i, f"s{i % 4}", (np.eye(5)[k] * 8 + r.normal(size=5) + (i % 4) * 3).tolist()))
    df = motif.normalize_by_sample(spark.createDataFrame(rows, "obs_id int, sample_id string, vector array<double>"))
    model = motif.fit(df, 3, 3)
    got = {x.obs_id: x.motif_id for x in motif.assign(df, model).collect()}
    assert len(got) == 300 and len({(i % 3, m) for i, m in got.items()}) == 3
    same, cost = motif.align(model, model)
    assert all(a == b for a, b in same.items()) and cost < 1e-9
    vectors = {x.obs_id: x.vector for x in df.collect()}
    for m in set(got.values()):
        own = np.mean([v for i, v in vectors.items() if got[i] == m], axis=0)
        assert np.allclose(model.feature_centroids[int(m[6:])], own)  # every row is a training row here
    table, folds = motif.held_out_motifs(df, model, 3)
    assert table.count() == 300 and {x.obs_id: x.motif_id for x in table.collect()} == got
    assert all(f.agreement == 1.0 and f.n_test == 75 and f.n_train_samples == 3 for f in folds.collect()) and folds.count() == 4


def test_balanced_training(spark):
    rows = [(i, "a" if i < 40 else "b" if i < 1000 else "c", [1.0]) for i in range(6000)]
    df = spark.createDataFrame(rows, "obs_id int, sample_id string, vector array<double>")
    for most, want in ((2048, 40), (25, 25)):
        got = motif.balanced_training(df, most)
        assert got.columns == df.columns or set(got.columns) == set(df.columns)
        assert {r["sample_id"]: r["count"] for r in got.groupBy("sample_id").count().collect()} == {"a": want, "b": want, "c": want}


def test_cluster_count(spark):
    """Six far groups: six is chosen, and every index equals the one worked out by hand from the same clustering."""
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 4)) * 60
    x = base[np.arange(1900) % 6] + r.normal(size=(1900, 4))
    df = spark.createDataFrame([(v.tolist(), int(i % 6)) for i, v in enumerate(x)], "vector array<double>, label int")
    got = {t["clusters"]: t for t in clustering.cluster_counts(df).collect()}
    assert sorted(got) == [4, 5, 6] and clustering.choose_cluster_count(df) == 6
    mean = [x[i::6].mean(0) for i in range(6)]
    within = sum(((x[i::6] - mean[i]) ** 2).sum() for i in range(6))
    between = sum(len(x[i::6]) * ((mean[i] - x.mean(0)) ** 2).sum() for i in range(6))
    want = between / 5 / (within / (1900 - 6))
    assert np.isclose(got[6]["calinski_harabasz"], want) and np.isclose(got[6]["score"], want - 0.3)
    own = clustering.calinski_harabasz(df, "label").first()
    assert (own["n"], own["clusters"]) == (1900, 6) and np.isclose(own["calinski_harabasz"], want) and np.isclose(own["within"], within)
    model = motif.fit(motif.normalize_by_sample(df.select(F.monotonically_increasing_id().alias("obs_id"), F.lit("s").alias("sample_id"), "vector")), None, 4)
    assert len(model.centroids) == 6


def test_cluster_count_by_hand(spark):
    """Two and two points on a line: means 1 and 11, between 4 * 25, within 4 * 1, index 100 / 1 / (4 / 2)."""
    df = spark.createDataFrame([([0.0], "a"), ([2.0], "a"), ([10.0], "b"), ([12.0], "b"), ([7.0], None)], "vector array<double>, label string")
    got = clustering.calinski_harabasz(df, "label").first()
    assert tuple(got) == (4, 2, 100.0, 4.0, 50.0)
    one = clustering.calinski_harabasz(df.where("label = 'a'"), "label").first()
    assert one["calinski_harabasz"] is None
    assert clustering.choose_cluster_count(df) == 4 and clustering.choose_cluster_count(df.limit(3)) == 3 and clustering.choose_cluster_count(df.limit(0)) == 2


def test_moments(spark):
    r = np.random.default_rng(2)
    x, key = r.normal(size=(200, 3)), r.integers(0, 4, 200)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(key, x)], "k int, vector array<double>").repartition(5)
    got = {t["key"]: t for t in clustering.moments(df, "k").collect()}
    assert set(got) == {None, "0", "1", "2", "3"}
    for held in range(4):
        n, mean, cov = clustering.whole(got[None], got[str(held)])
        own = x[key != held]
        assert n == len(own) and np.allclose(mean, own.mean(0)) and np.allclose(cov, np.cov(own.T, bias=True))


def test_folds_equal_plain_loop(spark):
    """Each fold's model equals one fitted on the other samples alone."""
    r = np.random.default_rng(4)
    base, rows = r.normal(size=(3, 6)) * 9, []
    for i in range(420):
        rows.append((i, f"s{i % 7}", (base[i % 3] + r.normal(size=6)).tolist()))
    df = spark.createDataFrame(rows, "obs_id int, sample_id string, vector array<double>")
    [folds] = motif.fold_models(df, 3, 3)
    assert folds.names == [f"s{i}" for i in range(7)]
    for f, held in enumerate(folds.names):
        own = np.array([v for _, s, v in rows if s != held])
        mean, scale = own.mean(0), own.std(0)
        assert np.allclose(folds.mean[f], mean) and np.allclose(folds.scale[f], scale)
        u = np.linalg.svd((own - mean) / scale, full_matrices=False)[2][:3]
        assert np.allclose(np.abs((u * folds.components[f]).sum(1)), 1)
        kinds = np.array([i % 3 for i, s, _ in rows if s != held])
        want = sorted(own[kinds == k].mean(0).tolist() for k in range(3))
        assert np.allclose(sorted(folds.centers[f].tolist()), want)


def test_jobs_do_not_grow_with_samples(spark):
    def jobs(samples):
        r = np.random.default_rng(0)
        rows = [(i, f"s{i % samples}", (np.eye(3)[i % 3] * 20 + r.normal(size=3)).tolist()) for i in range(samples * 15)]
        df = spark.createDataFrame(rows, "obs_id int, sample_id string, vector array<double>")
        spark.sparkContext.setJobGroup(f"folds{samples}", "")
        motif.fold_models(df, 3, 2, rounds=3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{samples}"))

    assert jobs(40) <= jobs(4) + 3
