import numpy as np
import pyarrow as pa
import pytest

from cohortframe.operators import decomposition as D


def matrix(n=90, genes=30, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.gamma(0.5, 2.0, (n, genes)), 3) * (r.random((n, genes)) < 0.4)
    x[:, 4] = x[:, 3]
    x[7] = 0.0  # an observation without values
    return x


def frames(spark, x):
    rows = [(i, f"g{j:03d}", float(v)) for (i, j), v in np.ndenumerate(x) if v]
    return spark.createDataFrame(rows, "obs int, gene string, value double").repartition(3), spark.createDataFrame([(i,) for i in range(len(x))], "obs int")


@pytest.mark.parametrize("centered", [False, True])
def test_svd_equals_dense(spark, centered):
    x = matrix()
    e, o = frames(spark, x)
    rows = D.sparse_rows(e, len(x), o)
    svd = D.truncated_svd(rows, 5, centered)
    a = x - x.mean(0) if centered else x
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(svd.values, s[:5], rtol=1e-9)
    assert np.allclose(np.abs((svd.loadings * v[:5].T).sum(0)), 1.0, atol=1e-7)
    assert np.allclose(svd.variances, x.var(0)) and (svd.loadings[np.abs(svd.loadings).argmax(0), range(5)] > 0).all()
    got = {r["obs"]: r["vector"] for r in D.scores(rows, svd).collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], a @ svd.loadings, atol=1e-9)


def test_leading_needs_several_blocks_and_restarts():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((400, 400)))[0]
    w = 1 - np.arange(400) * 2.5e-6  # a spectrum that hardly falls
    a = (q * w) @ q.T
    values, vectors, residual = D.leading(lambda y: a @ y, 400, 3)
    assert residual <= 1e-8 and np.allclose(values, np.sort(w)[::-1][:3], atol=1e-8)
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-8)


def test_low_rank_and_wide_passes(spark, monkeypatch):
    x = np.outer(np.arange(1.0, 13.0), np.arange(1.0, 7.0))  # rank one
    e, o = frames(spark, x)
    monkeypatch.setattr(D, "SENT", 100)  # two columns of six genes at once
    svd = D.truncated_svd(D.sparse_rows(e, len(x), o), 3)
    assert np.allclose(svd.values, [np.linalg.norm(x), 0, 0], atol=1e-5)


def test_pieces_of_rows(monkeypatch):
    monkeypatch.setattr(D, "_VALUES", 3)
    b = pa.RecordBatch.from_pydict({"at": [[9], [], [0, 1], [4, 5, 6, 7], [2], []], "x": [[9.0], [], [1.0] * 2, [2.0] * 4, [3.0], []]}).slice(1)
    got = [(lo, hi, g.tolist(), x.tolist(), r.tolist()) for lo, hi, g, x, r in D._parts(b)]
    assert got == [(0, 2, [0, 1], [1.0, 1.0], [1, 1]), (2, 3, [4, 5, 6, 7], [2.0] * 4, [0] * 4), (3, 5, [2], [3.0], [0])]


def test_nulls_and_empty(spark):
    x = matrix(8, 6)
    e, o = frames(spark, x)
    bad = spark.createDataFrame([(0, "g000", None), (1, "gzz", float("nan")), (2, None, 4.0)], "obs int, gene string, value double")
    svd = D.truncated_svd(D.sparse_rows(e.where("not (obs = 0 and gene = 'g000')").unionByName(bad), 8, o), 9)
    x[0, 0] = 0.0
    assert len(svd.values) == 6 and np.allclose(svd.values, np.linalg.svd(x)[1], atol=1e-6)
    none = D.sparse_rows(e.limit(0), 0, o.limit(0))
    assert D.truncated_svd(none, 4).values.shape == (0,) and D.scores(none, D.truncated_svd(none, 4)).count() == 0


def test_clusters_of_separate_groups(spark):
    r = np.random.default_rng(3)
    group = np.arange(700) % 3
    x = np.round(r.gamma(1.0, 0.2, (700, 12)), 3)
    for g in range(3):
        x[group == g, g * 4 : g * 4 + 4] += 5 + g
    e, o = frames(spark, x)
    got = {t["obs"]: t["cluster"] for t in D.basic_clusters(e, o).collect()}
    assert len(got) == 700 and len({(group[i], c) for i, c in got.items()}) == 3  # sqrt(2) + 2 = 3 clusters
    named = o.selectExpr("obs", "if(obs = 5, '', 'mine') AS cluster", "obs * 2 AS more")
    filled = D.fill_clusters(named, e)
    assert filled.columns == named.columns and {t["cluster"] for t in filled.collect()} == {"cluster_0", "cluster_1", "cluster_2"}
    whole = o.selectExpr("obs", "'mine' AS cluster")
    assert D.fill_clusters(whole, e) is whole
    assert {t["cluster"] for t in D.basic_clusters(e, o.where("obs < 2")).collect()} == {0}
