import numpy as np
import pytest

from cohortframe.operators import selection


def table(spark, seed=0, n=60, genes=14):
    r = np.random.default_rng(seed)
    x = np.round(r.gamma(0.6, 2.0, (n, genes)), 3) * (r.random((n, genes)) < 0.55)
    x[:, 3] = x[:, 2] * 2
    x[:, 5] = (np.arange(n) < 20) * 4.0
    x[:, 6] = 1.5
    rows = [(i, f"g{j:02d}", float(x[i, j])) for i in range(n) for j in range(genes) if x[i, j]]
    return x, spark.createDataFrame(rows, "obs int, gene string, value double").repartition(3)


def test_graph_locality(spark):
    x, df = table(spark)
    n = len(x)
    r = np.random.default_rng(1)
    a = np.zeros((n, n))
    for i in range(n - 2):  # two rows have no edge
        for j in r.choice(n, 3, replace=False):
            a[i, j] = r.random()
    e = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src int, dst int, weight double")
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    s = a @ z
    locality, residual = (z * s).mean(0), ((z - s) ** 2).mean(0)
    got = {t["gene"]: t for t in selection.graph_locality(df, e, n).collect()}
    for j in range(x.shape[1]):
        t = got[f"g{j:02d}"]
        assert np.allclose([t["locality"], t["residual"], t["score"]], [locality[j], residual[j], locality[j] - 0.18 * residual[j]], atol=1e-9)


def test_graph_locality_moves_a_row_once_a_block(spark):
    x, df = table(spark, 4, n=90)
    n = len(x)
    r = np.random.default_rng(5)
    edges = [(i, j, float(r.random())) for i in range(n) for j in range(max(0, i - 6), min(n, i + 7)) if i != j]
    edges += [edges[7], (3, 10_000, 0.5), (20_000, 4, 0.25)]  # one twice, an end and a start without values
    a = np.zeros((n, n))
    for i, j, w in edges:
        if max(i, j) < n:
            a[i, j] += w
    e = spark.createDataFrame(edges, "src int, dst int, weight double")
    nodes = spark.createDataFrame([(i, i // 30, i % 30) for i in range(n)], "obs int, block int, at int")
    # blocks of 30 need their own rows and six on either side, not a row an edge
    assert selection._wanted(e.where("src < 90 and dst < 90"), nodes).count() == 90 + 2 * 6 + 2 * 6
    z_of = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    s = a @ z_of
    want = selection.graph_locality(df, e.where("src < 90 and dst < 90"), n, cells=200).collect()
    assert len(want) == x.shape[1]
    for t in want:
        j = int(t["gene"][1:])
        assert np.isclose(t["locality"], (z_of * s).mean(0)[j], atol=1e-9) and np.isclose(t["residual"], ((z_of - s) ** 2).mean(0)[j], atol=1e-9)
    # ends and starts without values are nodes of zeros
    b = np.zeros((n + 2, n + 2))
    b[:n, :n], b[3, n], b[n + 1, 4] = a, 0.5, 0.25
    x2 = np.vstack((x, np.zeros((2, x.shape[1]))))
    z2 = (x2 - x2.mean(0)) / np.maximum(x2.std(0), 1e-6)
    s2 = b @ z2
    for cells in (100, 1 << 20):
        for t in selection.graph_locality(df, e, n + 2, cells=cells).collect():
            j = int(t["gene"][1:])
            assert np.isclose(t["locality"], (z2 * s2).mean(0)[j], atol=1e-9) and np.isclose(t["residual"], ((z2 - s2) ** 2).mean(0)[j], atol=1e-9)


def test_state_information(spark):
    x, df = table(spark, 2)
    n = len(x)
    state = np.array([0 if i < 20 else 1 + i % 2 for i in range(n)])
    st = spark.createDataFrame([(i, f"s{int(state[i])}") for i in range(n)], "obs int, state string")
    q = np.quantile(x, [0.33, 0.67], axis=0)
    bins = (x > q[0]).astype(int) + (x > q[1])
    ps = np.bincount(state) / n
    got = {t["gene"]: t for t in selection.state_information(df, st).collect()}
    for j in range(x.shape[1]):
        joint = np.zeros((3, 3))
        np.add.at(joint, (state, bins[:, j]), 1 / n)
        pg = joint.sum(0)
        ok = joint > 0
        info = (joint[ok] * np.log2(joint[ok] / (np.outer(ps, pg)[ok] + 1e-12))).sum()
        t = got[f"g{j:02d}"]
        assert np.isclose(t["information"], info, atol=1e-9) and np.isclose(t["entropy"], -sum(p * np.log2(p + 1e-12) for p in pg if p), atol=1e-9)
        assert np.isclose(t["gain"], info / -(ps * np.log2(ps + 1e-12)).sum(), atol=1e-9)
    assert got["g05"]["gain"] > 0.5 and got["g06"]["information"] < 1e-9


def plain_greedy(base, alike, k, penalty):
    out = []
    while len(out) < k:
        best = max((i for i in range(len(base)) if i not in out), key=lambda i: (base[i] - penalty * max([alike[i][j] for j in out], default=0.0), -i))
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_equals_plain_loop(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(3, 60))
    alike = np.abs(np.corrcoef(r.normal(size=(n, 6))))
    np.fill_diagonal(alike, 0)
    base = np.round(r.random(n), 1)  # ties
    k = int(r.integers(1, n))
    assert selection.greedy(base, alike, k, 0.4) == plain_greedy(base, alike, k, 0.4)


def test_diverse_selection(spark):
    x, df = table(spark, 3)
    n, genes = x.shape
    corr = selection.gene_correlation(df, [f"g{j:02d}" for j in range(genes)], n)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    assert np.allclose(corr, np.minimum(np.abs(z.T @ z) / (n - 1), 1.0), atol=1e-9)
    score = {f"g{j:02d}": float(j % 5) for j in range(genes)}
    df2 = spark.createDataFrame(list(score.items()), "gene string, score double")
    got = {t["gene"]: t for t in selection.diverse_selection(df2, df, n, 5, penalty=0.6).collect()}
    pool = sorted(score, key=lambda g: (score[g], g))
    alike = corr.copy()
    np.fill_diagonal(alike, 0)
    at = [int(g[1:]) for g in pool]
    want = plain_greedy((np.arange(genes) + 0.5) / genes, alike[np.ix_(at, at)], 5, 0.6)
    assert [g for g in sorted(got, key=lambda g: got[g]["position"] or 99)][:5] == [pool[i] for i in want]
    assert [round(got[pool[i]]["final_score"], 6) for i in want] == [2.0, 1.8, 1.6, 1.4, 1.2]
    assert all(got[g]["final_score"] < -1 for g in pool if got[g]["position"] is None)
    few = selection.diverse_selection(df2.limit(4), df, n, 3).collect()
    assert all(t["position"] is None for t in few)
