"""Cases worked out by hand: what the rules give at their edges, whatever the SQL of the catalogue says."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import decisions as D
from cohortframe.operators import differential as X
from cohortframe.operators import hvg as H
from cohortframe.operators import neighborhood as N
from cohortframe.operators import pareto as P
from cohortframe.operators import representation as R
from cohortframe.operators import testing as T
from cohortframe.sources import tables

NAN, INF = math.nan, math.inf


def column(spark, names, rows, c):
    return [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split())).select(c).collect()]


def test_signs(spark):
    rows = [(1.0, 2.0), (-1.0, 2.0), (1e-9, 5.0), (5.0, 1e-9), (1e-9, -1e-9), (NAN, NAN), (1.0, INF), (None, 1.0)]
    assert column(spark, "a b", rows, D.sign_match(F.col("a"), F.col("b"))) == [1.0, 0.0, 1.0, 0.0, 1.0, None, None, None]
    assert column(spark, "a b", rows, D.sign_match_strict(F.col("a"), F.col("b"))) == [True, False, False, False, True, False, False, False]


def test_tiers_with_missing_numbers(spark):
    names = "sample_p max_t_p null_p loso naive_p"
    rows = [(0.1, 0.1, 0.1, 0.9, 0.5), (0.1, 0.1, NAN, 0.9, 0.5), (0.1, 0.1, 0.1, NAN, 0.5), (NAN, 0.1, 0.1, 0.9, 1e-6), (0.3, 0.1, 0.1, 0.9, 1e-6), (0.3, 0.1, 0.1, 0.9, None)]
    tier = T.support_tier(*[F.col(c) for c in names.split()])
    assert column(spark, names, rows, tier) == ["heldout_supported", "sample_level_supported", "not_supported", "not_supported", "naive_only", "not_supported"]
    rows = [(0.5, 0.5, 0.05, 0.1, 0.2), (0.04, NAN, NAN, -0.2, -0.1), (0.09, 0.5, 0.5, -0.1, 0.1), (NAN, NAN, NAN, NAN, NAN), (0.5, 0.2, 0.5, NAN, NAN)]
    evidence = T.evidence_tier(*[F.col(c) for c in "a b c d e".split()])
    assert column(spark, "a b c d e", rows, evidence) == ["strong", "moderate", "weak", "none", "weak"]


def test_decision_labels(spark):
    df = spark.createDataFrame([("heldout_supported", 0.9), ("naive_only", 0.01), ("not_supported", NAN), ("not_supported", 0.2)], "t string, p double")
    assert [r[0] for r in df.select(D.decision_label(F.col("t"), F.col("p"))).collect()] == ["robust_biological_signal", "naive_only_signal", "no_signal", "no_signal"]


def test_classes(spark):
    reg = P.registry_of_mode(spark, " Discrete ")
    cases = {
        "clean_win": dict(var_ratio=0.0, lisi=0.1, ari=0.01, nmi=0.0), "near_clean": dict(var_ratio=-0.01, lisi=0.0, ari=0.003, nmi=-0.002), "mixed_tradeoff": dict(var_ratio=-0.02, lisi=0.0, ari=0.003, nmi=0.0),
        "dominated": dict(var_ratio=-0.02, lisi=0.0, ari=0.0, nmi=0.0), "flat_or_tied": dict(var_ratio=0.0, lisi=0.0, ari=1e-10, nmi=0.0),
    }
    rows = [(label, m, v) for label, ms in cases.items() for m, v in ms.items()]
    got = {r.config_id: r for r in P.classify(spark.createDataFrame(rows, "config_id string, metric_name string, delta double"), reg).collect()}
    assert {k: r.pareto_label for k, r in got.items()} == {k: k for k in cases}
    assert got["near_clean"].loss_metrics == "var_ratio,nmi" and got["near_clean"].target_gain_metrics == "ari" and got["near_clean"].protected_loss_count == 1


def test_alpha_grid():
    assert P.alpha_grid() == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert P.alpha_grid(step=0.4) == [0.0, 0.4, 0.8]
    assert P.alpha_grid(values=[1, 0.333, 0.3333]) == [0.33, 1.0]
    with pytest.raises(ValueError):
        P.alpha_grid(values=[1.5])


def spots(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, sample_id string, spatial_x double, spatial_y double, motif_id string")


def test_density_of_lone_and_coincident_spots(spark):
    s = spots(spark, [(1, "a", 0.0, 0.0, "m"), (2, "b", 5.0, 5.0, "m"), (3, "b", 5.0, 5.0, "m"), (4, "c", 0.0, 0.0, "m"), (5, "c", 2.0, 0.0, "m")])
    got = {r.src: r for r in N.density(N.knn_edges(s, 6), s).collect()}
    assert (got[1].neighbor_count, got[1].support_radius) == (1, 1.0) and got[1].area_density == pytest.approx(1 / math.pi)
    assert (got[2].support_radius, got[2].area_density) == (0.0, 0.0)
    assert got[4].area_density == pytest.approx(1 / (4 * math.pi))


@pytest.mark.parametrize("width", [1, 2, 32])
def test_knn_with_outliers_and_ties(spark, width):
    r = np.random.default_rng(width)
    at = [(float(x), float(y)) for x, y in np.round(r.normal(0, 3, (160, 2)), 1)] + [(1e9, 0.0), (1e9, 1.0), (-3e8, 4e8)] + [(1.0, 1.0)] * 9 + [(float(i), 7.0) for i in range(30)]
    rows = [(7 * i % 1009, "s", x, y, "m") for i, (x, y) in enumerate(at)] + [(5000 + i, "t", float(i % 4), float(i // 4), "m") for i in range(20)]
    want = {}
    for i, s, x, y, _ in rows:
        near = sorted((math.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)), j) for j, s2, x2, y2, _ in rows if s2 == s and j != i)[:5]
        want[i] = [(j, round(d, 6)) for d, j in near]
    got = {}
    for e in sorted(N.knn_edges(spots(spark, rows), 5, width=width).collect(), key=lambda e: e["rank"]):
        got.setdefault(e.src, []).append((e.dst, round(e.dist, 6)))
    assert got == want


def test_radius_by_sample_and_fallback(spark):
    s = spots(spark, [(1, "a", 0.0, 0.0, "m"), (2, "a", 1.0, 0.0, "m"), (3, "a", 9.0, 0.0, "m"), (4, "b", 0.0, 0.0, "m"), (5, "b", 4.0, 0.0, "m")])
    radius = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "sample_id string, radius double")
    e = N.radius_edges(s, radius)
    assert sorted((r.src, r.dst, r.dist) for r in e.collect()) == [(1, 2, 1.0), (2, 1, 1.0), (3, 2, 8.0), (4, 5, 4.0), (5, 4, 4.0)]
    assert {r.src: r.support_radius for r in N.density(e, s, radius).collect()} == {1: 2.0, 2: 2.0, 3: 8.0, 4: 5.0, 5: 5.0}


def test_partner_of_a_lonely_motif(spark):
    s = spots(spark, [(1, "a", 0.0, 0.0, "m"), (2, "a", 1.0, 0.0, "m"), (3, "b", 0.0, 0.0, "m"), (4, "b", 1.0, 0.0, "n")])
    got = {(r.sample_id, r.motif_id): (r.top_partner, r.top_partner_share) for r in N.colocalization(N.weighted(N.knn_edges(s, 1), s), s).collect()}
    assert got == {("a", "m"): ("m", 1.0), ("b", "m"): ("n", 1.0), ("b", "n"): ("m", 1.0)}


def test_coherence_equals_all_permutations(spark):
    labels = "mmnnn"
    s = spots(spark, [(i, "a", float(i * i), 0.0, c) for i, c in enumerate(labels)] + [(9, "b", 0.0, 0.0, "m")])
    e = N.weighted(N.knn_edges(s, 2), s)
    got = N.coherence_test(e, s).first()
    edges = [(r.src, r.dst, r.weight) for r in e.collect() if r.sample_id == "a"]
    every = [(sum(w for a, b, w in edges if p[a] == p[b]) + 1) / 6 for p in itertools.permutations(labels)]
    assert got.null_mean == pytest.approx(np.mean(every)) and got.null_std == pytest.approx(np.std(every))
    assert got.coherence == pytest.approx((sum(w for a, b, w in edges if labels[a] == labels[b]) + 1) / 6)


def values(spark, n_a, n_b, motifs=2, seed=1):
    r = np.random.default_rng(seed)
    rows = [("d", f"m{j}", f"s{i:03d}", "control" if i < n_a else "tumor", float(r.normal(0.5 * j * (i >= n_a)))) for i in range(n_a + n_b) for j in range(motifs)]
    return spark.createDataFrame(rows, "dataset_id string, motif_id string, sample_id string, condition string, value double"), rows


def test_sixty_three_samples(spark):
    df, rows = values(spark, 31, 32)
    got = {r.motif_id: r for r in T.permutation_test(df, 300, 5).collect()}
    draws = np.random.default_rng(5)
    picked = [draws.choice(63, size=32, replace=False) for _ in range(300)]
    for m, r in got.items():
        x = np.array([v for _, k, _, _, v in rows if k == m])
        seen = x[31:].mean() - x[:31].mean()
        e = np.array([x[p].mean() - np.delete(x, p).mean() for p in picked])
        assert r.mode == "approx_monte_carlo" and r.n_permutations == 300 and r.total_labelings == str(math.comb(63, 32))
        assert r.pvalue_two_sided == pytest.approx(((np.abs(e) >= abs(seen) - 1e-12).sum() + 1) / 301)
    assert all(0 < r.pvalue_max_t <= 1 for r in T.max_t_test(df, 200, 5).collect())


def dense_loglik(y, x, groups, ratio):
    v = np.eye(len(y)) + ratio * (groups[:, None] == groups[None])
    i = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ i @ x)
    b = cov @ x.T @ i @ y
    s2 = (y - x @ b) @ i @ (y - x @ b) / len(y)
    return -0.5 * len(y) * math.log(s2) - 0.5 * np.linalg.slogdet(v)[1], b[1], math.sqrt(s2 * cov[1, 1])


def test_mixed_model_equals_the_dense_likelihood():
    n, k, case = np.array([30, 25, 40, 20, 35, 30]), np.array([3, 9, 8, 9, 20, 11]), np.array([0, 0, 0, 1, 1, 1], bool)
    y = np.concatenate([np.repeat([1.0, 0.0], [a, b - a]) for a, b in zip(k, n)])
    g = np.repeat(np.arange(6), n)
    x = np.stack((np.ones(len(y)), case[g]), 1)
    best = max((dense_loglik(y, x, g, r) for r in np.linspace(0, 0.3, 1501)), key=lambda t: t[0])
    e, p, method = X.mixed_model(n, k, case)
    assert method == "mixedlm_random_intercept"
    assert e == pytest.approx(best[1], abs=1e-4) and p == pytest.approx(math.erfc(abs(best[1] / best[2]) / math.sqrt(2)), abs=1e-3)
    assert X.mixed_model(n[:3], k[:3], case[:3])[2] == "unavailable"


def test_null_controls(spark):
    r = np.random.default_rng(3)
    rows = [(i, "d", "D", f"s{i % 6}", "tumor" if i % 6 >= 3 else "control", m, m) for i, m in enumerate(("a" if r.random() < (0.6 if i % 6 >= 3 else 0.2) else "b") for i in range(600))]
    s = spark.createDataFrame(rows, "obs_id long, dataset_id string, dataset_name string, sample_id string, condition string, motif_id string, motif_label string")
    e = spark.createDataFrame([(i, (i + 6 * k) % 600, 0.5) for i in range(600) for k in (1, 2)], "src long, dst long, weight double")
    from cohortframe.operators.abundance import sample_motif_abundance

    got = {(x.motif_id, x.statistic_name): x for x in X.null_controls(s, e, sample_motif_abundance(s), iterations=60).collect()}
    a = got["a", "abs_delta_fraction"]
    assert a.empirical_pvalue == pytest.approx(1 / 61) and a.observed_value > 0.25 > 5 * a.null_mean
    space = got["a", "self_neighbor_fraction"]
    share = sum(x[5] == "a" for x in rows) / 600
    assert abs(space.null_mean - share) < 0.03 and 0 < space.null_std < 0.1 and space.observed_value > share


def test_one_condition_has_no_separability(spark):
    df = spark.createDataFrame([(1, "s", "c", "m", [1.0, 2.0]), (2, "t", "c", "m", [1.0, 3.0])], "obs_id long, sample_id string, condition string, motif_id string, vector array<double>")
    assert R.condition_separability(df).first()["separability"] is None


def test_selections(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "gene long"), spark.createDataFrame([(2,), (3,), (4,), (4,)], "gene long")
    assert H.set_jaccard(a, b).first()[0] == 0.5
    same = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b long")
    got = H.cluster_agreement(same, "a", "b").first()
    assert (got.ari, got.nmi) == (pytest.approx(1), pytest.approx(1))


def test_skyline_of_many_partitions(spark):
    r = np.random.default_rng(0)
    x = r.random((400, 3)).round(2)
    df = spark.createDataFrame([(f"c{i}", *map(float, v)) for i, v in enumerate(x)] + [("none", None, 1.0, 1.0)], "config_id string, a double, b double, c double").repartition(7)
    want = {f"c{i}" for i, v in enumerate(x) if not ((x >= v).all(1) & (x > v).any(1)).any()}
    assert {q.config_id for q in P.skyline(df, ["a", "b", "c"]).collect()} == want


def test_an_entry_that_reads_like_the_sizes(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 5\n1 2 1\n2 2 3\n")
    (tmp_path / "g.tsv").write_text("g1\ng2\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    got = tables.read_matrix_market(spark, *(f"file://{tmp_path}/{n}" for n in ("m.mtx", "g.tsv", "b.tsv")))
    assert sorted(map(tuple, got.collect())) == [("c1", "g1", 5.0), ("c2", "g1", 1.0), ("c2", "g2", 3.0)]
