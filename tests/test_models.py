import math
from itertools import combinations

import numpy as np
import pytest

from cohortframe.functions import special
from cohortframe.operators import models, testing


def test_student_t():
    for t in (0.0, 0.5, 2.0, 9.0):
        assert math.isclose(special.t_two_sided(t, 1), 1 - 2 * math.atan(t) / math.pi, abs_tol=1e-12)
        assert math.isclose(special.t_two_sided(t, 2), 1 - t / math.sqrt(2 + t * t), abs_tol=1e-12)


def test_fisher():
    assert math.isclose(special.fisher_exact((3, 1, 1, 3)), 34 / 70)
    assert math.isclose(special.fisher_exact((3, 1, 1, 3), "greater"), 17 / 70)
    assert math.isclose(special.fisher_mid((3, 1, 1, 3)), 26 / 70)


def test_signed_rank():
    assert math.isclose(special.signed_rank([1, 2, 3, 4, 5]), 2 / 32)
    assert special.signed_rank([0, 0]) == 1.0


def table(spark, values, labels):
    return spark.createDataFrame([("d", "m", f"s{i:02d}", c, float(v)) for i, (v, c) in enumerate(zip(values, labels))], "dataset_id string, motif_id string, sample_id string, condition string, value double")


def test_golden_permutation(spark):
    r = testing.permutation_test(table(spark, [0, 0, 0, 1, 1, 1], ["a"] * 3 + ["b"] * 3)).first()
    assert (r.pvalue_two_sided, r.pvalue_one_sided, r.pvalue_midp, r.n_permutations, r.mode) == (0.1, 0.05, 0.05, 20, "exact")


def test_few_cases_of_many_samples_and_monte_carlo(spark):
    x = np.random.default_rng(1).normal(size=24)
    labels = ["b"] * 2 + ["a"] * 22
    r = testing.permutation_test(table(spark, x, labels)).first()
    effect = [x[list(c)].mean() - np.delete(x, list(c)).mean() for c in combinations(range(24), 2)]
    assert r.n_permutations == 276 and math.isclose(r.pvalue_two_sided, np.mean(np.abs(effect) >= abs(effect[0]) - 1e-12))
    mc = testing.permutation_test(table(spark, x, ["b"] * 12 + ["a"] * 12), most=500).first()
    assert mc.mode == "approx_monte_carlo" and mc.n_permutations == 500 and 0 < mc.pvalue_two_sided <= 1


def test_designs_without_two_conditions_are_left_out(spark):
    assert testing.permutation_test(table(spark, [1, 2, 3], ["a", "a", "a"])).count() == 0
    assert testing.permutation_test(table(spark, [1, 2, 3], ["a", "b", "c"])).count() == 0


def test_condition_order(spark):
    t = table(spark, [1, 2], ["responder", "non-responder"])
    assert tuple(testing.condition_order(t).first())[1:] == ("non-responder", "responder")


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("d", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "dataset_id string, motif_id string, p double")
    q = [r.q for r in testing.benjamini_hochberg(df, "p", "q", "dataset_id").orderBy("motif_id").collect()]
    assert np.allclose(q, [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_quasi_binomial_fit():
    e, p, d = models.quasi_binomial(np.array([5, 6, 7, 20, 22, 25]), np.full(6, 50), np.array([False] * 3 + [True] * 3))
    assert math.isclose(e, 67 / 150 - 18 / 150, abs_tol=1e-9) and p < 0.01 and d > 0


@pytest.mark.parametrize("name", ["ols_hc3_test", "fisher_test", "quasi_binomial_test", "bootstrap_intervals", "simulation_summary"])
def test_queries_run(spark, name):
    from cohortframe import catalogue

    rows = catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        assert all(0 <= v <= 1 for k, v in r.asDict().items() if k.startswith("pvalue") and v is not None)
