"""Random sets of exactly a motif's size, against values worked out by hand and against enumeration."""

from itertools import combinations

import numpy as np
import pytest

from cohortframe.operators import abundance, differential

SPOT = "obs_id long, dataset_id string, dataset_name string, sample_id string, condition string, motif_id string, motif_label string"


def ring(spark, n, members, dataset="d"):
    rows = [(i, dataset, dataset, f"s{i % 4}", "a" if i % 4 < 2 else "b", "m" if i in members else "rest", "x") for i in range(n)]
    edges = [(i, (i + k) % n, 0.5) for i in range(n) for k in (1, -1)]
    return spark.createDataFrame(rows, SPOT), spark.createDataFrame(edges, "src long, dst long, weight double")


def spatial(spark, n, members, iterations):
    spots, edges = ring(spark, n, members)
    rows = differential.null_controls(spots, edges, abundance.sample_motif_abundance(spots), iterations=iterations).where("statistic_name = 'self_neighbor_fraction'").collect()
    return {r["motif_id"]: r for r in rows}


def test_lone_spot_is_nothing_rare(spark):
    """One spot has no neighbour of its kind, and neither has any random spot: every draw is as large."""
    got = spatial(spark, 200, {17}, 200)["m"]
    assert (got["observed_value"], got["null_mean"], got["null_std"], got["empirical_pvalue"]) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("members", [{3}, {3, 4}, {3, 9}, {0, 1, 2}, {0, 5, 9}])
def test_equals_enumeration(spark, members):
    n, iterations = 12, 4000
    every = [np.mean([((i + 1) % n in s) + ((i - 1) % n in s) for i in s]) / 2 for s in combinations(range(n), len(members))]
    seen = np.mean([((i + 1) % n in members) + ((i - 1) % n in members) for i in members]) / 2
    got = spatial(spark, n, members, iterations)["m"]
    assert np.isclose(got["observed_value"], seen)
    assert abs(got["null_mean"] - np.mean(every)) < 5 * np.std(every) / iterations**0.5 + 1e-9
    p = np.mean(np.array(every) >= seen - 1e-12)
    assert abs(got["empirical_pvalue"] - p) < 5 * (p * (1 - p) / iterations) ** 0.5 + 2 / iterations


def test_sets_have_the_exact_size(spark):
    """Two datasets side by side, sizes from one spot to nearly all."""
    r = np.random.default_rng(0)
    h = {d: r.integers(-(1 << 63), 1 << 63, 5000) for d in ("p", "q")}
    sizes = {"p": {"one": 1, "some": 700, "most": 4299}, "q": {"half": 2500, "rest": 2500}}
    df = spark.createDataFrame([(d, int(x)) for d in h for x in h[d]], "dataset_id string, h long").repartition(3)
    tops = differential._thresholds(df, sizes, 30)
    for d, motifs in sizes.items():
        u = differential._numbers(h[d], 30)
        for m, k in motifs.items():
            assert ((u <= tops[d][m]).sum(0) == k).all()


def test_edges_that_carry_motifs_give_the_same_controls(spark):
    """Two datasets; spots have nothing to be joined by when edges carry their ends' motifs."""
    (s1, e1), (s2, e2) = ring(spark, 40, {1, 2, 3, 9}), ring(spark, 30, {4, 5, 20}, "other")
    spots, edges = s1.unionByName(s2.withColumn("obs_id", s2.obs_id + 100)), e1.unionByName(e2.select(e2.src + 100, e2.dst + 100, "weight").toDF("src", "dst", "weight"))
    ends = lambda c, m: spots.selectExpr(f"obs_id as {c}", f"motif_id as {m}", *(["dataset_id"] if c == "src" else []))
    carried = edges.join(ends("src", "motif_id"), "src").join(ends("dst", "to_motif_id"), "dst")
    counts = abundance.sample_motif_abundance(spots)
    rows = lambda e: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in differential.null_controls(spots, e, counts, iterations=30).collect())
    want = rows(edges)
    assert rows(carried) == want and len(want) == 8
    # what edges carry is what counts
    changed = differential.null_controls(spots, carried.replace("rest", "m", "to_motif_id"), counts, iterations=30).where("motif_id = 'm' and dataset_id = 'd' and statistic_name = 'self_neighbor_fraction'").first()
    assert changed["observed_value"] == 1.0
