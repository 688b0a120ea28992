import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import programs as G
from cohortframe.operators import reports as Q


def test_programs_equal_the_singular_vectors(spark):
    r = np.random.default_rng(4)
    x = r.poisson(2.0, (40, 12)).astype(float) * (r.random((40, 12)) < 0.6)
    x[:, 3] += np.repeat([5.0, 0.0], 20)
    df = spark.createDataFrame([(i, f"g{j:02d}", float(x[i, j])) for i in range(40) for j in range(12) if x[i, j]], "obs int, gene string, value double")
    scores, meta = G.expression_programs(df, 40, 3, 9, 2)
    var = x.var(0)
    keep = sorted(sorted(range(12), key=lambda j: (-var[j], j))[:9])
    _, s, v = np.linalg.svd(x[:, keep], full_matrices=False)
    v = v[:3] * np.sign(v[:3][np.arange(3), np.abs(v[:3]).argmax(1)])[:, None]
    got = np.zeros((40, 3))
    for q in scores.collect():
        got[q.obs, int(q.component[-1])] = q.score
    assert np.allclose(got, x[:, keep] @ v.T, atol=1e-8)
    rows = sorted(meta.collect())
    assert [q.explained_variance_ratio for q in rows] == pytest.approx((x[:, keep] @ v.T).var(0) / x[:, keep].var(0).sum())
    assert rows[0].top_genes == ";".join(f"g{keep[j]:02d}" for j in np.argsort(-np.abs(v[0]))[:2])


def test_names_and_fallbacks(spark):
    df = spark.createDataFrame([("3x4", 0.5, "a"), (" 31 X 32 ", -1.25, "b"), ("odd", math.inf, None)], "d string, v double, k string")
    got = df.select(Q.sample_sizes(F.col("d")).alias("s"), Q.float_slug(F.col("v")).alias("f"), Q.zero_unless_finite(F.col("v")).alias("z"), Q.mapped(F.col("k"), {"a": 1, "b": 2}, 9).alias("m")).collect()
    assert [(r.s.n_case, r.s.n_control) for r in got] == [(3, 4), (31, 32), (None, None)]
    assert [r.f for r in got[:2]] == ["0p50", "m1p25"] and [r.z for r in got] == [0.5, -1.25, 0.0] and [r.m for r in got] == [1, 2, 9]


def test_buckets(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(G.overlap_bucket(left=F.col("a"), right=F.col("b"))).collect()] == ["left", "left+right", ""]


def test_gene_sets(spark):
    assert {r.pathway for r in G.gene_sets(spark, "x_gse220442").collect()} >= {"upper_layer_neuron", "hypoxia_stress"}
    genes = spark.createDataFrame([("ca9",), ("Vegfa",), ("LDHA",), ("zzz",)], "gene string")
    universe = spark.createDataFrame([(f"G{i}",) for i in range(90)] + [("CA9",), ("VEGFA",), ("LDHA",), ("CD3D",)], "gene string")
    got = G.enrichment(genes, universe, G.gene_sets(spark, "x")).collect()
    assert [(r.pathway, r.overlap_genes, r.n_overlap, r.odds_ratio) for r in got] == [("hypoxia_stress", "CA9,LDHA,VEGFA", 3, None)] and got[0].pvalue < 1e-3


def test_methods_in_one_table(spark):
    r = np.random.default_rng(0)
    rows = [("d", "D", f"s{i}", "control" if i < 4 else "tumor", m, m, 50, int(r.binomial(50, 0.2 + 0.3 * (i >= 4) * (m == "a")))) for i in range(8) for m in "ab"]
    df = spark.createDataFrame(rows, "dataset_id string, dataset_name string, sample_id string, condition string, motif_id string, motif_label string, sample_spots long, motif_spots long").withColumn("motif_fraction", F.col("motif_spots") / F.col("sample_spots"))
    got = Q.evaluate_methods(df).collect()
    assert {(q.method, q.motif_id) for q in got} == {(m, k) for m in Q.METHODS for k in "ab"}
    assert all(0 <= q.pvalue <= q.qvalue <= 1 for q in got)
    assert all(q.raw_call for q in got if q.motif_id == "a" and q.method != "quasi_binomial")
    wide = Q.method_comparison(spark.createDataFrame([("s", "x", 0.2, 0.5), ("s", "y", 0.1, 0.4)], "scenario_id string, method string, fdr double, power double"), ["fdr", "power"], ["x", "y"], "x", "y").first()
    assert wide.x_minus_y_fdr == pytest.approx(0.1) and wide.y_power == 0.4
