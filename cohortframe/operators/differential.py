"""The differential workflow: every statistic of a motif's change between two conditions, in one table.

``spots``: obs_id, dataset_id, dataset_name, sample_id, condition, motif_id, motif_label; ``edges``: src, dst, weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators import models as M
from cohortframe.operators import testing as T
from cohortframe.operators.abundance import sample_motif_abundance
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize

_KEY = ["dataset_id", "motif_id"]


def mixed_model(n: np.ndarray, k: np.ndarray, case: np.ndarray) -> tuple[float, float, str]:
    """Effect, p and method of presence ~ condition with a random intercept per sample, by maximum likelihood.

    A sample's spots and hits are all that the likelihood needs: with the ratio of variances fixed, it is a weighted least
    squares of the samples' means, so one number is searched.  Where that fails, least squares with errors clustered by sample.
    """
    n, k, c = n.astype(float), k.astype(float), case.astype(float)
    keep = n > 0
    n, k, c = n[keep], k[keep], c[keep]
    if not len(n) or c.min() == c.max():
        return math.nan, math.nan, "unavailable"
    total, mean = n.sum(), k / n
    inside = float((k - k * mean).sum())

    def fit(ratio: float):
        w = n / (1 + ratio * n)
        s, sc, sy, scy = w.sum(), (w * c).sum(), (w * mean).sum(), (w * c * mean).sum()
        det = s * sc - sc * sc
        b = (s * scy - sc * sy) / det
        a = (sy - b * sc) / s
        variance = (inside + float((w * (mean - a - b * c) ** 2).sum())) / total
        return b, math.sqrt(variance * s / det), -0.5 * total * math.log(max(variance, 1e-300)) - 0.5 * float(np.log1p(ratio * n).sum())

    grid = np.concatenate(([0.0], np.exp(np.linspace(math.log(1e-9), math.log(1e3), 120))))
    at = int(np.argmax([fit(r)[2] for r in grid]))
    low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
    for _ in range(80):
        one, two = low + (high - low) * 0.381966, low + (high - low) * 0.618034
        low, high = (low, two) if fit(one)[2] >= fit(two)[2] else (one, high)
    b, se, _ = fit((low + high) / 2)
    if math.isfinite(b) and math.isfinite(se) and se > 0:
        return float(b), math.erfc(abs(b) / se / math.sqrt(2)), "mixedlm_random_intercept"
    nc, g = (n * c).sum(), len(n)
    b = float((k * c).sum() / nc - (k * (1 - c)).sum() / (total - nc))
    a = float((k * (1 - c)).sum() / (total - nc))
    u = k - n * (a + b * c)
    meat = float((u[c > 0] ** 2).sum()) / nc**2 + float((u[c == 0] ** 2).sum()) / (total - nc) ** 2
    se = math.sqrt(meat * g / max(g - 1, 1) * (total - 1) / max(total - 2, 1))
    return b, (math.erfc(abs(b) / se / math.sqrt(2)) if se > 0 else math.nan), "cluster_robust_ols_fallback"


def mixed_model_test(abundance: DataFrame) -> DataFrame:
    """(dataset_id, motif_id, mixedlm_effect, mixedlm_pvalue, mixedlm_method) from each motif's sample counts."""
    ship(abundance.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        e, p, m = mixed_model(f.sample_spots.to_numpy(), f.motif_spots.to_numpy(), (f.condition == f.condition_b).to_numpy())
        return pd.DataFrame({"dataset_id": [f.dataset_id.iloc[0]], "motif_id": [f.motif_id.iloc[0]], "mixedlm_effect": [e], "mixedlm_pvalue": [p], "mixedlm_method": [m]})

    rows = abundance.join(T.condition_order(abundance), "dataset_id").select(*_KEY, "condition", "condition_b", "motif_spots", "sample_spots")
    return rows.groupBy(*_KEY).applyInPandas(run, "dataset_id string, motif_id string, mixedlm_effect double, mixedlm_pvalue double, mixedlm_method string")


def _effect_controls(abundance: DataFrame, iterations: int, seed: int) -> DataFrame:
    """How large the effect of a random motif of the same size is.

    A random set of spots falls into the samples by the multivariate hypergeometric law, so the spots themselves are not drawn.
    """
    ship(abundance.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        sizes, hits, case = f.sample_spots.to_numpy(np.int64), f.motif_spots.to_numpy(np.int64), (f.condition == f.condition_b).to_numpy()
        if not 0 < hits.sum() < sizes.sum():
            return pd.DataFrame({"dataset_id": [], "motif_id": [], "observed_value": [], "null_mean": [], "null_std": [], "empirical_pvalue": []})
        share = np.maximum(sizes, 1)

        def effect(h: np.ndarray) -> np.ndarray:
            x = h / share
            return np.abs(x[..., case].mean(-1) - x[..., ~case].mean(-1))

        null, seen = effect(np.random.default_rng(seed).multivariate_hypergeometric(sizes, hits.sum(), iterations, "marginals")), float(effect(hits))
        p = ((null >= seen - T.TOLERANCE).sum() + 1) / (iterations + 1)
        return pd.DataFrame({"dataset_id": [f.dataset_id.iloc[0]], "motif_id": [f.motif_id.iloc[0]], "observed_value": [seen], "null_mean": [null.mean()], "null_std": [null.std()], "empirical_pvalue": [p]})

    rows = abundance.join(T.condition_order(abundance), "dataset_id").select(*_KEY, "condition", "condition_b", "motif_spots", "sample_spots")
    return rows.groupBy(*_KEY).applyInPandas(run, "dataset_id string, motif_id string, observed_value double, null_mean double, null_std double, empirical_pvalue double")


def _numbers(h: np.ndarray, iterations: int) -> np.ndarray:
    """A random 64-bit number for each hash (rows) and round (columns)."""
    x = h.view(np.uint64)[:, None] + np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in (30, 27):
        x = (x ^ (x >> np.uint64(k))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _thresholds(spots: DataFrame, sizes: dict[str, dict[str, int]], iterations: int) -> dict[str, dict[str, np.ndarray]]:
    """By dataset, motif and round: the number that exactly as many spots do not exceed as the motif has.

    ``spots``: dataset_id, h.  One pass counts what lies below a range around the expected place, six deviations wide, and
    ranks the few numbers inside; a round whose number is not inside (one in 10**8) makes a wider pass.
    """
    width, found = 6.0, {}
    while width:
        ranges = {}
        for d, motifs in sizes.items():
            n = sum(motifs.values())
            for m, k in motifs.items():
                p, spread = k / n, (width * (k * (n - k) / n) ** 0.5 + 20) / n
                if k < n:
                    ranges[d, m] = (int(max(0.0, p - spread) * 2.0**63) * 2, min(int((p + spread) * 2.0**63) * 2, (1 << 64) - 1))

        def run(batches: Iterator[pa.RecordBatch], ranges=ranges) -> Iterator[pa.RecordBatch]:
            below = {k: np.zeros(iterations, np.int64) for k in ranges}
            for b in batches:
                names, h = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
                for at in range(0, len(h), 4096):
                    u, own = _numbers(h[at : at + 4096], iterations), names[at : at + 4096]
                    for (d, m), (lo, hi) in ranges.items():
                        x = u if (own == d).all() else u[own == d]
                        less = x < np.uint64(lo)
                        below[d, m] += less.sum(0)
                        row, it = np.nonzero(~less & (x <= np.uint64(hi)))
                        if len(row):
                            yield _told(d, m, it, None, x[row, it])
            for (d, m), c in below.items():
                yield _told(d, m, np.arange(iterations), c, None)

        rows = materialize(spots.select("dataset_id", "h").mapInArrow(run, "dataset_id string, motif_id string, it int, below long, x long"), "draws")
        count = rows.where("below is not null").groupBy(*_KEY, "it").agg(F.sum("below").alias("below"))
        # numbers are unsigned: their order is that of the values with the highest bit turned over
        place = F.row_number().over(W.partitionBy(*_KEY, "it").orderBy(F.col("x").bitwiseXOR(F.lit(-(1 << 63)))))
        want = spots.sparkSession.createDataFrame([(d, m, k) for d, motifs in sizes.items() for m, k in motifs.items() if (d, m) in ranges], "dataset_id string, motif_id string, k long")
        ranked = rows.where("x is not null").drop("below").withColumn("place", place).join(count, [*_KEY, "it"]).join(F.broadcast(want), _KEY)
        found = {}
        for r in ranked.where("below + place = k").select(*_KEY, "it", "x").collect():
            found.setdefault(r["dataset_id"], {}).setdefault(r["motif_id"], np.zeros(iterations, np.uint64))[r["it"]] = np.int64(r["x"]).view(np.uint64)
        drop(rows)
        complete = all((found.get(d, {}).get(m, np.zeros(1)) > 0).all() for d, m in ranges)
        width = 0.0 if complete or width > 1e6 else width * 1e3
    return found


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _told(d: str, m: str, it: np.ndarray, below: np.ndarray | None, x: np.ndarray | None) -> pa.RecordBatch:
    n = len(it)
    whole = [pa.nulls(n, pa.int64()) if v is None else pa.array(v.view(np.int64)) for v in (below, x)]
    return pa.RecordBatch.from_arrays([pa.array([d] * n, pa.string()), pa.array([m] * n, pa.string()), pa.array(it.astype(np.int32)), *whole], ["dataset_id", "motif_id", "it", "below", "x"])


def _spatial_controls(spots: DataFrame, edges: DataFrame, iterations: int, seed: int) -> DataFrame:
    """How much a motif's spots neighbour one another, beside random sets of exactly its size.

    In each round a spot has one random number, from a hash, and the random set of a motif holds the spots with the smallest ones, as
    many as the motif has.  So all motifs and rounds are drawn in one pass over spots and one over edges, and only sums are kept: motifs times
    rounds of them.  A set without inner edges counts as zero.  Edges that carry dataset_id, motif_id and to_motif_id
    (:func:`knn_weighted`) are joined with nothing.
    """
    ship(spots.sparkSession)
    named = spots.select("obs_id", F.col("dataset_id").cast("string").alias("dataset_id"), F.col("motif_id").cast("string").alias("motif_id"), F.xxhash64("obs_id", F.lit(seed)).alias("h"))
    sizes: dict[str, dict[str, int]] = {}
    for r in named.groupBy(*_KEY).agg(F.count("*").alias("m")).collect():
        sizes.setdefault(r["dataset_id"], {})[r["motif_id"]] = r["m"]
    tops = _thresholds(named, sizes, iterations)
    carried = {"dataset_id", "motif_id", "to_motif_id"} <= set(edges.columns)
    e = edges if carried else edges.select("src", "dst", "weight").join(named.select(F.col("obs_id").alias("src"), "dataset_id", F.col("motif_id").alias("m1"), F.col("h").alias("h1")), "src")
    if carried:
        kind = spots.schema["obs_id"].dataType
        m1, m2 = (F.col(c).cast("string").alias(m) for c, m in (("motif_id", "m1"), ("to_motif_id", "m2")))
        h1, h2 = (F.xxhash64(F.col(c).cast(kind), F.lit(seed)).alias(h) for c, h in (("src", "h1"), ("dst", "h2")))
        e = e.select(F.col("dataset_id").cast("string").alias("dataset_id"), h1, h2, "weight", m1, m2)
    else:
        e = e.join(named.select(F.col("obs_id").alias("dst"), F.col("motif_id").alias("m2"), F.col("h").alias("h2")), "dst").select("dataset_id", "h1", "h2", "weight", "m1", "m2")
    e = materialize(e, "edges")
    seen = e.groupBy("dataset_id", F.col("m1").alias("motif_id")).agg(F.sum(F.when(F.col("m1") == F.col("m2"), F.col("weight")).otherwise(0.0)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(d, m): np.zeros(iterations) for d, motifs in tops.items() for m in motifs}
        for b in batches:
            coded, (h1, h2, weight) = b.column(0).dictionary_encode(), (b.column(c).to_numpy() for c in (1, 2, 3))
            known = coded.dictionary.to_pylist()
            for at in range(0, len(h1), 4096):
                cut = slice(at, at + 4096)
                # edges of one spot stand together, so its numbers are drawn once
                starts = _runs(h1[cut])
                u = np.repeat(_numbers(h1[cut][starts], iterations), np.diff(np.append(starts, len(h1[cut]))), axis=0)
                u, w, code = np.maximum(u, _numbers(h2[cut], iterations)), weight[cut], coded.indices.to_numpy()[cut]
                for i, d in enumerate(known):
                    on = slice(None) if len(known) == 1 else code == i
                    x, weights = u[on], w[on]
                    for m, top in tops.get(d, {}).items():
                        sums[d, m] += weights @ (x <= top)
        for (d, m), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * iterations), pa.array([m] * iterations), pa.array(np.arange(iterations, dtype=np.int32)), pa.array(x)], ["dataset_id", "motif_id", "it", "w"])

    null = e.select("dataset_id", "h1", "h2", F.col("weight").cast("double")).mapInArrow(run, "dataset_id string, motif_id string, it int, w double").groupBy(*_KEY, "it").agg(F.sum("w").alias("w"))
    size = spots.sparkSession.createDataFrame([(d, m, k) for d, motifs in sizes.items() for m, k in motifs.items() if m in tops.get(d, {})], "dataset_id string, motif_id string, m long")
    rounds = size.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).join(null, [*_KEY, "it"], "left")
    both = rounds.join(seen, _KEY, "left").select(*_KEY, (F.coalesce(seen["w"], F.lit(0.0)) / F.col("m")).alias("observed_value"), (F.coalesce(null["w"], F.lit(0.0)) / F.col("m")).alias("v"))
    hits = F.sum(F.when(F.col("v") >= F.col("observed_value") - T.TOLERANCE, 1).otherwise(0))
    return both.groupBy(*_KEY, "observed_value").agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_std"), ((hits + 1) / (iterations + 1.0)).alias("empirical_pvalue"))


def null_controls(spots: DataFrame, edges: DataFrame, abundance: DataFrame, scope: str = "full", iterations: int = 200, seed: int = 7) -> DataFrame:
    """Per motif and statistic (abs_delta_fraction, self_neighbor_fraction): the value, and its place among random motifs of the same size.

    Motifs without spots or with all spots have no control.  p counts the observation as one of the draws.
    """
    names = abundance.groupBy("dataset_id", "dataset_name", "motif_id").agg(F.min("motif_label").alias("motif_label"))
    parts = [("abs_delta_fraction", _effect_controls(abundance, iterations, seed)), ("self_neighbor_fraction", _spatial_controls(spots, edges, iterations, seed))]
    rows = None
    for name, p in parts:
        p = p.withColumn("statistic_name", F.lit(name))
        rows = p if rows is None else rows.unionByName(p)
    out = rows.join(names, _KEY).withColumns({"analysis_scope": F.lit(scope), "control_name": F.lit("size_matched_random_motif"), "n_iterations": F.lit(iterations)})
    return out.select("dataset_id", "dataset_name", "analysis_scope", "motif_id", "motif_label", "control_name", "statistic_name", "observed_value", "null_mean", "null_std", "empirical_pvalue", "n_iterations")


def control_rows(summary: DataFrame, scope: str) -> DataFrame:
    """The max-T p values of a result table in the columns of :func:`null_controls`."""
    none = F.lit(None).cast("double")
    return summary.select(
        "dataset_id", "dataset_name", F.lit(scope).alias("analysis_scope"), "motif_id", "motif_label", F.lit("condition_label_max_t").alias("control_name"), F.lit("abs_delta_fraction").alias("statistic_name"),
        F.abs("delta_fraction").alias("observed_value"), none.alias("null_mean"), none.alias("null_std"), F.col("label_max_t_pvalue").alias("empirical_pvalue"), F.lit(None).cast("int").alias("n_iterations"),
    )


def naive_fisher(abundance: DataFrame) -> DataFrame:
    """(dataset_id, motif_id, naive_spot_pvalue, naive_spot_odds_ratio, naive_spot_fraction_a, naive_spot_fraction_b)."""
    f = M.fisher_test(abundance)
    return f.select(*_KEY, F.col("pvalue").alias("naive_spot_pvalue"), F.col("odds_ratio").alias("naive_spot_odds_ratio"), F.col("ref_fraction").alias("naive_spot_fraction_a"), F.col("case_fraction").alias("naive_spot_fraction_b"))


def sample_statistics(abundance: DataFrame, permutations: int = 8192, max_t: int = 4096, seed: int = 7) -> DataFrame:
    """Per motif of a two-condition dataset: means, effect, permutation, max-T and leave-one-out figures, all from sample-level rows."""
    v = abundance.withColumn("value", F.col("motif_fraction"))
    names = abundance.groupBy("dataset_id", "dataset_name", "motif_id").agg(F.min("motif_label").alias("motif_label"))
    e = T.condition_effects(v).where("n_a > 0 and n_b > 0")
    base = e.join(names, _KEY).select(
        "dataset_id", "dataset_name", F.concat_ws("_vs_", "condition_b", "condition_a").alias("comparison_name"), "condition_a", "condition_b", "motif_id", "motif_label", F.col("n_a").alias("n_samples_a"), F.col("n_b").alias("n_samples_b"),
        F.col("mean_a").alias("mean_fraction_a"), F.col("mean_b").alias("mean_fraction_b"), F.col("effect").alias("delta_fraction"), "log2_fold_change",
    )
    p = T.permutation_test(v, permutations, seed).select(
        *_KEY, F.col("pvalue_two_sided").alias("sample_permutation_pvalue_two_sided"), F.col("pvalue_one_sided").alias("sample_permutation_pvalue_one_sided"), F.col("mode").alias("sample_permutation_mode"),
        F.col("n_permutations").alias("sample_permutation_n_permutations"), F.col("total_labelings").alias("sample_permutation_total_labelings"),
    )
    m = T.max_t_test(v, max_t, seed).select(*_KEY, F.col("pvalue_max_t").alias("label_max_t_pvalue"), F.col("mode").alias("label_max_t_mode"), F.col("n_permutations").alias("label_max_t_n_permutations"), F.col("total_labelings").alias("label_max_t_total_labelings"))
    o = T.leave_one_out(v).select(*_KEY, "loso_sign_consistency", F.col("loso_effect_median").alias("loso_delta_median"), F.col("loso_effect_std").alias("loso_delta_std"), "loso_max_abs_shift")
    return base.join(p, _KEY, "left").join(m, _KEY, "left").join(o, _KEY, "left")


def differential_statistics(spots: DataFrame, edges: DataFrame, scope: str = "full", null_iterations: int = 200, bootstrap_iterations: int = 2000, permutations: int = 8192, max_t: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The result table, one row per motif, and the null controls.

    All parts but the spatial control work on sample-level counts, one small aggregation of the spots.
    """
    abundance = materialize(sample_motif_abundance(spots), "abundance")
    controls = materialize(null_controls(spots, edges, abundance, scope, null_iterations, seed), "controls")
    out = sample_statistics(abundance, permutations, max_t, seed)
    out = out.join(M.bootstrap_test(abundance.withColumn("value", F.col("motif_fraction")), bootstrap_iterations, seed).select(*_KEY, F.col("ci_low").alias("bootstrap_ci_low"), F.col("ci_high").alias("bootstrap_ci_high")), _KEY, "left")
    out = out.join(mixed_model_test(abundance), _KEY, "left").join(naive_fisher(abundance), _KEY, "left")
    for name, short in (("abs_delta_fraction", "effect"), ("self_neighbor_fraction", "spatial")):
        c = controls.where(F.col("statistic_name") == name)
        out = out.join(c.select(*_KEY, F.col("empirical_pvalue").alias(f"synthetic_null_{short}_pvalue"), F.col("null_mean").alias(f"synthetic_null_{short}_mean"), F.col("null_std").alias(f"synthetic_null_{short}_std")), _KEY, "left")
    return with_tier(out), controls


def with_tier(table: DataFrame) -> DataFrame:
    """The support tier, and by how many decades the naive p is smaller than the controlled one."""
    tier = T.support_tier(*[F.col(c) for c in ("sample_permutation_pvalue_two_sided", "label_max_t_pvalue", "synthetic_null_effect_pvalue", "loso_sign_consistency", "naive_spot_pvalue")])

    def decades(c: str):
        p = F.when(~F.isnan(c), F.col(c))
        return F.log10(F.greatest(F.least(F.coalesce(p, F.lit(1.0)), F.lit(1.0)), F.lit(1e-12)))

    return table.withColumn("controlled_support_tier", tier).withColumn("naive_minus_controlled_log10p", decades("sample_permutation_pvalue_two_sided") - decades("naive_spot_pvalue"))


def motif_analysis(spots: DataFrame, abundance: DataFrame | None = None, bootstrap_iterations: int = 2000, permutations: int = 1 << 20, seed: int = 7) -> DataFrame:
    """The smaller workflow: effects, exact permutation, bootstrap interval, mixed model, q values, evidence tier and call per motif."""
    abundance = materialize(sample_motif_abundance(spots) if abundance is None else abundance, "abundance")
    v = abundance.withColumn("value", F.col("motif_fraction"))
    e = T.condition_effects(v).where("n_a > 0 and n_b > 0")
    names = abundance.groupBy("dataset_id", "dataset_name", "motif_id").agg(F.min("motif_label").alias("motif_label"))
    out = e.join(names, _KEY).select(
        "dataset_id", "dataset_name", F.concat_ws("_vs_", "condition_b", "condition_a").alias("comparison_name"), "condition_a", "condition_b", "motif_id", "motif_label", F.col("n_a").alias("n_samples_a"), F.col("n_b").alias("n_samples_b"),
        F.col("mean_a").alias("mean_fraction_a"), F.col("mean_b").alias("mean_fraction_b"), F.col("effect").alias("delta_fraction"), "log2_fold_change",
    )
    out = out.join(T.permutation_test(v, permutations, seed).select(*_KEY, F.col("pvalue_two_sided").alias("permutation_pvalue")), _KEY, "left")
    out = out.join(M.bootstrap_test(v, bootstrap_iterations, seed).select(*_KEY, F.col("ci_low").alias("bootstrap_ci_low"), F.col("ci_high").alias("bootstrap_ci_high")), _KEY, "left")
    out = materialize(out.join(mixed_model_test(abundance), _KEY, "left"), "motifs")
    out = T.benjamini_hochberg(out, "mixedlm_pvalue", "q_value", "dataset_id")
    tier = T.evidence_tier(*[F.col(c) for c in ("mixedlm_pvalue", "permutation_pvalue", "q_value", "bootstrap_ci_low", "bootstrap_ci_high")])
    return out.withColumn("evidence_tier", tier).withColumn("association_call", F.col("evidence_tier").isin("strong", "moderate"))
