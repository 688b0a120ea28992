"""Labels, rank scores and comparisons of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators.pareto import label_jaccard


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def decision_label(tier: Column, naive_p: Column, threshold: float = 0.05) -> Column:
    """robust_biological_signal, naive_only_signal or no_signal; a p that is no finite number is no signal."""
    return F.when(tier.isin("heldout_supported", "sample_level_supported"), "robust_biological_signal").when(_finite(naive_p) & (naive_p <= threshold), "naive_only_signal").otherwise("no_signal")


def neg_log10(p: Column, floor: float = 1e-12) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def sign_match(left: Column, right: Column, tolerance: float = 1e-8) -> Column:
    """Does ``left`` agree in sign with ``right``, as 1.0 or 0.0? Where ``right`` is about zero, ``left`` must be too; null if either is not finite."""
    same = F.when(F.abs(right) <= tolerance, F.abs(left) <= tolerance).otherwise(F.signum(left) == F.signum(right))
    return F.when(_finite(left) & _finite(right), same.cast("double"))


def sign_match_strict(left: Column, right: Column, tolerance: float = 1e-8) -> Column:
    """The symmetric rule of the decision tables: both about zero agree, one alone does not, nor does what is not finite."""
    x, y = F.abs(left) <= tolerance, F.abs(right) <= tolerance
    return F.when(~(_finite(left) & _finite(right)), False).when(x & y, True).when(x | y, False).otherwise(F.signum(left) == F.signum(right))


def pearson(a: str, b: str) -> Column:
    """Correlation over pairs of finite numbers; null for fewer than two or without spread."""
    ok = _finite(F.col(a)) & _finite(F.col(b))
    x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
    spread = F.sqrt(F.var_pop(x) * F.count(x)) * F.sqrt(F.var_pop(y) * F.count(y))
    return F.when((F.count(x) > 1) & (spread > 1e-12), F.covar_pop(x, y) * F.count(x) / spread)


def qc_summary(spots: DataFrame, label: str = "cell_type", counts: str = "n_counts") -> DataFrame:
    """Per sample: spots, median counts, labels and the conditions, sorted and joined."""
    return spots.groupBy("sample_id").agg(
        F.count("*").alias("n_spots"), F.percentile(counts, 0.5).alias("median_counts"), F.count_distinct(label).alias("n_labels"), F.array_join(F.sort_array(F.collect_set("condition")), ",").alias("conditions")
    )


def fraction_pivot(abundance: DataFrame, motifs: list[str]) -> DataFrame:
    """Samples by motifs, zero where there is none."""
    return abundance.groupBy("sample_id").pivot("motif_id", motifs).agg(F.avg("motif_fraction")).fillna(0.0)


def marker_genes(counts: DataFrame, groups: DataFrame, group: str, least: float = 0.0) -> DataFrame:
    """Per gene: mean and detected share inside and outside a group of observations, and log2 ratio; zeros count.

    ``counts``: obs, gene, value; ``groups``: obs, group.
    """
    sizes = groups.agg(F.count(F.when(F.col("group") == group, 1)).alias("n_in"), F.count("*").alias("n"))
    inside = F.col("group") == group
    g = counts.join(groups, "obs").groupBy("gene").agg(F.sum(F.when(inside, F.col("value")).otherwise(0.0)).alias("s_in"), F.sum("value").alias("s"), F.count(F.when(inside & (F.col("value") > 0), 1)).alias("k_in"), F.count(F.when(F.col("value") > 0, 1)).alias("k"))
    g = g.crossJoin(F.broadcast(sizes))
    out = F.when(F.col("n") > F.col("n_in"), F.col("n") - F.col("n_in"))
    g = g.select("gene", (F.col("s_in") / F.when(F.col("n_in") > 0, F.col("n_in"))).alias("mean_in"), ((F.col("s") - F.col("s_in")) / out).alias("mean_out"), (F.col("k_in") / F.when(F.col("n_in") > 0, F.col("n_in"))).alias("detected_in"), ((F.col("k") - F.col("k_in")) / out).alias("detected_out"))
    return g.withColumn("log2_fold_change", F.log2((F.col("mean_in") + 1e-4) / (F.col("mean_out") + 1e-4))).where(F.col("detected_in") >= least)


def alignment_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every motif of ``a`` with every motif of ``b``: correlation of sample fractions, similarity of labels, and the score of both.

    Both: sample_id, motif_id, motif_label, motif_fraction.  Samples that only one has are left out, and a motif without a row in a
    sample has fraction zero there.  score = 0.8 * max(correlation, 0) + 0.2 * label similarity; null without a correlation.
    """
    both = a.select("sample_id").distinct().join(b.select("sample_id").distinct(), "sample_id")

    def dense(f: DataFrame, k: str) -> DataFrame:
        motifs = f.groupBy(F.col("motif_id").alias(f"motif_{k}")).agg(F.min("motif_label").alias(f"label_{k}"))
        own = f.groupBy("sample_id", F.col("motif_id").alias(f"motif_{k}")).agg(F.avg("motif_fraction").alias(f"f{k}"))
        return both.join(F.broadcast(motifs)).join(own, ["sample_id", f"motif_{k}"], "left").fillna(0.0, [f"f{k}"])

    pairs = dense(a, "a").join(dense(b, "b"), "sample_id").groupBy("motif_a", "label_a", "motif_b", "label_b").agg(pearson("fa", "fb").alias("correlation"), F.count("*").alias("n_samples"))
    pairs = pairs.withColumn("label_jaccard", label_jaccard(F.col("label_a"), F.col("label_b")))
    return pairs.withColumn("alignment_score", F.when(F.col("correlation").isNotNull(), 0.8 * F.greatest("correlation", F.lit(0.0)) + 0.2 * F.col("label_jaccard")))


def align_motifs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The best row of :func:`alignment_scores` for each motif of ``a``: by score, correlation, label similarity, then the smallest id."""
    best = W.partitionBy("motif_a").orderBy(F.desc_nulls_last("alignment_score"), F.desc_nulls_last("correlation"), F.desc("label_jaccard"), "motif_b")
    return alignment_scores(a, b).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


# --- scopes: the same statistics from two assignments of motifs ------------------------------------

SCOPE_KEYS = ["dataset_id", "dataset_name", "comparison_name", "condition_a", "condition_b", "motif_id", "motif_label"]


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Every column but the keys with ``prefix`` before its name."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def rank_score(prefix: str = "loso_") -> Column:
    """How strong a finding is, small first: its tier, three p values, sign consistency and effect size."""

    def or_else(name: str, x: float) -> Column:
        c = F.col(prefix + name)
        return F.coalesce(F.when(~F.isnan(c), c), F.lit(x))

    t = F.col(f"{prefix}controlled_support_tier")
    tier = F.when(t == "heldout_supported", 0.0).when(t == "sample_level_supported", 1.0).when(t == "not_supported", 2.0).when(t == "naive_only", 3.0).otherwise(4.0)
    p = or_else("sample_permutation_pvalue_two_sided", 1.0) + or_else("label_max_t_pvalue", 1.0) + or_else("synthetic_null_effect_pvalue", 1.0)
    return tier + p + (1.0 - or_else("loso_sign_consistency", 0.0)) - F.abs(or_else("delta_fraction", 0.0))


def merge_scopes(full: DataFrame, loso: DataFrame) -> DataFrame:
    """Both scopes' statistics side by side, outer-joined on the seven keys, with the rank score of the second."""
    out = prefixed(full, "full_", SCOPE_KEYS).join(prefixed(loso, "loso_", SCOPE_KEYS), SCOPE_KEYS, "full_outer")
    return out.withColumn("primary_rank_score", rank_score())


#: The columns of a decision matrix and where they come from.
_DECISION = {
    "delta_fraction": "delta_fraction", "sample_permutation_pvalue_two_sided": "sample_p_two_sided", "sample_permutation_pvalue_one_sided": "sample_p_one_sided", "label_max_t_pvalue": "max_t_p", "naive_spot_pvalue": "naive_spot_p",
    "loso_sign_consistency": "loso_sign_consistency", "synthetic_null_effect_pvalue": "synthetic_null_effect_p", "naive_minus_controlled_log10p": "naive_minus_controlled_log10p", "controlled_support_tier": "controlled_support_tier",
}


def decision_matrix(merged: DataFrame, prefix: str = "loso_") -> DataFrame:
    """One row per motif: the figures of a scope, its tier, the decision and the rank score."""
    label = decision_label(F.col(f"{prefix}controlled_support_tier"), F.col(f"{prefix}naive_spot_pvalue"))
    named = [F.col(prefix + c).alias(prefix + n if n == "delta_fraction" else n) for c, n in _DECISION.items()]
    return merged.select("dataset_id", "dataset_name", "comparison_name", "motif_id", "motif_label", *named, label.alias("decision_label"), "primary_rank_score")


def scope_consistency(full: DataFrame, loso: DataFrame, merged: DataFrame) -> DataFrame:
    """Per motif: how far sample fractions and findings of two scopes agree.

    ``full``, ``loso``: dataset_id, sample_id, motif_id, motif_fraction; what one lacks counts as zero.
    """
    key = ["dataset_id", "sample_id", "motif_id"]
    f = full.select(*key, F.col("motif_fraction").alias("f")).join(loso.select(*key, F.col("motif_fraction").alias("l")), key, "full_outer").fillna(0.0, ["f", "l"])
    shift = F.abs(F.col("f") - F.col("l"))
    agree = ((F.col("f") > 0) == (F.col("l") > 0)).cast("double")
    f = f.groupBy("dataset_id", "motif_id").agg(pearson("f", "l").alias("motif_abundance_correlation"), F.avg(shift).alias("mean_abs_fraction_shift"), F.max(shift).alias("max_abs_fraction_shift"), F.avg(agree).alias("sample_presence_agreement"))
    p = [F.col(f"{s}_sample_permutation_pvalue_two_sided") for s in ("full", "loso")]
    m = merged.select(
        "dataset_id", "motif_id", "full_delta_fraction", "loso_delta_fraction", sign_match_strict(F.col("full_delta_fraction"), F.col("loso_delta_fraction")).alias("effect_direction_consistent"),
        F.abs(F.col("loso_delta_fraction") - F.col("full_delta_fraction")).alias("abs_delta_shift"), p[0].alias("full_sample_p_two_sided"), p[1].alias("loso_sample_p_two_sided"), (neg_log10(p[1]) - neg_log10(p[0])).alias("pvalue_shift_log10"),
        "full_controlled_support_tier", "loso_controlled_support_tier",
    )
    return m.join(f, ["dataset_id", "motif_id"])


def decision_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per dataset of either decision matrix: naive-only, robust and no-signal motifs in both, and the change of naive-only ones."""

    def counts(df: DataFrame, k: str) -> DataFrame:
        return df.groupBy("dataset_id").agg(*[F.count(F.when(F.col("decision_label") == v, 1)).alias(f"{k}_{n}_count") for n, v in (("naive_only", "naive_only_signal"), ("robust", "robust_biological_signal"), ("no_signal", "no_signal"))])

    out = counts(first, "first").join(counts(second, "second"), "dataset_id", "full_outer").fillna(0)
    return out.withColumn("naive_only_count_delta", F.col("second_naive_only_count") - F.col("first_naive_only_count"))
