"""Comparisons of methods and runs as tables: trade-offs, leads, deltas, edits of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators import models as M
from cohortframe.operators import testing as T

#: The methods of :func:`evaluate_methods` in their order.
METHODS = ("naive_fisher", "sample_permutation", "ols_hc3", "quasi_binomial", "sample_permutation_midp")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def zero_unless_finite(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(0.0)


def mapped(c: Column, values: dict, fallback) -> Column:
    """A dictionary's value for a column's, or ``fallback``."""
    out = F.lit(fallback)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def weighted_mean(value: str, weight: str) -> Column:
    """The mean over finite values of positive finite weight; null without any."""
    ok = finite(F.col(value)) & finite(F.col(weight)) & (F.col(weight) > 0)
    return F.sum(F.when(ok, F.col(value) * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))


def first_filled(value: str, order: str) -> Column:
    """The first value in ``order`` that is neither null nor blank."""
    return F.min_by(value, F.when(F.length(F.trim(F.col(value).cast("string"))) > 0, F.col(order)))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last in ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def label_counts(df: DataFrame, group: str, label: str, labels: list[str]) -> DataFrame:
    """Groups by labels: how many rows, zero where there is none."""
    return df.groupBy(group).agg(*[F.count(F.when(F.col(label) == x, 1)).alias(x) for x in labels])


def spaced_rank(value: str, tie: str) -> Column:
    """0 to 1 in equal steps in order of the value, ties by ``tie``; 0 for a single row."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    return (F.row_number().over(W.orderBy(value, tie)) - 1) / F.greatest(n - 1, F.lit(1))


def runtime_tradeoff(summary: DataFrame, tie: float = 1e-4, method: str = "method", score: str = "overall_score", runtime: str = "runtime") -> DataFrame:
    """Per method: the gap to the best score, runtime over the fastest, score per second, and whether none is better in both."""
    ends = F.broadcast(summary.agg(F.max(score).alias("_best"), F.min(runtime).alias("_fast")))
    o = summary.select(F.col(method).alias("_m"), F.col(score).alias("_s"), F.col(runtime).alias("_t"))
    s, t = F.col(score), F.col(runtime)
    beats = (F.col("_m") != F.col(method)) & (F.col("_s") >= s - tie) & (F.col("_t") <= t + tie) & ((F.col("_s") > s + tie) | (F.col("_t") < t - tie))
    lost = summary.join(F.broadcast(o), beats, "left_semi").select(F.col(method).alias("_m"), F.lit(True).alias("_lost"))
    out = summary.join(lost, F.col(method) == F.col("_m"), "left").crossJoin(ends)
    return out.withColumns({"score_gap_to_best": F.col("_best") - s, "runtime_ratio_to_fastest": t / F.greatest("_fast", F.lit(1e-8)), "score_per_second": s / F.greatest(t, F.lit(1e-8)), "pareto_optimal": F.col("_lost").isNull()}).drop("_m", "_lost", "_best", "_fast")


def pairwise_row(pairs: DataFrame, of: str) -> DataFrame:
    """(method, wins, ties, losses, mean_difference) of ``of`` against every other method, from either side of the pairs."""
    a = pairs.where(F.col("method_a") == of).select(F.col("method_b").alias("method"), "wins", "ties", "losses", "mean_difference")
    b = pairs.where(F.col("method_b") == of).select(F.col("method_a").alias("method"), F.col("losses").alias("wins"), "ties", F.col("wins").alias("losses"), (-F.col("mean_difference")).alias("mean_difference"))
    return a.unionByName(b)


def lead(ranking: DataFrame, pairs: DataFrame, n_datasets: int, method: str = "method") -> DataFrame:
    """One row: the first method, and whether it leads: three datasets or more, and more wins than losses against every other."""
    best = ranking.orderBy("position").select(F.col(method).alias("best_method")).limit(1)
    both = pairs.select(F.col("method_a").alias("m"), F.col("wins").alias("w"), F.col("losses").alias("l")).unionByName(pairs.select(F.col("method_b").alias("m"), F.col("losses").alias("w"), F.col("wins").alias("l")))
    worse = best.join(both, F.col("m") == F.col("best_method"), "left").groupBy("best_method").agg(F.count(F.when(F.col("w") <= F.col("l"), 1)).alias("n"))
    return worse.select("best_method", F.lit(n_datasets).alias("dataset_count"), ((F.col("n") == 0) & F.lit(n_datasets >= 3)).alias("is_supported"), F.lit(n_datasets < 3).alias("data_gap"))


def baseline_deltas(metrics: DataFrame, higher: list[str], lower: str, overall: str, baseline: str, by: str = "dataset_id", method: str = "method") -> DataFrame:
    """Each method's change from the baseline of its dataset, and whether it succeeds.

    Success: a gain over 0.01 in some metric, ``lower`` up by at most 0.05, ``overall`` down by at most 0.02; never the baseline itself.
    """
    names = [*higher, overall, lower]
    b = metrics.where(F.col(method) == baseline).groupBy(F.col(by).alias("_by")).agg(*[F.first(m).alias(f"_{m}") for m in names])
    out = metrics.join(b, F.col(by) == F.col("_by"), "left")
    out = out.withColumns({f"delta_{m}_vs_baseline": F.col(m) - F.col(f"_{m}") for m in names})
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    gains = [number(f"delta_{m}_vs_baseline") for m in higher]
    gain = F.greatest(*gains) if len(gains) > 1 else gains[0]
    good = (gain > 0.01) & (number(f"delta_{lower}_vs_baseline") <= 0.05) & (number(f"delta_{overall}_vs_baseline") >= -0.02)
    return out.withColumn("success_candidate", F.coalesce(good, F.lit(False)) & (F.col(method) != baseline)).drop("_by", *[f"_{m}" for m in names])


def replaced_selection(scores: DataFrame, old: str, new: str, k: int, budget: int, item: str = "gene") -> DataFrame:
    """The ``k`` best items by ``old``, of which the ``budget`` worst give way to the best others by ``new``; ties by item."""
    w = W.orderBy(F.desc(old), item)  # one row per item
    ranked = scores.withColumn("_old", F.row_number().over(w))
    stay = ranked.where(F.col("_old") <= k - budget).select(item)
    come = ranked.where(F.col("_old") > k - budget).orderBy(F.desc_nulls_last(new), item).limit(budget).select(item)
    return stay.unionByName(come)


def method_comparison(summary: DataFrame, metrics: list[str], methods: list[str], a: str, b: str) -> DataFrame:
    """Scenarios by ``method_metric``, and what method a has more than b of the first two metrics."""
    cols = [F.first(F.when(F.col("method") == m, F.col(x)), ignorenulls=True).alias(f"{m}_{x}") for m in methods for x in metrics]
    out = summary.groupBy("scenario_id").agg(*cols)
    return out.withColumns({f"{a}_minus_{b}_{x}": F.col(f"{a}_{x}") - F.col(f"{b}_{x}") for x in metrics[:2]})


def evaluate_methods(abundance: DataFrame, alpha: float = 0.1, permutations: int = 8192, seed: int = 7, midp: bool = True) -> DataFrame:
    """(dataset_id, motif_id, method, effect_estimate, pvalue, qvalue, discovery, raw_call): every test of every motif, in one long table.

    q values are by method within a dataset; a missing p counts as one.
    """
    key = ["dataset_id", "motif_id"]
    v = abundance.withColumn("value", F.col("motif_fraction"))
    f = M.fisher_test(abundance).select(*key, (F.col("case_fraction") - F.col("ref_fraction")).alias("effect_estimate"), "pvalue", F.lit("naive_fisher").alias("method"))
    p = T.permutation_test(v, permutations, seed)
    parts = [f, p.select(*key, F.col("observed_effect").alias("effect_estimate"), F.col("pvalue_two_sided").alias("pvalue"), F.lit("sample_permutation").alias("method"))]
    parts.append(M.ols_hc3_test(v).select(*key, "effect_estimate", "pvalue", F.lit("ols_hc3").alias("method")))
    parts.append(M.quasi_binomial_test(abundance).select(*key, "effect_estimate", "pvalue", F.lit("quasi_binomial").alias("method")))
    if midp:
        parts.append(p.select(*key, F.col("observed_effect").alias("effect_estimate"), F.col("pvalue_midp").alias("pvalue"), F.lit("sample_permutation_midp").alias("method")))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    out = T.benjamini_hochberg(rows, "pvalue", "qvalue", "dataset_id", "method")
    call = F.coalesce(F.when(~F.isnan("pvalue"), F.col("pvalue")), F.lit(1.0)) <= alpha
    return out.select(*key, "method", "effect_estimate", "pvalue", "qvalue", (F.col("qvalue") <= alpha).alias("discovery"), call.alias("raw_call"))


def float_slug(c: Column, digits: int = 2) -> Column:
    """A number in a name: fixed digits, the point as p and a minus as m."""
    return F.translate(F.format_string(f"%.{digits}f", c.cast("double")), ".-", "pm")


def sample_sizes(c: Column) -> Column:
    """(n_case, n_control) of a design written like 3x4."""
    part = F.split(F.lower(F.trim(c)), "x")
    return F.struct(*[F.trim(F.get(part, i)).try_cast("int").alias(n) for i, n in ((0, "n_case"), (1, "n_control"))])
