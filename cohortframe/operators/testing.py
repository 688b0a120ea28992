"""Sample-level tests of motif differences between two conditions.

The unit of a test is the sample: ``values`` has one row per (dataset_id, motif_id, sample_id, condition, value).  Samples
are few, so a motif's values travel as one array in the order of sample_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.plans.ship import ship

TOLERANCE = 1e-12
_KEY = ["dataset_id", "motif_id"]
_TEST = pa.schema([("dataset_id", pa.string()), ("motif_id", pa.string()), ("observed_effect", pa.float64()), ("pvalue_two_sided", pa.float64()), ("pvalue_one_sided", pa.float64()), ("pvalue_midp", pa.float64()), ("n_permutations", pa.int64()), ("mode", pa.string()), ("total_labelings", pa.string())])


def condition_score(name: Column) -> Column:
    """0, 1 or 2 by the first rule whose keyword stands anywhere in the lower-case name.

    Fixed values: the keywords of both rules.
    """
    low = F.lower(name)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.when(has("control", "normal", "responder", "er"), 0).when(has("ad", "tumor", "tnbc", "non-responder", "disease"), 2).otherwise(1)


def condition_order(values: DataFrame) -> DataFrame:
    """(dataset_id, condition_a, condition_b) of the datasets with exactly two conditions: reference first."""
    names = values.select("dataset_id", "condition").where("condition is not null").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(condition_score(F.col("condition")).alias("score"), F.lower("condition").alias("low"), "condition")))
    out = names.groupBy("dataset_id").agg(ordered.alias("o")).where(F.size("o") == 2)
    return out.select("dataset_id", F.col("o")[0]["condition"].alias("condition_a"), F.col("o")[1]["condition"].alias("condition_b"))


def motif_arrays(values: DataFrame) -> DataFrame:
    """One row per motif of a two-condition dataset: its values and case marks in order of (sample_id, condition), and both sizes."""
    rows = values.join(condition_order(values), "dataset_id")
    each = F.array_sort(F.collect_list(F.struct("sample_id", "condition", F.col("value").cast("double").alias("value"), (F.col("condition") == F.col("condition_b")).alias("is_case"))))
    out = rows.groupBy(*_KEY, "condition_a", "condition_b").agg(each.alias("e"))
    out = out.select(*_KEY, "condition_a", "condition_b", F.col("e.value").alias("v"), F.col("e.is_case").alias("c"), F.size("e").alias("n"))
    return out.withColumn("n_case", F.size(F.filter("c", lambda x: x))).withColumn("total", F.aggregate("v", F.lit(0.0), lambda s, x: s + x))


def labelings(n: int, n_case: int, most: int, seed: int = 0) -> tuple[np.ndarray, str]:
    """Which samples are cases, one row per labeling: every choice, or ``most`` random ones if there are more than that.

    Designs are of any size.  The draws follow the order of numpy's generator, so a seed gives the same ones everywhere.
    """
    if comb(n, n_case) <= most:
        picked, mode = list(combinations(range(n), n_case)), "exact"
    else:
        r = np.random.default_rng(seed)
        picked, mode = [r.choice(n, size=n_case, replace=False) for _ in range(most)], "approx_monte_carlo"
    out = np.zeros((len(picked), n), bool)
    np.put_along_axis(out, np.array(picked, np.int64).reshape(len(picked), n_case), True, axis=1)
    return out, mode


_drawn: dict[tuple[int, int, int, int], tuple[np.ndarray, str]] = {}


def _of_design(n: int, n_case: int, most: int, seed: int) -> tuple[np.ndarray, str]:
    """:func:`labelings`, kept for the tasks that follow in this worker."""
    key = (n, n_case, most, seed)
    if key not in _drawn:
        if len(_drawn) > 16:
            _drawn.clear()
        _drawn[key] = labelings(*key)
    return _drawn[key]


def _effects(b: pa.RecordBatch, most: int, seed: int):
    """(row of the batch, effects under every labeling, mode) for each motif."""
    for i, (v, n_case) in enumerate(zip(b.column("v").to_pylist(), b.column("n_case").to_pylist(), strict=True)):
        x = np.array(v, np.float64)
        if 0 < n_case < len(x):
            masks, mode = _of_design(len(x), n_case, most, seed)
            cases = masks @ x
            yield i, cases / n_case - (x.sum() - cases) / (len(x) - n_case), mode


def _with_observed(values: DataFrame) -> DataFrame:
    """:func:`motif_arrays` and each motif's effect as it is."""
    cases = F.aggregate(F.zip_with("v", "c", lambda x, y: F.when(y, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return motif_arrays(values).withColumn("observed_effect", cases / F.col("n_case") - (F.col("total") - cases) / (F.col("n") - F.col("n_case")))


def total_labelings(n: int, n_case: int) -> str:
    """How many labelings a design has, in digits, as they may exceed any number type."""
    return str(comb(n, n_case))


def permutation_test(values: DataFrame, most: int = 8192, seed: int = 0) -> DataFrame:
    """Sample-label permutation of each motif: observed effect, two- and one-sided p, mid-p, draws, mode and all labelings.

    Exact where there are at most ``most`` labelings; else that many draws, whose two- and one-sided p add one to hits and draws.
    Datasets without exactly two conditions are left out.  Motifs are the distributed side; the labelings of a design are one
    matrix of at most ``most`` rows per worker.
    """
    ship(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            seen = b.column("observed_effect").to_pylist()
            sizes = list(zip(b.column("n").to_pylist(), b.column("n_case").to_pylist(), strict=True))
            for i, e, mode in _effects(b, most, seed):
                gap = np.abs(e) - abs(seen[i])
                side = e - seen[i] if seen[i] >= 0 else seen[i] - e
                more, same, extra = int((gap > TOLERANCE).sum()), int((np.abs(gap) <= TOLERANCE).sum()), int(mode != "exact")
                rows.append((b.column("dataset_id")[i].as_py(), b.column("motif_id")[i].as_py(), seen[i], (more + same + extra) / (len(e) + extra), (int((side >= -TOLERANCE).sum()) + extra) / (len(e) + extra), (more + 0.5 * same) / len(e), len(e), mode, total_labelings(*sizes[i])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 9, _TEST.types, strict=True)], schema=_TEST)

    # one row per motif: spread over all tasks, for each is thousands of sums
    motifs = _with_observed(values).repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY)
    return motifs.select(*_KEY, "v", "n", "n_case", "observed_effect").mapInArrow(run, "dataset_id string, motif_id string, observed_effect double, pvalue_two_sided double, pvalue_one_sided double, pvalue_midp double, n_permutations long, mode string, total_labelings string")


def max_t_test(values: DataFrame, most: int = 4096, seed: int = 0) -> DataFrame:
    """Family-wise p: the share of labelings whose largest absolute effect over a dataset's motifs reaches the motif's.

    Each task gives its motifs' largest effect per labeling; the largest of those are one array per dataset.
    """
    ship(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[str, int, int], tuple[np.ndarray, str]] = {}
        for b in batches:
            data, sizes = b.column("dataset_id").to_pylist(), list(zip(b.column("n").to_pylist(), b.column("n_case").to_pylist(), strict=True))
            for i, e, mode in _effects(b, most, seed):
                key = (data[i], *sizes[i])
                top[key] = (np.maximum(top[key][0], np.abs(e)) if key in top else np.abs(e), mode)
        for (d, n, k), (t, mode) in top.items():
            yield pa.RecordBatch.from_pydict({"dataset_id": [d] * len(t), "draw": np.arange(len(t)), "top": t, "mode": [mode] * len(t), "total_labelings": [total_labelings(n, k)] * len(t)})

    motifs = _with_observed(values)
    tops = motifs.select("dataset_id", "v", "n", "n_case").mapInArrow(run, "dataset_id string, draw long, top double, mode string, total_labelings string")
    tops = tops.groupBy("dataset_id", "draw").agg(F.max("top").alias("top"), F.max("mode").alias("mode"), F.max("total_labelings").alias("total_labelings"))
    tops = tops.groupBy("dataset_id").agg(F.collect_list("top").alias("tops"), F.max("mode").alias("mode"), F.max("total_labelings").alias("total_labelings"))
    hits, n = F.size(F.filter("tops", lambda t: t >= F.abs("observed_effect") - TOLERANCE)), F.size("tops")
    extra = F.when(F.col("mode") == "exact", 0).otherwise(1)
    return motifs.join(tops, "dataset_id").select(*_KEY, "observed_effect", ((hits + extra) / (n + extra)).alias("pvalue_max_t"), n.cast("long").alias("n_permutations"), "mode", "total_labelings")


def benjamini_hochberg(df: DataFrame, p: str, q: str, *by: str, order: str = "motif_id") -> DataFrame:
    """Step-up q values of column ``p`` within the groups ``by``; a null p counts as one."""
    value = F.when(F.isnan(p), 1.0).otherwise(F.coalesce(F.col(p), F.lit(1.0)))
    df = df.withColumn("_p", value).withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy("_p", order)))
    n = F.count("*").over(W.partitionBy(*by))
    df = df.withColumn("_r", F.col("_p") * n / F.col("_rank"))
    low = F.min("_r").over(W.partitionBy(*by).orderBy("_rank").rowsBetween(W.currentRow, W.unboundedFollowing))
    return df.withColumn(q, F.greatest(F.lit(0.0), F.least(F.lit(1.0), low))).drop("_p", "_rank", "_r")


def condition_effects(values: DataFrame, pseudo: float = 1e-4) -> DataFrame:
    """Each motif's mean, standard error and samples by condition, their difference and log2 ratio."""
    rows = values.join(condition_order(values), "dataset_id").withColumn("case", F.col("condition") == F.col("condition_b"))

    def of(f, case: bool) -> Column:
        return f(F.when(F.col("case") == case, F.col("value")))

    out = rows.groupBy(*_KEY, "condition_a", "condition_b").agg(
        of(F.avg, False).alias("mean_a"), of(F.avg, True).alias("mean_b"), of(F.count, False).alias("n_a"), of(F.count, True).alias("n_b"), of(F.stddev_samp, False).alias("sd_a"), of(F.stddev_samp, True).alias("sd_b")
    )
    out = out.withColumn("effect", F.col("mean_b") - F.col("mean_a")).withColumn("log2_fold_change", F.log2((F.col("mean_b") + pseudo) / (F.col("mean_a") + pseudo)))
    return out.withColumn("sem_a", F.col("sd_a") / F.sqrt("n_a")).withColumn("sem_b", F.col("sd_b") / F.sqrt("n_b")).drop("sd_a", "sd_b")


def leave_one_out(values: DataFrame) -> DataFrame:
    """Each motif's effect without each sample in turn, summed up: sign agreement, median, deviation, largest shift.

    The mean without a sample follows from its condition's sum and size, so one window replaces the folds.
    """
    rows = values.join(condition_order(values), "dataset_id").withColumn("case", F.col("condition") == F.col("condition_b"))
    w = W.partitionBy(*_KEY)

    def total(case: bool) -> tuple[Column, Column]:
        own = F.when(F.col("case") == case, F.col("value"))
        return F.sum(own).over(w), F.count(own).over(w)

    (sa, na), (sb, nb) = total(False), total(True)
    rows = rows.withColumns({"sa": sa, "na": na, "sb": sb, "nb": nb}).withColumn("full", F.col("sb") / F.col("nb") - F.col("sa") / F.col("na"))

    def without(s: str, n: str, case: bool) -> Column:
        mine = F.col("case") == case
        left = F.col(n) - F.when(mine, 1).otherwise(0)
        return (F.col(s) - F.when(mine, F.col("value")).otherwise(0.0)) / F.when(left > 0, left)

    rows = rows.withColumn("fold", without("sb", "nb", True) - without("sa", "na", False)).where("fold is not null")
    agree = F.when(F.abs("full") <= 1e-8, F.abs("fold") <= 1e-8).otherwise(F.signum("fold") == F.signum("full"))
    return rows.groupBy(*_KEY).agg(
        F.avg(agree.cast("double")).alias("loso_sign_consistency"), F.percentile("fold", 0.5).alias("loso_effect_median"), F.stddev_samp("fold").alias("loso_effect_std"),
        F.max(F.abs(F.col("fold") - F.col("full"))).alias("loso_max_abs_shift"), F.count("*").alias("n_folds"),
    )


def ols_hc3(values: DataFrame) -> DataFrame:
    """Least squares of the value on the condition with HC3 errors: effect, standard error and t.

    With two groups the leverage is one over the group's size, so the sums of squares per group are enough.
    """
    e = condition_order(values)
    rows = values.join(e, "dataset_id").withColumn("case", (F.col("condition") == F.col("condition_b")).cast("int"))
    g = rows.groupBy(*_KEY, "case").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    g = g.withColumn("part", F.col("v") * F.col("n") / F.pow(F.greatest(1 - 1 / F.col("n"), F.lit(1e-8)), F.lit(2.0)) / F.pow("n", F.lit(2.0)))
    out = g.groupBy(*_KEY).agg(F.sum(F.when(F.col("case") == 1, F.col("m"))).alias("mb"), F.sum(F.when(F.col("case") == 0, F.col("m"))).alias("ma"), F.sqrt(F.sum("part")).alias("standard_error"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k = 2")
    out = out.withColumn("effect_estimate", F.col("mb") - F.col("ma")).withColumn("df", F.greatest(F.col("n") - 2, F.lit(1)))
    return out.select(*_KEY, "effect_estimate", "standard_error", F.when(F.col("standard_error") > 1e-12, F.col("effect_estimate") / F.col("standard_error")).otherwise(0.0).alias("t_statistic"), "df")


def naive_contingency(abundance: DataFrame) -> DataFrame:
    """Pooled spot counts of each motif by condition, the odds ratio (null when infinite) and both fractions."""
    rows = abundance.join(condition_order(abundance), "dataset_id").withColumn("case", F.col("condition") == F.col("condition_b"))

    def total(c: str, case: bool) -> Column:
        return F.sum(F.when(F.col("case") == case, F.col(c)).otherwise(0))

    out = rows.groupBy(*_KEY).agg(total("motif_spots", True).alias("case_in"), total("sample_spots", True).alias("case_all"), total("motif_spots", False).alias("ref_in"), total("sample_spots", False).alias("ref_all"))
    a, b, c, d = F.col("case_in"), F.col("case_all") - F.col("case_in"), F.col("ref_in"), F.col("ref_all") - F.col("ref_in")
    return out.select(*_KEY, "case_in", "case_all", "ref_in", "ref_all", (a * d / F.when(b * c > 0, b * c)).alias("odds_ratio"), (a / F.when(F.col("case_all") > 0, F.col("case_all"))).alias("case_fraction"), (c / F.when(F.col("ref_all") > 0, F.col("ref_all"))).alias("ref_fraction"))


def _is(c: Column) -> Column:
    """A comparison that fails on null and, as in IEEE arithmetic and unlike Spark's order, on NaN."""
    return F.coalesce(c, F.lit(False))


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def support_tier(sample_p: Column, max_t_p: Column, null_p: Column, loso: Column, naive_p: Column) -> Column:
    """The support tier; a comparison with null or NaN fails, as it should with a missing number."""
    sample_p, max_t_p, null_p, loso, naive_p = map(_number, (sample_p, max_t_p, null_p, loso, naive_p))
    steady = _is(sample_p <= 0.20) & _is(loso >= 0.80)
    return F.when(steady & _is(max_t_p <= 0.20) & _is(null_p <= 0.20), "heldout_supported").when(steady, "sample_level_supported").when(_is(naive_p <= 1e-4) & _is(sample_p > 0.20), "naive_only").otherwise("not_supported")


def evidence_tier(mixed_p: Column, permutation_p: Column, q: Column, low: Column, high: Column) -> Column:
    """strong, moderate, weak or none; a comparison with null or NaN fails."""
    mixed_p, permutation_p, q, low, high = map(_number, (mixed_p, permutation_p, q, low, high))
    away = _is(low > 0) | _is(high < 0)
    return F.when(_is(q <= 0.10) & away, "strong").when(away & (_is(permutation_p <= 0.20) | _is(mixed_p <= 0.05)), "moderate").when(_is(mixed_p <= 0.10) | _is(permutation_p <= 0.20), "weak").otherwise("none")
