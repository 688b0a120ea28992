"""Trade-offs of configurations over several metrics, and comparisons of methods over runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.functions import special
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import materialize


REGISTRY = "metric_name string, position int, direction string, metric_group string, epsilon double, gain_threshold double, loss_tolerance double"
#: The metrics of both evaluation modes and their thresholds.
MODES = {
    "discrete": dict(protected=["var_ratio", "lisi"], target=["ari", "nmi"], gains={"ari": 0.0030, "nmi": 0.0030}, losses={"var_ratio": 0.0100, "lisi": 0.0050, "ari": 0.0020, "nmi": 0.0020}),
    "continuous": dict(protected=["var_ratio", "dist_cor", "knn_ratio", "three_nn"], target=["max_ari", "max_nmi"], gains={"max_ari": 0.0050, "max_nmi": 0.0050}, losses={"var_ratio": 0.0200, "dist_cor": 0.0015, "knn_ratio": 0.0030, "three_nn": 15.0, "max_ari": 0.0030, "max_nmi": 0.0030}),
}


def metric_registry(spark: SparkSession, protected: list[str], target: list[str], directions: dict[str, str] | None = None, epsilons: dict[str, float] | None = None, gains: dict[str, float] | None = None, losses: dict[str, float] | None = None) -> DataFrame:
    """One row per metric: protected ones, then targets.  Thresholds that are not given are the metric's epsilon, which is 1e-9."""
    directions, epsilons, gains, losses = directions or {}, epsilons or {}, gains or {}, losses or {}
    rows = []
    for i, (group, m) in enumerate([*(("protected", m) for m in protected), *(("target", m) for m in target)]):
        e = float(epsilons.get(m, 1e-9))
        rows.append((m, i, directions.get(m, "higher_is_better"), group, e, float(gains.get(m, e)), float(losses.get(m, e))))
    return spark.createDataFrame(rows, REGISTRY)


def registry_of_mode(spark: SparkSession, mode: str) -> DataFrame:
    """The registry of an evaluation mode, by its name in any case, blanks around it aside."""
    name = mode.strip().lower()
    if name not in MODES:
        raise ValueError(f"no such evaluation mode: {mode}")
    return metric_registry(spark, **MODES[name])


def oriented(value: Column) -> Column:
    """A value or a change, so that more is better; reads the registry's ``direction``."""
    return F.when(F.col("direction") == "lower_is_better", -value).otherwise(value)


def metric_deltas(values: DataFrame, baseline: DataFrame, registry: DataFrame) -> DataFrame:
    """(config_id, metric_name, delta): how much better each configuration is than the baseline, for registered metrics that both have.

    ``values``: config_id, metric_name, value; ``baseline``: metric_name, value.
    """
    b = baseline.select("metric_name", F.col("value").alias("_base"))
    rows = values.join(b, "metric_name").join(F.broadcast(registry), "metric_name")
    return rows.select("config_id", "metric_name", oriented(F.col("value") - F.col("_base")).alias("delta"))


def classify(deltas: DataFrame, registry: DataFrame) -> DataFrame:
    """Label each configuration by its oriented metric changes (config_id, metric_name, delta).

    clean_win: a target gains and no target or protected metric loses; near_clean: a target reaches its gain threshold and
    no target or protected metric loses more than its tolerance; mixed_tradeoff: wins and losses; dominated: losses
    only; flat_or_tied: neither.  Gains and losses count beyond epsilon; lists of metrics are in the registry's order.
    """
    rows = deltas.join(F.broadcast(registry), "metric_name")
    d, e = F.col("delta"), F.col("epsilon")
    target, protected = F.col("metric_group") == "target", F.col("metric_group") == "protected"
    win, loss, watched = d > e, d < -e, target | protected

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    def named(c: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(c, F.struct("position", "metric_name"))))
        return F.array_join(F.transform(found, lambda x: x["metric_name"]), ",")

    kinds = {"win": win, "loss": loss, "protected_loss": loss & protected, "target_gain": win & target, "target_loss": loss & target}
    out = rows.groupBy("config_id").agg(
        *[n(c).alias(f"{k}_count") for k, c in kinds.items()], *[named(c).alias(f"{k}_metrics") for k, c in kinds.items()],
        n(target & (d >= F.col("gain_threshold"))).alias("_reached"), n(watched & (d < -F.col("loss_tolerance"))).alias("_over"), n(watched & loss).alias("_watched_loss"),
    )
    clean = (F.col("target_gain_count") > 0) & (F.col("_watched_loss") == 0)
    out = out.withColumn("clean_win", clean).withColumn("near_clean", (F.col("_reached") > 0) & (F.col("_over") == 0) & ~clean)
    out = out.withColumn("mixed_tradeoff", (F.col("win_count") > 0) & (F.col("loss_count") > 0)).withColumn("dominated", (F.col("win_count") == 0) & (F.col("loss_count") > 0))
    label = F.lit("flat_or_tied")
    for k in ("dominated", "mixed_tradeoff", "near_clean", "clean_win"):
        label = F.when(F.col(k), k).otherwise(label)
    return out.withColumn("pareto_label", label).drop("_reached", "_over", "_watched_loss")


def _dominates(a: list[Column], b: list[Column], eps: float) -> Column:
    no_worse = better = None
    for x, y in zip(a, b, strict=True):
        w, s = x >= y - eps, x > y + eps
        no_worse = w if no_worse is None else no_worse & w
        better = s if better is None else better | s
    return no_worse & better


def dominance(df: DataFrame, metrics: list[str], key: str = "config_id", eps: float = 1e-9) -> DataFrame:
    """(winner, loser): every pair of configurations where the first is no worse in any metric and better in one (higher is better)."""
    a = df.select(F.col(key).alias("winner"), *[F.col(m).alias(f"a{i}") for i, m in enumerate(metrics)])
    b = df.select(F.col(key).alias("loser"), *[F.col(m).alias(f"b{i}") for i, m in enumerate(metrics)])
    n = range(len(metrics))
    return a.join(b, (F.col("winner") != F.col("loser")) & _dominates([F.col(f"a{i}") for i in n], [F.col(f"b{i}") for i in n], eps)).select("winner", "loser")


def frontier(df: DataFrame, metrics: list[str], key: str = "config_id", eps: float = 1e-9) -> DataFrame:
    """How many configurations each one dominates and is dominated by, and whether it is on the frontier."""
    pairs = dominance(df, metrics, key, eps)
    out = df.select(key).join(pairs.groupBy(F.col("winner").alias(key)).agg(F.count("*").alias("dominates")), key, "left").join(pairs.groupBy(F.col("loser").alias(key)).agg(F.count("*").alias("dominated_by")), key, "left")
    return out.select(key, F.coalesce("dominates", F.lit(0)).alias("dominates"), F.coalesce("dominated_by", F.lit(0)).alias("dominated_by"), F.col("dominated_by").isNull().alias("is_frontier"))


def depth(df: DataFrame, metrics: list[str], key: str = "config_id", eps: float = 1e-9) -> DataFrame:
    """The layer of each configuration: 0 on the frontier, then that of what is left, and so on.

    Layers are peeled one by one; rows of a cycle, which a large ``eps`` allows, share the last layer.
    """
    pairs = materialize(dominance(df, metrics, key, eps), "pairs")
    left, layer, out = materialize(df.select(F.col(key).alias("k")), "layer"), 0, None
    while not left.isEmpty():
        beaten = pairs.join(left.withColumnRenamed("k", "winner"), "winner").select(F.col("loser").alias("k")).distinct()
        top = left.join(beaten, "k", "left_anti")
        if top.isEmpty():
            top = left
        top = materialize(top, "top")
        got = top.select(F.col("k").alias(key), F.lit(layer).alias("depth"))
        out = got if out is None else out.unionByName(got)
        left, layer = materialize(left.join(top, "k", "left_anti"), "layer"), layer + 1
    return out if out is not None else df.select(key, F.lit(0).alias("depth"))


def skyline(df: DataFrame, metrics: list[str], key: str = "config_id") -> DataFrame:
    """The keys of the configurations that no other one dominates (higher is better, no tolerance).

    Each partition first drops what its own rows dominate, as dominance without a tolerance is transitive, so only the survivors
    meet one another.  Rows with a null or NaN metric are left out.
    """
    whole = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).dropna(subset=metrics)
    kind = dict(whole.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, best = [], np.empty((0, len(metrics)))
        for b in batches:
            x = np.stack([b.column(m).to_numpy() for m in metrics], 1)
            order = np.argsort(-x.sum(1), kind="stable")
            for i in order.tolist():
                r = x[i]
                if not ((best >= r).all(1) & (best > r).any(1)).any():
                    stay = ~((r >= best).all(1) & (r > best).any(1))
                    keys = [*[k for k, s in zip(keys, stay.tolist(), strict=True) if s], b.column(key)[i].as_py()]
                    best = np.vstack((best[stay], r))
        yield pa.RecordBatch.from_arrays([pa.array(keys, b_type), *(pa.array(best[:, j]) for j in range(len(metrics)))], [key, *metrics])

    b_type = pa.string() if kind == "string" else pa.int64()
    some = materialize(whole.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{m}` double" for m in metrics)), "skyline")
    lost = dominance(some, metrics, key, 0.0).select(F.col("loser").alias(key)).distinct()
    return some.select(key).join(lost, key, "left_anti")


def replacement_summary(frontier_rows: DataFrame, *by: str, budget: str = "budget", flag: str = "is_frontier") -> DataFrame:
    """Per group: how many budgets lie on the frontier, and which, ascending, joined by commas."""
    found = F.array_sort(F.collect_list(F.when(F.col(flag), F.col(budget).cast("long"))))
    return frontier_rows.groupBy(*by).agg(F.size(found).cast("long").alias("frontier_budget_count"), F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("frontier_budgets"))


def group_frontier(df: DataFrame, metrics: list[str], by: str, key: str = "config_id", eps: float = 1e-9) -> DataFrame:
    """Within each group of ``by``: how many others each configuration dominates and is dominated by, and whether it is on the frontier."""
    a = df.select(by, F.col(key).alias("winner"), *[F.col(m).alias(f"a{i}") for i, m in enumerate(metrics)])
    b = df.select(by, F.col(key).alias("loser"), *[F.col(m).alias(f"b{i}") for i, m in enumerate(metrics)])
    n = range(len(metrics))
    pairs = a.join(b, by).where((F.col("winner") != F.col("loser")) & _dominates([F.col(f"a{i}") for i in n], [F.col(f"b{i}") for i in n], eps))
    up, down = pairs.groupBy(by, F.col("winner").alias(key)).agg(F.count("*").alias("dominates")), pairs.groupBy(by, F.col("loser").alias(key)).agg(F.count("*").alias("dominated_by"))
    out = df.select(by, key).join(up, [by, key], "left").join(down, [by, key], "left")
    return out.select(by, key, F.coalesce("dominates", F.lit(0)).alias("dominates"), F.coalesce("dominated_by", F.lit(0)).alias("dominated_by"), F.col("dominated_by").isNull().alias("is_frontier"))


def alpha_grid(start: float = 0.0, stop: float = 1.0, step: float | None = None, num: int = 5, values: list[float] | None = None, decimals: int = 2) -> list[float]:
    """Blend weights between 0 and 1: those given, in steps, or ``num`` evenly spaced; rounded, distinct, ascending."""
    if values is None and step is not None:
        if step <= 0:
            raise ValueError("step must be positive")
        values = np.arange(start, stop + step / 2, step).tolist()
    elif values is None:
        if num < 2:
            raise ValueError("num must be two or more")
        values = np.linspace(start, stop, num).tolist()
    if any(not 0 <= v <= 1 for v in values):
        raise ValueError("weights lie between 0 and 1")
    return sorted({round(float(v), decimals) for v in values})


def rank_by(value: str, *by: str, method: str = "dense", ascending: bool = True) -> Column:
    """The rank of a value within a group: dense, min, max, average or first (ties as they come)."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    w, same = W.partitionBy(*by).orderBy(order), F.count("*").over(W.partitionBy(*by, value))
    if method == "dense":
        return F.dense_rank().over(w).cast("double")
    if method == "first":
        return F.row_number().over(w).cast("double")
    extra = {"min": F.lit(0.0), "max": same - 1.0, "average": (same - 1) / 2.0}[method]
    return F.rank().over(w) + extra


def rank_blend(df: DataFrame, left: str, right: str, alphas: list[float], item: str, method: str = "dense", smaller_is_better: bool = True) -> DataFrame:
    """For each alpha: (1 - alpha) * left + alpha * right, and its rank."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in sorted(set(alphas))])).alias("alpha")
    rows = df.select(item, left, right, grid).withColumn("blend", (1 - F.col("alpha")) * F.col(left) + F.col("alpha") * F.col(right))
    return rows.withColumn("rank", rank_by("blend", "alpha", method=method, ascending=smaller_is_better)).select(item, "alpha", "blend", "rank")


def min_max(value: str, *by: str) -> Column:
    """Scaled to 0..1 within a group; 0 where all are alike."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.abs(high - low) <= 1e-8 + 1e-5 * F.abs(low), 0.0).otherwise((F.col(value) - low) / (high - low))


def run_scores(runs: DataFrame, positive: list[str], runtime: str, by: list[str], runtime_weight: float = 0.15, tie: float = 1e-12, method: str = "method") -> DataFrame:
    """Each run's score in its group, its rank and whether it wins.

    Scaled metrics are summed, less the weighted scaled runtime.  Ranks are by score, then least runtime, then method;
    winners lie within ``tie`` of the best.
    """
    score = -runtime_weight * min_max(runtime, *by)
    for m in positive:
        score = score + min_max(m, *by)
    out = runs.withColumn("overall_score", score)
    out = out.withColumn("overall_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("overall_score"), runtime, method)))
    return out.withColumn("is_winner", F.abs(F.col("overall_score") - F.max("overall_score").over(W.partitionBy(*by))) <= tie)


def run_summary(scored: DataFrame, keys: list[str], metrics: list[str], seed: str = "seed") -> DataFrame:
    """Per group of ``keys``: mean and population deviation of each metric, runs, wins, their share, distinct seeds."""
    out = scored.groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics], F.count("*").alias("run_count"),
        F.sum(F.col("is_winner").cast("long")).alias("win_count"), F.avg(F.col("is_winner").cast("double")).alias("win_rate"), F.count_distinct(seed).alias("seed_count"),
    )
    return out


def method_ranking(summary: DataFrame, *by: str, method: str = "method", runtime: str = "runtime") -> DataFrame:
    """Methods in order within each group: mean rank, win rate, mean score, runtime, name."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return summary.withColumn("position", F.row_number().over(w.orderBy("overall_rank", F.desc("win_rate"), F.desc("overall_score"), runtime, method)))


def win_tie_loss(runs: DataFrame, by: list[str], method: str = "method", score: str = "overall_score", tie: float = 1e-12) -> DataFrame:
    """For each two methods over the runs that both have: wins, ties, losses of the first, the mean difference and Wilcoxon's p.

    Differences within ``tie`` are ties and left out of the signed-rank test, which is null if none is left.
    """
    ship(runs.sparkSession)
    a = runs.select(*by, F.col(method).alias("method_a"), F.col(score).alias("sa"))
    b = runs.select(*by, F.col(method).alias("method_b"), F.col(score).alias("sb"))
    pairs = a.join(b, by).where("method_a < method_b").withColumn("d", F.col("sa") - F.col("sb"))

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    @F.pandas_udf("double")
    def signed_rank(d: pd.Series) -> pd.Series:
        return pd.Series([special.signed_rank(list(x)) if len(x) else None for x in d], dtype="float64")

    out = pairs.groupBy("method_a", "method_b").agg(n(F.col("d") > tie).alias("wins"), n(F.abs("d") <= tie).alias("ties"), n(F.col("d") < -tie).alias("losses"), F.avg("d").alias("mean_difference"), F.collect_list(F.when(F.abs("d") > tie, F.col("d"))).alias("_d"))
    return out.withColumn("wilcoxon_p", signed_rank("_d")).drop("_d")


#: Words of labels that say nothing.
STOP_WORDS = ("dense", "sparse", "mixed", "high", "low", "mide", "highe", "lowe", "mid")


def label_jaccard(a: Column, b: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Jaccard similarity of the words of two labels, lower case, without ``stop`` words; 0 if either has none."""

    def words(c: Column) -> Column:
        w = F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))
        return F.array_except(w, F.array(*[F.lit(s) for s in stop]).cast("array<string>")) if stop else w

    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
