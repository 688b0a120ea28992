"""Feature vectors: normalisation by sample, distances, nearest centroids, counts to expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def zscore(df: DataFrame, value: str, *by: str, eps: float = 1e-6, out: str = "z") -> DataFrame:
    """``value`` centred and scaled within the groups ``by``; a deviation (of the population) up to ``eps`` counts as one.

    Groups are summed up first and joined, so no group is held in one task.
    """
    names = [f"_by{i}" for i in range(len(by))]
    stat = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") <= eps, 1.0).otherwise(F.col("_s"))
    return df.join(stat, same).withColumn(out, z).drop(*names, "_m", "_s")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_centroid(rows: DataFrame, centroids: DataFrame, vector: str = "vector") -> DataFrame:
    """Each row's nearest centroid (ties: the smallest id) and the squared distance.

    Centroids are a model's, tens or hundreds: they travel as one array, so rows are read once and nothing is shuffled.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("centroid_id", F.col("centroid")))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col(vector), c["centroid"]).alias("d"), c["centroid_id"].alias("i"))))
    return rows.crossJoin(F.broadcast(table)).withColumn("_b", best).select(*rows.columns, F.col("_b.i").alias("centroid_id"), F.col("_b.d").alias("distance2"))


def log_cp10k(counts: DataFrame, obs: str = "obs", value: str = "value") -> DataFrame:
    """Counts as log(1 + counts per ten thousand of the observation); stored values only."""
    total = F.sum(value).over(W.partitionBy(obs))
    return counts.withColumn("expression", F.log1p(F.col(value) * 1e4 / F.greatest(total, F.lit(1.0))))


def feature_scores(counts: DataFrame, n_obs: int, gene: str = "gene", value: str = "value") -> DataFrame:
    """Per gene over all observations, zeros included: mean, variance (ddof 1), dispersion, share detected.

    A sparse table stores no zeros, so every mean divides by the number of observations.
    """
    s = counts.groupBy(gene).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(F.when(F.col(value) > 0, 1)).alias("k"))
    mean = F.col("s") / n_obs
    var = (F.col("q") - F.col("s") * F.col("s") / n_obs) / (n_obs - 1)
    return s.select(gene, mean.alias("mean"), var.alias("variance"), (var / F.greatest(mean, F.lit(1e-12))).alias("fano"), (F.col("k") / n_obs).alias("detected"))


def variable_genes(expression: DataFrame, n_obs: int, top: int = 256) -> DataFrame:
    """(gene, variance): the ``top`` genes of the largest population variance, zeros included, ties by name."""
    s = expression.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    var = F.greatest(F.col("q") / n_obs - F.pow(F.col("s") / n_obs, F.lit(2.0)), F.lit(0.0))
    return s.select("gene", var.alias("variance")).orderBy(F.desc("variance"), "gene").limit(max(8, top))


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows of the highest score, ties by name."""
    return df.orderBy(F.desc(score), tie).limit(k)
