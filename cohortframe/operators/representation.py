"""How well an embedding keeps motifs, conditions and neighbours.

``rows``: obs_id, sample_id, condition, motif_id, vector array<double>.  Means are taken element by element after
``posexplode``, so they combine on the map side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators.vectors import squared_distance


def mean_vectors(rows: DataFrame, *by: str, out: str = "center") -> DataFrame:
    """The mean vector of each group."""
    each = rows.select(*by, F.posexplode("vector").alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg("_v").alias("_m"))
    if by:
        return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(n > 0, n)


def motif_stability(rows: DataFrame, least: int = 25) -> DataFrame:
    """(sample_id, motif_id, n, stability): cosine of a motif's mean in a sample and over all, groups of ``least`` rows or more."""
    n = rows.groupBy("sample_id", "motif_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = n.join(mean_vectors(rows, "sample_id", "motif_id"), ["sample_id", "motif_id"])
    return own.join(mean_vectors(rows, "motif_id", out="all"), "motif_id").select("sample_id", "motif_id", "n", cosine(F.col("center"), F.col("all")).alias("stability"))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(squared_distance(F.col(a), F.col(b)))


def condition_separability(rows: DataFrame) -> DataFrame:
    """One row: between / (between + within + 1e-6), null unless there are two conditions or more.

    within: the mean distance of samples' means to their condition's mean; between: the mean distance of all pairs of
    conditions' means.
    """
    s = mean_vectors(rows, "sample_id", "condition").withColumnRenamed("center", "vector")
    c = mean_vectors(s, "condition")
    within = s.join(c, "condition").agg(F.avg(_distance("vector", "center")).alias("within"))
    pairs = c.join(c.select(F.col("condition").alias("other"), F.col("center").alias("second")), F.col("condition") < F.col("other"))
    between = pairs.agg(F.avg(_distance("center", "second")).alias("between"))
    ratio = F.col("between") / (F.col("between") + F.col("within") + 1e-6)
    return within.crossJoin(between).select(F.when(F.col("between").isNotNull(), F.col("within")).alias("within"), "between", ratio.alias("separability"))


def sample_leakage(rows: DataFrame) -> DataFrame:
    """One row: the samples' mean distance to their condition's mean over that to the mean of all samples; null for one sample."""
    s = mean_vectors(rows, "sample_id", "condition").withColumnRenamed("center", "vector")
    out = s.join(mean_vectors(s, "condition"), "condition").crossJoin(F.broadcast(mean_vectors(s, out="all")))
    out = out.agg(F.count("*").alias("n"), F.avg(_distance("vector", "center")).alias("own"), F.avg(_distance("vector", "all")).alias("every"))
    return out.select(F.when(F.col("n") > 1, F.col("own") / (F.col("every") + 1e-6)).alias("leakage"))


def _unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-8)))


def spatial_smoothness(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean cosine of each unit vector and the weighted mean of its neighbours' unit vectors.

    ``edges``: src, dst, weight.  A row without neighbours counts as zero.
    """
    unit = rows.select("obs_id", _unit(F.col("vector")).alias("u"))
    parts = edges.join(unit.withColumnRenamed("obs_id", "dst"), "dst").select("src", "weight", F.posexplode("u").alias("i", "v"))
    near = parts.groupBy("src", "i").agg(F.sum(F.col("weight") * F.col("v")).alias("v")).groupBy(F.col("src").alias("obs_id"))
    near = near.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
    both = unit.join(near, "obs_id", "left")
    return both.agg(F.avg(F.coalesce(dot(F.col("u"), _unit(F.col("m"))), F.lit(0.0))).alias("smoothness"))


def ranked_motifs(abundance: DataFrame, condition_a: str, condition_b: str, weight: str | None = None) -> DataFrame:
    """(motif_id, delta, position): weighted mean fractions of condition b less those of a, largest change first (ties: the larger delta, then id)."""
    w = F.col(weight) if weight else F.lit(1.0)

    def mean(c: str) -> Column:
        own = F.col("condition") == c
        return F.coalesce(F.sum(F.when(own, w * F.col("motif_fraction"))) / F.sum(F.when(own, w)), F.lit(0.0))

    out = abundance.groupBy("motif_id").agg((mean(condition_b) - mean(condition_a)).alias("delta"))
    order = W.orderBy(F.desc(F.abs("delta")), F.desc("delta"), "motif_id")  # one row per motif
    return out.withColumn("position", F.row_number().over(order))


def reproducibility(abundance: DataFrame, seed: int = 7, draws: int = 128) -> DataFrame:
    """One row: the mean Jaccard similarity of the leading motifs of all samples and of samples drawn again within conditions.

    The draws are weights per sample, joined to the abundance table; all of them are ranked in one pass.  Null unless
    there are two conditions.
    """
    spark = abundance.sparkSession
    meta = [(r["sample_id"], r["condition"]) for r in abundance.select("sample_id", "condition").distinct().orderBy("condition", "sample_id").collect()]
    names = sorted({c for _, c in meta})
    if len(names) != 2:
        return spark.createDataFrame([(None,)], "reproducibility double")
    a, b = names
    k = max(2, min(4, abundance.select("motif_id").distinct().count() // 2))
    r, rows = np.random.default_rng(seed), []
    for d in range(draws):
        for c in names:
            own = [s for s, x in meta if x == c]
            picked, times = np.unique(r.choice(len(own), len(own)), return_counts=True)
            rows += [(d, own[i], float(t)) for i, t in zip(picked.tolist(), times.tolist(), strict=True)]
    weights = spark.createDataFrame(rows, "draw int, sample_id string, weight double")
    drawn = abundance.select(F.col("sample_id").cast("string"), "condition", "motif_id", "motif_fraction").join(F.broadcast(weights), "sample_id")

    def mean(c: str) -> Column:
        own = F.col("condition") == c
        return F.coalesce(F.sum(F.when(own, F.col("weight") * F.col("motif_fraction"))) / F.sum(F.when(own, F.col("weight"))), F.lit(0.0))

    delta = drawn.groupBy("draw", "motif_id").agg((mean(b) - mean(a)).alias("delta"))
    place = F.row_number().over(W.partitionBy("draw").orderBy(F.desc(F.abs("delta")), F.desc("delta"), "motif_id"))
    top = delta.withColumn("place", place).where(F.col("place") <= k)
    whole = ranked_motifs(abundance, a, b).where(F.col("position") <= k).select("motif_id", F.lit(1).alias("hit"))
    shared = top.join(F.broadcast(whole), "motif_id", "left").groupBy("draw").agg(F.count("hit").alias("both"), F.count("*").alias("n"))
    return shared.crossJoin(F.broadcast(whole.agg(F.count("*").alias("m")))).agg(F.avg(F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("reproducibility"))
