"""Feature-variability scores over sparse counts (obs, gene, value); zeros are not stored but count."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators.vectors import log_cp10k
from cohortframe.plans.tables import materialize


def z_all(c: Column) -> Column:
    """Centred and scaled over all rows (population deviation); zeros if that is below 1e-8."""
    w = W.partitionBy(F.lit(0))
    sd = F.stddev_pop(c).over(w)
    return F.when(sd < 1e-8, 0.0).otherwise((c - F.avg(c).over(w)) / sd)


def _det(a, b, c):
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = a, b, c
    return a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)


def quadratic_fit(t: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """``t`` with ``out``: the value at x of the least-squares parabola of y on x.  ``t`` has one row per gene."""
    t = t.withColumn("_x", F.col(x) - F.avg(x).over(W.partitionBy(F.lit(0))))
    sums = t.agg(*[F.sum(F.pow("_x", F.lit(float(i)))).alias(f"s{i}") for i in range(5)], *[F.sum(F.pow("_x", F.lit(float(i))) * F.col(y)).alias(f"t{i}") for i in range(3)])
    s, v = [F.col(f"s{i}") for i in range(5)], [F.col(f"t{i}") for i in range(3)]
    rows = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    whole, fit = _det(*rows), []
    for j in range(3):
        part = [list(r) for r in rows]
        for i in range(3):
            part[i][j] = v[i]
        fit.append((_det(*part) / F.when(F.abs(whole) > 0, whole)).alias(f"_b{j}"))
    t = t.crossJoin(F.broadcast(sums.select(*fit)))
    return t.withColumn(out, F.col("_b0") + F.col("_b1") * F.col("_x") + F.col("_b2") * F.col("_x") * F.col("_x")).drop("_x", "_b0", "_b1", "_b2")


def log_moments(counts: DataFrame, n_obs: int) -> DataFrame:
    """(gene, mean, variance) of log expression over all observations, zeros included (population variance)."""
    s = log_cp10k(counts).groupBy("gene").agg(F.sum("expression").alias("s"), F.sum(F.col("expression") * F.col("expression")).alias("q"))
    mean = F.col("s") / n_obs
    return s.select("gene", mean.alias("mean"), F.greatest(F.col("q") / n_obs - mean * mean, F.lit(0.0)).alias("variance"))


def base_scores(counts: DataFrame, n_obs: int) -> DataFrame:
    """Per gene, from log expression: z of the variance, of the variance over the mean, and of what a parabola leaves of log1p variance on log1p mean.

    One row per gene is left after the first aggregation, so the windows over all genes are small.
    """
    t = log_moments(counts, n_obs).withColumn("x", F.log1p("mean")).withColumn("y", F.log1p("variance"))
    t = quadratic_fit(t, "x", "y", "fit")
    return t.select("gene", z_all(F.col("variance")).alias("variance_score"), z_all(F.col("variance") / F.greatest("mean", F.lit(1e-6))).alias("fano_score"), z_all(F.col("y") - F.col("fit")).alias("mv_residual"))


def scran_scores(counts: DataFrame, n_obs: int, window: int | None = None) -> DataFrame:
    """Per gene: z of log variance less a moving average of it in order of log mean, its ends padded by the end values.

    Fewer than eight genes take the residual of :func:`base_scores`, a window of three the parabola.
    """
    t = log_moments(counts, n_obs).withColumn("x", F.log1p(F.greatest("mean", F.lit(1e-8)))).withColumn("y", F.log1p(F.greatest("variance", F.lit(1e-8))))
    n = t.count()
    if n < 8:
        return base_scores(counts, n_obs).select("gene", F.col("mv_residual").alias("scran_score"))
    window = window or max(11, min(301, -(-n // 20)))
    window += window % 2 == 0
    window = max(3, min(window, n if n % 2 else max(n - 1, 3)))
    if window <= 3:
        return quadratic_fit(t, "x", "y", "fit").select("gene", z_all(F.col("y") - F.col("fit")).alias("scran_score"))
    pad, order = window // 2, W.orderBy("x", "gene")
    place = F.row_number().over(order)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left, right = F.greatest(F.lit(pad) - place + 1, F.lit(0)), F.greatest(place + pad - n, F.lit(0))
    smooth = (F.sum("y").over(order.rowsBetween(-pad, pad)) + left * F.first("y").over(every) + right * F.last("y").over(every)) / window
    return t.withColumn("d", F.col("y") - smooth).select("gene", z_all(F.col("d")).alias("scran_score"))


def pearson_scores(counts: DataFrame, n_obs: int, theta: float = 100.0, clip: float | None = None) -> DataFrame:
    """Per gene: z of the variance of clipped Pearson residuals under a negative binomial of overdispersion ``theta``.

    Zeros are not stored: the residual of a zero depends on the observation's total and the gene's only, so all zeros are summed over
    distinct totals, and stored values correct those sums.  ``n_obs`` is the number of distinct observations of ``counts``.
    """
    clip = float(clip if clip is not None else n_obs**0.5)
    obs = counts.groupBy("obs").agg(F.sum("value").alias("r"))
    genes = counts.groupBy("gene").agg(F.sum("value").alias("g"))
    total = F.broadcast(genes.agg(F.greatest(F.sum("g"), F.lit(1.0)).alias("t")))

    def residual(value: Column) -> Column:
        e = F.col("r") * F.col("g") / F.col("t")
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), (value - e) / F.greatest(F.sqrt(e + e * e / theta), F.lit(1e-6))))

    # genes are a bounded list; observations come as a histogram of totals
    base = obs.groupBy("r").agg(F.count("*").alias("n")).crossJoin(F.broadcast(genes)).crossJoin(total).withColumn("z", residual(F.lit(0.0)))
    base = base.groupBy("gene").agg(F.sum(F.col("n") * F.col("z")).alias("s"), F.sum(F.col("n") * F.col("z") * F.col("z")).alias("q"))
    rows = counts.join(obs, "obs").join(F.broadcast(genes), "gene").crossJoin(total).withColumn("z", residual(F.lit(0.0))).withColumn("v", residual(F.col("value")))
    rows = rows.groupBy("gene").agg(F.sum(F.col("v") - F.col("z")).alias("ds"), F.sum(F.col("v") * F.col("v") - F.col("z") * F.col("z")).alias("dq"))
    both = base.join(rows, "gene").withColumn("m", (F.col("s") + F.col("ds")) / n_obs)
    return both.withColumn("v", (F.col("q") + F.col("dq")) / n_obs - F.col("m") * F.col("m")).select("gene", F.col("v").alias("residual_variance"), z_all(F.col("v")).alias("pearson_score"))


def seurat_scores(counts: DataFrame, n_obs: int, clip: float | None = None) -> DataFrame:
    """Per gene: z of the variance of counts standardised by a parabola of log variance on log mean, clipped at ``clip`` deviations."""
    clip = float(clip if clip is not None else n_obs**0.5)
    m = counts.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").alias("k"))
    mean = F.col("s") / n_obs
    m = m.withColumn("mean", mean).withColumn("x", F.log10(F.greatest(mean, F.lit(1e-6)))).withColumn("y", F.log10(F.greatest(F.col("q") / n_obs - mean * mean, F.lit(1e-6))))
    m = quadratic_fit(m, "x", "y", "fit").withColumn("sd", F.sqrt(F.greatest(F.pow(F.lit(10.0), "fit"), F.lit(1e-6)))).select("gene", "mean", "sd", "k")

    def z(value: Column) -> Column:
        limit = F.greatest(F.col("sd") * clip, F.lit(1e-6))
        return F.greatest(-limit, F.least(limit, value - F.col("mean"))) / F.greatest("sd", F.lit(1e-6))

    rows = counts.join(F.broadcast(m), "gene").groupBy("gene", "mean", "sd", "k").agg(F.sum(z(F.col("value"))).alias("s"), F.sum(z(F.col("value")) * z(F.col("value"))).alias("q"))
    zero, none = z(F.lit(0.0)), F.lit(n_obs) - F.col("k")
    rows = rows.withColumn("m", (F.col("s") + none * zero) / n_obs).withColumn("v", (F.col("q") + none * zero * zero) / n_obs - F.col("m") * F.col("m"))
    return rows.select("gene", F.col("v").alias("standardized_variance"), z_all(F.col("v")).alias("seurat_score"))


def deviance_scores(counts: DataFrame) -> DataFrame:
    """Per gene: z of the binomial deviance of its counts from a constant share of every observation's total.

    A zero adds a multiple of the observation's total, so all zeros follow from one sum.
    """
    obs = counts.groupBy("obs").agg(F.sum("value").alias("r"))
    genes = counts.groupBy("gene").agg(F.sum("value").alias("g"))
    total = F.broadcast(genes.agg(F.greatest(F.sum("g"), F.lit(1.0)).alias("t"), F.sum("g").alias("all")))
    rows = counts.join(obs, "obs").join(F.broadcast(genes), "gene").crossJoin(total)
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1.0 - 1e-6), F.col("g") / F.col("t")))
    rest = F.greatest(F.col("r") - F.col("value"), F.lit(0.0))
    floor = F.lit(1e-6)
    one = F.when(F.col("value") > 0, F.col("value") * F.ln(F.greatest("value", floor) / F.greatest(F.col("r") * p, floor))).otherwise(0.0)
    two = F.when(rest > 0, rest * F.ln(F.greatest(rest, floor) / F.greatest(F.col("r") * F.greatest(1.0 - p, floor), floor))).otherwise(0.0)
    rows = rows.groupBy("gene", "g", "t", "all").agg(F.sum(2.0 * (one + two)).alias("d"), F.sum("r").alias("seen"))
    zeros = -2.0 * F.ln(F.greatest(1.0 - p, floor)) * (F.col("all") - F.col("seen"))
    return rows.withColumn("d", F.col("d") + zeros).select("gene", F.col("d").alias("deviance"), z_all(F.col("d")).alias("deviance_score"))


# --- how good a selection is ------------------------------------------------------------------


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and mutual information normalised by the mean entropy, of two labelings of the rows."""
    t = contingency(df, a, b)
    whole = F.broadcast(t.agg(F.sum("n").alias("all")))
    pairs = lambda c: c * (c - 1) / 2

    def side(k: str) -> DataFrame:
        s = t.groupBy(k).agg(F.sum("n").alias("m")).crossJoin(whole)
        return s.agg(F.sum(pairs(F.col("m"))).alias(f"pairs_{k}"), F.sum(-F.col("m") / F.col("all") * F.ln(F.col("m") / F.col("all"))).alias(f"h_{k}"))

    ma, mb = (t.groupBy(k).agg(F.sum("n").alias(f"m{k}")) for k in "ab")
    joint = t.join(ma, "a").join(mb, "b").crossJoin(whole)
    joint = joint.agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("ma") * F.col("mb")))).alias("mi"), F.max("all").alias("all"))
    r = joint.crossJoin(side("a")).crossJoin(side("b"))
    expected, most = F.col("pairs_a") * F.col("pairs_b") / F.greatest(pairs(F.col("all")), F.lit(1.0)), (F.col("pairs_a") + F.col("pairs_b")) / 2
    ari = F.when(F.abs(most - expected) <= 1e-12, 1.0).otherwise((F.col("same") - expected) / (most - expected))
    h = (F.col("h_a") + F.col("h_b")) / 2
    return r.select(ari.alias("ari"), F.when(h <= 1e-12, 1.0).otherwise(F.greatest("mi", F.lit(0.0)) / h).alias("nmi"))


def set_jaccard(a: DataFrame, b: DataFrame, key: str = "gene") -> DataFrame:
    """One row: the similarity of two sets of keys."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full_outer").agg((F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.greatest(F.count("*"), F.lit(1))).alias("jaccard"))


def selection_stability(counts: DataFrame, scorer: Callable[[DataFrame, int], DataFrame], score: str, k: int, draws: int = 5, seed: int = 0) -> DataFrame:
    """One row: the mean similarity of the ``k`` best genes over all pairs of bootstrap draws of the observations.

    ``scorer`` takes (counts, number of observations) and gives ``score`` per gene.  An observation's multiplicity in a
    draw is Poisson with mean one, from a hash, which is the bootstrap of a large table without moving rows.
    """
    step = [exp(-1.0) / factorial(i) for i in range(9)]
    cuts = [sum(step[: i + 1]) for i in range(9)]
    picked = None
    for d in range(draws):
        u = F.pmod(F.xxhash64("obs", F.lit(seed), F.lit(d)), F.lit(1 << 40)) / float(1 << 40)
        times = sum(F.when(u >= c, 1).otherwise(0) for c in cuts)
        drawn = counts.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).withColumn("obs", F.struct("obs", "copy")).drop("copy")
        drawn = materialize(drawn, "draw")
        best = scorer(drawn, drawn.select("obs").distinct().count()).orderBy(F.desc(score), "gene").limit(k).select("gene", F.lit(d).alias("draw"))
        picked = best if picked is None else picked.unionByName(best)
    picked = materialize(picked, "selections")
    other = picked.select("gene", F.col("draw").alias("second"))
    shared = picked.join(other, "gene").where("draw < second").groupBy("draw", "second").agg(F.count("*").alias("n"))
    sizes = picked.groupBy("draw").agg(F.count("*").alias("m"))
    pairs = sizes.join(sizes.select(F.col("draw").alias("second"), F.col("m").alias("m2")), F.col("draw") < F.col("second")).join(shared, ["draw", "second"], "left").fillna(0, ["n"])
    return pairs.agg(F.avg(F.col("n") / F.greatest(F.col("m") + F.col("m2") - F.col("n"), F.lit(1))).alias("stability"))


def percentile_rank(value: str, tie: str) -> Column:
    """(i + 0.5) / n in order of the value, ties in order of ``tie``."""
    return (F.row_number().over(W.orderBy(value, tie)) - 0.5) / F.count("*").over(W.partitionBy(F.lit(0)))


def average_rank(value: str) -> Column:
    """Ranks from 1 with ties shared."""
    return F.rank().over(W.orderBy(value)) + (F.count("*").over(W.partitionBy(value)) - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of average ranks."""
    return df.select(average_rank(a).alias("a"), average_rank(b).alias("b")).agg(F.corr("a", "b").alias("spearman"))
