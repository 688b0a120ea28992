"""A risk-controlled choice of method per dataset: nearest datasets vote, doubt lowers their vote, and a safe method stays where it is too low.

``features``: dataset, feature, value; ``scores``: dataset, method, overall, biology (every method on every dataset, the safe one among them);
``audit``: method, admissible, reliability (either may be null; a method without a row is reliable).  Datasets and methods are few, so
everything is joined and summed by Spark as plain rows: for each fold, a pair of datasets is a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators import pareto as P
from cohortframe.plans.tables import materialize


@dataclass(frozen=True)
class Policy:
    """Parameters of the choice."""

    anchor: str
    neighbors: int = 5
    utility_doubt: float = 0.60
    biology_doubt: float = 0.45
    biology_weight: float = 0.35
    floor: float = 0.70
    penalty: float = 0.20
    guardrail: float = -0.015
    thresholds: tuple[float, ...] = (-0.25, -0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20)


#: The grid of the coverage-risk sweep.
CONFIDENCE = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
MARGIN = (-0.10, -0.05, -0.02, 0.0)
OFFSET = (-0.10, -0.05, 0.0, 0.05, 0.10)


def reliabilities(scores: DataFrame, audit: DataFrame, policy: Policy) -> DataFrame:
    """(official, method, reliability): the methods that may be chosen, with the floor (official) and without; the anchor is none of them."""
    own = scores.where(F.col("method") != policy.anchor).select("method").distinct().join(audit, "method", "left")
    own = own.where(F.coalesce("admissible", F.lit(True))).select("method", F.coalesce(F.nanvl(F.col("reliability").cast("double"), F.lit(None)), F.lit(1.0)).alias("reliability"))
    both = own.withColumn("official", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.where(~F.col("official") | (F.col("reliability") >= policy.floor)).select("official", "method", "reliability")


def standardized(features: DataFrame, folds: DataFrame, never: Column | None = None) -> DataFrame:
    """(fold, dataset, feature, z) with the medians, means and deviations of the datasets a fold trains on; the left-out one is treated the same way.

    ``folds``: fold, and null for a model of all; datasets of which ``never`` holds are in no training.  What is missing takes the median; a deviation below 1e-8 counts as one.
    """
    value = F.col("value").cast("double")
    every = features.select("dataset", "feature", F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("x")).crossJoin(F.broadcast(folds))
    inside = (F.col("fold").isNull() | (F.col("dataset") != F.col("fold"))) & ~(F.lit(False) if never is None else never)
    mid = every.groupBy(F.col("fold").alias("f1"), F.col("feature").alias("f2")).agg(F.percentile(F.when(inside, F.col("x")), 0.5).alias("mid"))
    full = every.join(mid, F.col("fold").eqNullSafe(F.col("f1")) & (F.col("feature") == F.col("f2"))).select("fold", "dataset", "feature", F.coalesce("x", "mid").alias("x"))
    w = W.partitionBy("fold", "feature")
    use = F.when(inside, F.col("x"))
    sd = F.stddev_pop(use).over(w)
    return full.select("fold", "dataset", "feature", ((F.col("x") - F.avg(use).over(w)) / F.when(sd < 1e-8, 1.0).otherwise(sd)).alias("z"))


def votes(z: DataFrame, policy: Policy) -> DataFrame:
    """(fold, query, dataset, weight): the nearest training datasets of every dataset of a fold, itself excepted (ties by name), weighted by 1 / (distance + 1e-6)."""
    a, b = z.select("fold", F.col("dataset").alias("query"), "feature", F.col("z").alias("za")), z.select(F.col("fold").alias("f1"), "dataset", F.col("feature").alias("f2"), F.col("z").alias("zb"))
    b = b.where(F.col("f1").isNull() | (F.col("dataset") != F.col("f1")))
    pair = a.join(b, F.col("fold").eqNullSafe(F.col("f1")) & (F.col("feature") == F.col("f2")) & (F.col("query") != F.col("dataset")))
    far = pair.groupBy("fold", "query", "dataset").agg(F.sqrt(F.sum(F.pow(F.col("za") - F.col("zb"), F.lit(2.0)))).alias("far"))
    near = far.withColumn("place", F.row_number().over(W.partitionBy("fold", "query").orderBy("far", "dataset"))).where(F.col("place") <= policy.neighbors)
    w = 1.0 / (F.col("far") + 1e-6)
    return near.select("fold", "query", "dataset", (w / F.greatest(F.sum(w).over(W.partitionBy("fold", "query")), F.lit(1e-8))).alias("weight"))


def gains(scores: DataFrame, policy: Policy) -> DataFrame:
    """(dataset, method, overall, biology, du, db, anchor_overall, anchor_biology): scores beside the anchor's on the same dataset."""
    safe = scores.where(F.col("method") == policy.anchor).select("dataset", F.col("overall").cast("double").alias("anchor_overall"), F.col("biology").cast("double").alias("anchor_biology"))
    own = scores.select("dataset", "method", F.col("overall").cast("double").alias("overall"), F.col("biology").cast("double").alias("biology")).join(F.broadcast(safe), "dataset")
    return own.withColumns({"du": F.col("overall") - F.col("anchor_overall"), "db": F.col("biology") - F.col("anchor_biology")})


def proposals(near: DataFrame, gain: DataFrame, bank: DataFrame, policy: Policy) -> DataFrame:
    """The best method of the bank for each fold and query: its expected gains, their lower bounds and the route score.

    Equal route scores are told apart by the expected gains, then by name; route scores are rounded to twelve digits.
    """
    j = near.join(gain, "dataset").join(F.broadcast(bank), "method")
    w = F.col("weight")
    t = j.groupBy("official", "fold", "query", "method", "reliability").agg(
        F.sum(w * F.col("du")).alias("utility_mu"), F.sum(w * F.col("db")).alias("biology_mu"), F.sum(w).alias("w"), F.sum(w * F.col("du") * F.col("du")).alias("qu"), F.sum(w * F.col("db") * F.col("db")).alias("qb"),
    )

    def deviation(q: str, m: str) -> Column:
        # of weights that sum to one, but for rounding
        x = F.col(m)
        return F.sqrt(F.greatest(F.col(q) - 2.0 * x * x + F.col("w") * x * x, F.lit(0.0)))

    t = t.withColumns({"utility_std": deviation("qu", "utility_mu"), "biology_std": deviation("qb", "biology_mu")})
    t = t.withColumns({"utility_lcb": F.col("utility_mu") - policy.utility_doubt * F.col("utility_std"), "biology_lcb": F.col("biology_mu") - policy.biology_doubt * F.col("biology_std")})
    route = F.col("utility_lcb") + policy.biology_weight * F.col("biology_lcb") - policy.penalty * F.greatest(F.lit(0.0), 1.0 - F.col("reliability"))
    order = W.partitionBy("official", "fold", "query").orderBy(F.desc("route_score"), F.desc(F.round("utility_mu", 12)), F.desc(F.round("biology_mu", 12)), "method")
    best = t.withColumn("route_score", F.round(route, 12)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.drop("_r", "w", "qu", "qb").withColumnRenamed("method", "proposed_method")


def calibrated(best: DataFrame, gain: DataFrame, policy: Policy) -> DataFrame:
    """(official, fold, route_threshold): of the thresholds whose mean biology gain meets the guardrail (of all, if none does) the one with the best mean score.

    Each training dataset is judged by the others.  All thresholds come from one aggregation, as sums over the route scores beyond each;
    equal ones are told apart by the mean gains, by how near zero and by size.  Means are rounded to twelve digits.
    """
    own = best.where(F.col("fold").isNull() | (F.col("query") != F.col("fold"))).join(gain.withColumnRenamed("dataset", "query").withColumnRenamed("method", "proposed_method"), ["query", "proposed_method"])

    def mean(t: float, c: str, other: Column) -> Column:
        return F.round(F.avg(F.when(F.col("route_score") > t, F.col(c)).otherwise(other)), 12)

    zero = F.lit(0.0)
    tried = [F.struct((mean(t, "db", zero) >= policy.guardrail).alias("ok"), mean(t, "overall", F.col("anchor_overall")).alias("score"), mean(t, "du", zero).alias("du"), mean(t, "db", zero).alias("db"), F.lit(-abs(t)).alias("near"), F.lit(-t).alias("size")) for t in policy.thresholds]
    top = own.groupBy("official", "fold").agg(F.array_max(F.array(*tried)).alias("b"))
    return top.select("official", "fold", (-F.col("b.size")).alias("route_threshold"))


def held_out_decisions(features: DataFrame, scores: DataFrame, audit: DataFrame, policy: Policy) -> DataFrame:
    """Per bank (official or all) and dataset: the proposal and threshold of a policy that has not seen it, beside what its methods really score.

    A fold's means and deviations leave its dataset out.  ``best_single_method`` is the best on average over the training datasets,
    ``oracle_method`` the best on the dataset itself (ties by name).
    """
    folds = features.select(F.col("dataset").alias("fold")).distinct()
    bank, gain = materialize(reliabilities(scores, audit, policy), "bank"), materialize(gains(scores, policy), "gains")
    near = materialize(votes(standardized(features, folds), policy), "votes")
    best = materialize(proposals(near, gain, bank, policy), "proposals")
    held = best.where(F.col("query") == F.col("fold")).drop("query").join(calibrated(best, gain, policy), ["official", "fold"])
    real = gain.withColumnRenamed("dataset", "fold")
    out = held.join(real.withColumnRenamed("method", "proposed_method").withColumnRenamed("overall", "proposed_overall").withColumnRenamed("biology", "proposed_biology").drop("du", "db"), ["fold", "proposed_method"])
    among = gain.join(F.broadcast(bank), "method")
    total = among.groupBy("official", "method").agg(F.sum("overall").alias("s"), F.count("*").alias("n"))
    mean = among.join(total, ["official", "method"]).select("official", F.col("dataset").alias("fold"), "method", F.round((F.col("s") - F.col("overall")) / (F.col("n") - 1), 12).alias("m"), "overall")
    single = mean.groupBy("official", "fold").agg(F.min_by(F.struct("method", "overall"), F.struct(-F.col("m"), F.col("method"))).alias("a"), F.min_by(F.struct("method", "overall"), F.struct(-F.col("overall"), F.col("method"))).alias("b"))
    single = single.select("official", "fold", F.col("a.method").alias("best_single_method"), F.col("a.overall").alias("best_single_overall"), F.col("b.method").alias("oracle_method"), F.col("b.overall").alias("oracle_overall"))
    return out.join(single, ["official", "fold"])


def released(threshold: Column, confidence: Column, margin: Column) -> tuple[Column, Column]:
    """(released, confidence) of a proposal: its route score beyond the threshold, its confidence and its lower bound of biology high enough."""
    doubt = F.col("utility_std") + F.lit(Policy.biology_weight) * F.col("biology_std")
    sure = F.round(F.col("reliability") / (1.0 + F.exp(-6.0 * (F.col("route_score") - threshold - 0.5 * doubt))), 12)
    return (F.col("route_score") > threshold) & (sure >= confidence) & (F.round("biology_lcb", 12) >= margin), sure


def coverage_sweep(decisions: DataFrame) -> DataFrame:
    """A row per bank, least confidence, biology margin and threshold offset: what releasing under them gains and risks over all left-out datasets.

    Every decision meets the whole grid in one pass; the proposals do not depend on it.
    """
    grid = decisions.sparkSession.createDataFrame([(c, m, o) for c in CONFIDENCE for m in MARGIN for o in OFFSET], "confidence_threshold double, biology_margin double, route_threshold_offset double")
    go, _ = released(F.round(F.col("route_threshold") + F.col("route_threshold_offset"), 12), F.col("confidence_threshold"), F.col("biology_margin"))
    t = decisions.crossJoin(F.broadcast(grid)).withColumn("go", go)

    def chosen(c: str) -> Column:
        return F.when(F.col("go"), F.col(f"proposed_{c}")).otherwise(F.col(f"anchor_{c}"))

    score, biology = chosen("overall"), chosen("biology")
    return t.groupBy(F.col("official").alias("official_filter_on"), "confidence_threshold", "biology_margin", "route_threshold_offset").agg(
        F.avg(score).alias("mean_overall_score"), F.avg(biology).alias("mean_biology_proxy"), F.avg(score - F.col("anchor_overall")).alias("mean_delta_vs_anchor"), F.avg(score - F.col("best_single_overall")).alias("mean_delta_vs_best_single"),
        F.avg(F.col("oracle_overall") - score).alias("mean_regret_to_oracle_bank"), F.min(score - F.col("anchor_overall")).alias("worst_dataset_delta"), F.min(biology - F.col("anchor_biology")).alias("worst_case_biology_delta"),
        F.avg(F.col("go").cast("double")).alias("release_coverage"), F.sum(F.col("go").cast("int")).alias("override_count"), F.count("*").alias("dataset_count"),
    )


_GRID = ["official_filter_on", "confidence_threshold", "biology_margin", "route_threshold_offset"]


def sweet_spots(sweep: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` settings by gain, biology, coverage and regret among those without a mean loss and with a bounded worst case (of all, if none is such)."""
    fine = (F.col("mean_delta_vs_anchor") >= 0.0) & (F.col("worst_case_biology_delta") >= -0.06)
    marked = sweep.withColumn("_fine", fine).crossJoin(F.broadcast(sweep.agg(F.max(fine).alias("_any"))))
    worth = F.col("mean_delta_vs_anchor") + 0.35 * F.col("mean_biology_proxy") - 0.10 * F.col("release_coverage") - 0.25 * F.col("mean_regret_to_oracle_bank")
    out = marked.where("_fine or not _any").drop("_fine", "_any").withColumn("sweet_spot_score", F.round(worth, 12))
    return out.orderBy(F.desc("sweet_spot_score"), F.desc(F.round("mean_delta_vs_anchor", 12)), F.desc(F.round("mean_biology_proxy", 12)), *_GRID).limit(top)


def risk_frontier(sweep: DataFrame, digits: int = 12) -> DataFrame:
    """The settings that no other one beats in gain, worst case and coverage at once."""
    metrics = ["mean_delta_vs_anchor", "worst_case_biology_delta", "release_coverage"]
    named = sweep.withColumn("_key", F.concat_ws("|", *_GRID))
    rounded = named.select("_key", *[F.round(m, digits).alias(m) for m in metrics])
    return named.join(P.skyline(rounded, metrics, "_key"), "_key", "left_semi").drop("_key")


def fit(features: DataFrame, scores: DataFrame, audit: DataFrame, policy: Policy) -> dict:
    """A policy of all datasets, small enough for the driver: what :func:`predict` needs and JSON can hold."""
    spark = features.sparkSession
    none = spark.createDataFrame([(None,)], "fold string")
    bank, gain = materialize(reliabilities(scores, audit, policy).where("official"), "bank"), materialize(gains(scores, policy), "gains")
    best = proposals(votes(standardized(features, none), policy), gain, bank, policy)
    threshold = calibrated(best, gain, policy).first()
    plain = [[r.asDict() for r in t.collect()] for t in (features.select("dataset", "feature", F.col("value").cast("double").alias("value")), scores.select("dataset", "method", F.col("overall").cast("double").alias("overall"), F.col("biology").cast("double").alias("biology")), bank)]
    return {"policy": {**policy.__dict__, "thresholds": list(policy.thresholds)}, "route_threshold": threshold["route_threshold"] if threshold else 0.0, "features": plain[0], "scores": plain[1], "bank": plain[2]}


def predict(profiles: DataFrame, model: dict) -> DataFrame:
    """Per new dataset of ``profiles`` (dataset, feature, value): the method to take, the proposal, its figures and why.

    ``model`` is what :func:`fit` returns, also after a round trip through JSON.
    """
    spark = profiles.sparkSession
    policy = Policy(**{**model["policy"], "thresholds": tuple(model["policy"]["thresholds"])})
    known = spark.createDataFrame([(r["dataset"], r["feature"], r["value"]) for r in model["features"]], "dataset string, feature string, value double")
    scores = spark.createDataFrame([(r["dataset"], r["method"], r["overall"], r["biology"]) for r in model["scores"]], "dataset string, method string, overall double, biology double")
    bank = spark.createDataFrame([(r["official"], r["method"], r["reliability"]) for r in model["bank"]], "official boolean, method string, reliability double")
    new = profiles.select(F.concat(F.lit("new:"), F.col("dataset")).alias("dataset"), "feature", F.col("value").cast("double").alias("value"))
    wanted = new.select("dataset").distinct().crossJoin(F.broadcast(known.select("feature").distinct())).join(new, ["dataset", "feature"], "left")
    # each new dataset is the one its fold leaves out
    rows = known.unionByName(wanted)
    fresh = F.col("dataset").startswith("new:")
    z = standardized(rows, new.select(F.col("dataset").alias("fold")).distinct(), fresh).where(~fresh | (F.col("dataset") == F.col("fold")))
    best = proposals(votes(z, policy).where(F.col("query") == F.col("fold")), gains(scores, policy), bank, policy)
    limit = F.lit(float(model["route_threshold"]))
    _, sure = released(limit, F.lit(0.0), F.lit(0.0))
    go = F.col("route_score") > limit
    return best.select(
        F.substring("query", 5, 1 << 20).alias("dataset"), F.when(go, F.col("proposed_method")).otherwise(policy.anchor).alias("selected_method"), "proposed_method", (~go).alias("abstained"),
        F.when(go, "route_to_candidate").otherwise("abstain_to_safe_anchor").alias("decision_reason"), limit.alias("route_threshold"), "route_score", sure.alias("confidence"), "utility_mu", "utility_std", "utility_lcb", "biology_mu", "biology_std", "biology_lcb", "reliability",
    )

