"""Simulated replicates of a hierarchical design, and how well methods do on them."""

from __future__ import annotations

from itertools import product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.plans.ship import ship

FIELDS = ["n_case", "n_control", "n_motifs", "n_signal_motifs", "patches_per_sample", "spots_per_patch", "sample_random_effect_sd", "patch_random_effect_sd", "effect_size", "baseline_low", "baseline_high"]


def scenarios(spark: SparkSession, grid: dict[str, list[float]]) -> DataFrame:
    """Every combination of the parameter lists, numbered in order, with the design's labelings and least p."""
    rows = []
    for i, values in enumerate(product(*(grid[f] for f in FIELDS))):
        s = dict(zip(FIELDS, values, strict=True))
        n = comb(int(s["n_case"] + s["n_control"]), int(s["n_case"]))
        rows.append((f"scenario_{i:03d}", i, *map(float, values), float(n), 1.0 / n))
    return spark.createDataFrame(rows, "scenario_id string, scenario_index int, " + ", ".join(f"{f} double" for f in FIELDS) + ", total_labelings double, min_attainable_pvalue double")


def replicate(s, seed: int) -> pd.DataFrame:
    """One replicate: positive spots of each sample and motif.

    Prevalences are uniform; half of the signal motifs go up and half down on the logit scale; samples and patches add normal effects.
    """
    r = np.random.default_rng(seed)
    m, n = int(s.n_motifs), int(s.n_case + s.n_control)
    base = r.uniform(s.baseline_low, s.baseline_high, m).clip(1e-4, 1 - 1e-4)
    base, effect = np.log(base / (1 - base)), np.zeros(m)
    k = min(max(int(s.n_signal_motifs), 0), m) if s.effect_size else 0
    where = np.sort(r.choice(m, k, replace=False))
    sign = np.where(np.arange(k) < k // 2, 1, -1)
    r.shuffle(sign)
    effect[where] = sign * s.effect_size
    case = np.arange(n) >= int(s.n_control)
    draw = np.random.default_rng(seed)
    logits = base + effect * case[:, None, None] + draw.normal(0, s.sample_random_effect_sd, (n, 1, m)) + draw.normal(0, s.patch_random_effect_sd, (n, int(s.patches_per_sample), m))
    counts = draw.binomial(int(s.spots_per_patch), 1 / (1 + np.exp(-logits))).sum(1)
    at, motif = np.divmod(np.arange(n * m), m)
    return pd.DataFrame({"sample_id": [f"sample_{i:03d}" for i in at], "condition": np.where(case[at], "case", "control"), "motif_id": [f"motif_{j:03d}" for j in motif], "is_signal": effect[motif] != 0, "true_logit_effect": effect[motif], "motif_spots": counts.ravel(), "sample_spots": int(s.patches_per_sample * s.spots_per_patch)})


def simulate(table: DataFrame, replicates: int, seed: int = 7) -> DataFrame:
    """Long rows of all replicates of all scenarios; the seed of each is seed + 100000 * scenario + replicate, so tasks may run anywhere."""
    spark = table.sparkSession
    ship(spark)
    jobs = table.withColumn("replicate_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scenario_id", "replicate_id")

    def run(batches):
        for f in batches:
            for s in f.itertuples():
                yield replicate(s, seed + int(s.scenario_index) * 100_000 + int(s.replicate_id)).assign(scenario_id=s.scenario_id, replicate_id=s.replicate_id)

    return jobs.mapInPandas(run, "sample_id string, condition string, motif_id string, is_signal boolean, true_logit_effect double, motif_spots long, sample_spots long, scenario_id string, replicate_id int")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def summarize(results: DataFrame) -> DataFrame:
    """Per scenario and method: discoveries, false-discovery rate and power, as ratio of sums and as mean of replicates' ratios.

    ``results``: scenario_id, replicate_id, method, motif_id, is_signal, discovery, raw_call, pvalue.
    """

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    d, s, raw = F.col("discovery"), F.col("is_signal"), F.col("raw_call")
    rep = results.groupBy("scenario_id", "replicate_id", "method").agg(
        n(d).alias("d"), n(d & s).alias("tp"), n(s).alias("signals"), n(~s).alias("nulls"), n(raw).alias("raw"), n(raw & s).alias("raw_tp"),
        F.avg(F.when(s, F.col("pvalue"))).alias("signal_p"), F.avg(F.when(~s, F.col("pvalue"))).alias("null_p"),
    )
    rep = rep.withColumn("fdr", _ratio(F.col("d") - F.col("tp"), F.col("d"))).withColumn("power", F.when(F.col("signals") > 0, F.col("tp") / F.col("signals")))
    t = {c: F.sum(c) for c in ("d", "tp", "signals", "nulls", "raw", "raw_tp")}
    return rep.groupBy("scenario_id", "method").agg(
        F.count("*").alias("n_replicates"), F.avg("d").alias("mean_discoveries"), F.avg("tp").alias("mean_true_positives"), _ratio(t["d"] - t["tp"], t["d"]).alias("empirical_fdr"),
        F.when(t["signals"] > 0, _ratio(t["tp"], t["signals"])).alias("empirical_power"), F.when(t["nulls"] > 0, (t["d"] - t["tp"]) / t["nulls"]).alias("null_rejection_rate"), F.avg("fdr").alias("mean_replicate_fdr"), F.avg("power").alias("mean_replicate_power"),
        _ratio(t["raw"] - t["raw_tp"], t["raw"]).alias("raw_empirical_fdr"), F.avg("signal_p").alias("signal_mean_pvalue"), F.avg("null_p").alias("null_mean_pvalue"),
    )
