"""Tests that need tail probabilities or iteration: one Arrow call per group of motifs, on sample-level rows only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.functions import special
from cohortframe.operators import testing as T
from cohortframe.plans.ship import ship

_KEY = ["dataset_id", "motif_id"]


def ols_hc3_test(values: DataFrame) -> DataFrame:
    """:func:`testing.ols_hc3` with the two-sided p of its t; without error, p is 0 or 1 by the effect."""
    ship(values.sparkSession)

    @F.pandas_udf("double")
    def p(effect: pd.Series, se: pd.Series, t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([special.t_two_sided(c, d) if s > 1e-12 else float(abs(e) <= 1e-12) for e, s, c, d in zip(effect, se, t, df)])

    return T.ols_hc3(values).withColumn("pvalue", p("effect_estimate", "standard_error", "t_statistic", "df"))


def fisher_test(abundance: DataFrame) -> DataFrame:
    """Pooled spot counts with Fisher's two-sided p and its mid-p."""
    ship(abundance.sparkSession)

    def run(batches):
        for f in batches:
            table = list(zip(f.case_in, f.case_all - f.case_in, f.ref_in, f.ref_all - f.ref_in))
            yield f.assign(pvalue=[special.fisher_exact(t) for t in table], pvalue_midp=[special.fisher_mid(t) for t in table])

    rows = T.naive_contingency(abundance)
    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", pvalue double, pvalue_midp double")


def quasi_binomial(counts: np.ndarray, totals: np.ndarray, case: np.ndarray) -> tuple[float, float, float]:
    """Effect on the probability scale, p and dispersion of a two-group logistic fit with free dispersion.

    With two groups the fitted probabilities are the pooled ones; logits are kept within 12 of zero.
    """
    ok = totals > 0
    counts, totals, case = counts[ok].astype(float), totals[ok].astype(float), case[ok]
    if not case.any() or case.all():
        return np.nan, np.nan, np.nan

    def logit(side: np.ndarray) -> float:
        p = np.clip(counts[side].sum() / totals[side].sum(), 1e-300, 1 - 1e-16)
        return float(np.log(p / (1 - p)))

    b0 = float(np.clip(logit(~case), -12, 12))
    b1 = float(np.clip(logit(case) - b0, -12, 12))
    mu = np.clip(1 / (1 + np.exp(-(b0 + b1 * case))), 1e-6, 1 - 1e-6)
    var = np.maximum(mu * (1 - mu), 1e-6)
    weight = np.maximum(totals * var, 1e-8)
    df = max(len(counts) - 2, 1)
    dispersion = max(float(((counts - totals * mu) ** 2 / weight).sum()) / df, 1e-8)
    se = np.sqrt(dispersion * (1 / weight[case].sum() + 1 / weight[~case].sum()))
    p = special.t_two_sided(b1 / se, df) if se > 1e-12 else float(abs(b1) <= 1e-12)
    return float(1 / (1 + np.exp(-(b0 + b1))) - 1 / (1 + np.exp(-b0))), p, dispersion


def bootstrap_interval(ref: np.ndarray, case: np.ndarray, draws: int = 2000, seed: int = 7) -> tuple[float, float]:
    """The 2.5 and 97.5 percent points of the difference of means under resampling of both sides."""
    r = np.random.default_rng(seed)
    d = case[r.integers(0, len(case), (draws, len(case)))].mean(1) - ref[r.integers(0, len(ref), (draws, len(ref)))].mean(1)
    return float(np.quantile(d, 0.025)), float(np.quantile(d, 0.975))


def quasi_binomial_test(abundance: DataFrame) -> DataFrame:
    """Per motif: effect, p and dispersion from its samples' counts."""
    ship(abundance.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        e, p, d = quasi_binomial(f.motif_spots.to_numpy(), f.sample_spots.to_numpy(), (f.condition == f.condition_b).to_numpy())
        return pd.DataFrame({"dataset_id": [f.dataset_id.iloc[0]], "motif_id": [f.motif_id.iloc[0]], "effect_estimate": [e], "pvalue": [p], "dispersion": [d]})

    rows = abundance.join(T.condition_order(abundance), "dataset_id").select(*_KEY, "condition", "condition_b", "motif_spots", "sample_spots")
    return rows.groupBy(*_KEY).applyInPandas(run, "dataset_id string, motif_id string, effect_estimate double, pvalue double, dispersion double")


def bootstrap_test(values: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Per motif: the bootstrap interval of its effect, the same seed for each."""
    ship(values.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("sample_id")
        case = (f.condition == f.condition_b).to_numpy()
        low, high = bootstrap_interval(f.value.to_numpy()[~case], f.value.to_numpy()[case], draws, seed)
        return pd.DataFrame({"dataset_id": [f.dataset_id.iloc[0]], "motif_id": [f.motif_id.iloc[0]], "ci_low": [low], "ci_high": [high]})

    rows = values.join(T.condition_order(values), "dataset_id").select(*_KEY, "sample_id", "condition", "condition_b", "value")
    return rows.groupBy(*_KEY).applyInPandas(run, "dataset_id string, motif_id string, ci_low double, ci_high double")
