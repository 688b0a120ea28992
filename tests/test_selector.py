"""The selector against a plain version that goes through folds, queries and thresholds one by one."""

import json
import math

import numpy as np
import pytest

from cohortframe.operators import selector as S

POLICY = S.Policy(anchor="safe", neighbors=3)


def data(seed, datasets=9):
    r = np.random.default_rng(seed)
    names = [f"d{i}" for i in range(datasets)]
    features = {(d, f): float(r.normal()) for d in names for f in ("a", "b", "c")}
    features[names[1], "b"] = None
    features[names[2], "a"] = float("nan")
    for d in names:
        features[d, "flat"] = 2.0
    scores = {(d, m): (float(r.normal(0, 0.3)), float(r.normal(0, 0.2))) for d in names for m in ("safe", "m1", "m2", "m3", "m4")}
    audit = [("m1", True, 0.9), ("m2", None, 0.5), ("m3", False, 1.0)]
    return names, features, scores, audit


def tables(spark, features, scores, audit):
    return (
        spark.createDataFrame([(d, f, x) for (d, f), x in features.items()], "dataset string, feature string, value double"),
        spark.createDataFrame([(d, m, *x) for (d, m), x in scores.items()], "dataset string, method string, overall double, biology double"),
        spark.createDataFrame(audit, "method string, admissible boolean, reliability double"),
    )


def profile(features, train, d, f):
    """Standardised by the training datasets."""
    clean = {t: features[t, f] for t in train}
    got = [x for x in clean.values() if x is not None and math.isfinite(x)]
    mid = float(np.median(got))
    filled = [x if x is not None and math.isfinite(x) else mid for x in clean.values()]
    sd = float(np.std(filled))
    x = features[d, f]
    x = x if x is not None and math.isfinite(x) else mid
    return (x - float(np.mean(filled))) / (1.0 if sd < 1e-8 else sd)


def propose(features, scores, bank, train, among, q):
    names = sorted({f for _, f in features})
    far = sorted((math.dist([profile(features, train, q, f) for f in names], [profile(features, train, d, f) for f in names]), d) for d in among)[:3]
    w = np.array([1 / (x + 1e-6) for x, _ in far])
    w /= w.sum()
    best = None
    for m, rel in sorted(bank.items()):
        du, db = (np.array([scores[d, m][i] - scores[d, "safe"][i] for _, d in far]) for i in (0, 1))
        mu, mb = w @ du, w @ db
        su, sb = np.sqrt(w @ (du - mu) ** 2), np.sqrt(w @ (db - mb) ** 2)
        route = mu - 0.6 * su + 0.35 * (mb - 0.45 * sb) - 0.2 * max(0, 1 - rel)
        if best is None or route > best[1]:
            best = m, route, mu, su, mb, sb, rel
    return best


def calibrate(features, scores, bank, train):
    stats = []
    for t in POLICY.thresholds:
        s, u, b = [], [], []
        for q in train:
            m, route, *_ = propose(features, scores, bank, train, [d for d in train if d != q], q)
            m = m if route > t else "safe"
            s.append(scores[q, m][0])
            u.append(scores[q, m][0] - scores[q, "safe"][0])
            b.append(scores[q, m][1] - scores[q, "safe"][1])
        stats.append((round(np.mean(s), 11), round(np.mean(u), 11), round(np.mean(b), 11), -abs(t), -t))
    fine = [x for x in stats if x[2] >= POLICY.guardrail] or stats
    return -max(fine)[4]


BANKS = {True: {"m1": 0.9, "m4": 1.0}, False: {"m1": 0.9, "m2": 0.5, "m4": 1.0}}


@pytest.mark.parametrize("seed", [0, 1])
def test_decisions_and_sweep(spark, seed):
    names, features, scores, audit = data(seed)
    decided = S.held_out_decisions(*tables(spark, features, scores, audit), POLICY)
    got = {(r["official"], r["fold"]): r for r in decided.collect()}
    assert len(got) == 18
    for official, bank in BANKS.items():
        for h in names:
            train = [d for d in names if d != h]
            m, route, mu, su, mb, sb, rel = propose(features, scores, bank, train, train, h)
            r = got[official, h]
            assert r["proposed_method"] == m and np.allclose([r["route_score"], r["utility_mu"], r["utility_std"], r["biology_mu"], r["biology_std"]], [route, mu, su, mb, sb], atol=1e-9)
            assert r["route_threshold"] == calibrate(features, scores, bank, train)
            assert r["best_single_method"] == max(bank, key=lambda m: np.mean([scores[d, m][0] for d in train])) and r["oracle_method"] == max(bank, key=lambda m: scores[h, m][0])
    sweep = S.coverage_sweep(decided)
    rows = sweep.collect()
    assert len(rows) == 240
    for r in rows[:: 7]:
        out = []
        for h in names:
            d = got[r["official_filter_on"], h]
            t = d["route_threshold"] + r["route_threshold_offset"]
            sure = d["reliability"] / (1 + math.exp(-6 * (d["route_score"] - t - 0.5 * (d["utility_std"] + 0.35 * d["biology_std"]))))
            go = d["route_score"] > t + 1e-12 and sure >= r["confidence_threshold"] and d["biology_lcb"] >= r["biology_margin"]
            s = scores[h, d["proposed_method"] if go else "safe"]
            out.append((go, s[0] - scores[h, "safe"][0], s[1] - scores[h, "safe"][1], d["oracle_overall"] - s[0], s[0] - d["best_single_overall"]))
        x = np.array(out, float)
        assert np.allclose([r["release_coverage"], r["mean_delta_vs_anchor"], r["worst_case_biology_delta"], r["mean_regret_to_oracle_bank"], r["mean_delta_vs_best_single"]], [x[:, 0].mean(), x[:, 1].mean(), x[:, 2].min(), x[:, 3].mean(), x[:, 4].mean()], atol=1e-9)
    spots = S.sweet_spots(sweep).collect()
    fine = [r for r in rows if r["mean_delta_vs_anchor"] >= 0 and r["worst_case_biology_delta"] >= -0.06] or rows
    worth = sorted((r["mean_delta_vs_anchor"] + 0.35 * r["mean_biology_proxy"] - 0.1 * r["release_coverage"] - 0.25 * r["mean_regret_to_oracle_bank"] for r in fine), reverse=True)
    assert np.allclose([r["sweet_spot_score"] for r in spots], worth[:10], atol=1e-9)
    keys = ["mean_delta_vs_anchor", "worst_case_biology_delta", "release_coverage"]
    x = np.round(np.array([[r[k] for k in keys] for r in rows]), 12)
    want = sum(not (((x >= v).all(1)) & ((x > v).any(1))).any() for v in x)
    assert S.risk_frontier(sweep).count() == want


def test_model_round_trip(spark):
    """A golden choice: a new dataset that lies on d0 follows the method that wins there and around it."""
    names, features, scores, audit = data(3)
    for d in names:
        scores[d, "m4"] = (scores[d, "safe"][0] + 0.5, scores[d, "safe"][1] + 0.1)
    f, s, a = tables(spark, features, scores, audit)
    model = json.loads(json.dumps(S.fit(f, s, a, POLICY)))
    assert model["route_threshold"] == calibrate(features, scores, BANKS[True], names) == 0.0
    new = spark.createDataFrame([("n1", k, features["d0", k]) for k in ("a", "b", "c", "flat")] + [("n2", "a", 9.0)], "dataset string, feature string, value double")
    got = {r["dataset"]: r for r in S.predict(new, model).collect()}
    assert set(got) == {"n1", "n2"} and all(r["selected_method"] == "m4" and not r["abstained"] for r in got.values())
    both = {**features, **{("n1", k): features["d0", k] for k in ("a", "b", "c", "flat")}}
    m, route, *_ = propose(both, scores, BANKS[True], names, names, "n1")
    assert m == "m4" and np.isclose(got["n1"]["route_score"], route)
    model["route_threshold"] = 5.0
    assert all(r["selected_method"] == "safe" and r["decision_reason"] == "abstain_to_safe_anchor" for r in S.predict(new, model).collect())
