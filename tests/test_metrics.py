"""Ranking metrics against a brute-force implementation of the textbook definitions."""

import numpy as np
import pandas as pd
import pytest

from aquifer.operators import evaluate


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    P = (y == 1).sum()
    if P == 0 or P == len(y):
        return None
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auc_ap_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    pdf = pd.DataFrame({
        "g": rng.integers(0, 4, n),
        "y": rng.integers(0, 2, n).astype(float),
        "score": np.round(rng.random(n), 1),  # heavy ties
    })
    pdf.loc[pdf.g == 3, "y"] = 1.0  # one-class group -> NULL metrics
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    got = evaluate.ranking_metrics(spark.createDataFrame(pdf), ["g"]).toPandas().set_index("g")
    for g, grp in pdf.dropna().groupby("g"):
        y, s = grp.y.to_numpy(), grp.score.to_numpy()
        ea, ep = brute_auc(y, s), brute_ap(y, s)
        if ea is None:
            assert pd.isna(got.loc[g, "auroc"])
        else:
            assert got.loc[g, "auroc"] == pytest.approx(ea, abs=1e-12)
            assert got.loc[g, "auprc"] == pytest.approx(ep, abs=1e-12)
            assert got.loc[g, "roc_area"] == pytest.approx(ea, abs=1e-12)


def test_auc_invariant_to_monotone_map(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": 0, "y": rng.integers(0, 2, 300).astype(float), "score": rng.random(300)})
    a = evaluate.ranking_metrics(spark.createDataFrame(pdf), ["g"]).first()["auroc"]
    pdf["score"] = np.exp(3 * pdf.score)
    b = evaluate.ranking_metrics(spark.createDataFrame(pdf), ["g"]).first()["auroc"]
    assert a == pytest.approx(b, abs=1e-12)


def test_tie_only_scores(spark):
    pdf = pd.DataFrame({"g": 0, "y": [0.0, 1.0, 0.0, 1.0], "score": 0.5})
    r = evaluate.ranking_metrics(spark.createDataFrame(pdf), ["g"]).first()
    assert r["auroc"] == pytest.approx(0.5)
    assert r["auprc"] == pytest.approx(0.5)
