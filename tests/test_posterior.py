"""Fitted posterior of the logistic links against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquifer.operators import federate


def logistic_map(x, y, prior, steps=4000):
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + prior * w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    p = 1 / (1 + np.exp(-x @ w))
    return w, 1 / np.sqrt(prior + ((p * (1 - p))[:, None] * x * x).sum(0))


def test_posterior_is_the_map_and_its_curvature(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    logit = x @ [1.5, -1.0, 0.0] - 0.5
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["y"] = (rng.random(600) < 1 / (1 + np.exp(-logit))).astype(float)
    pdf["z"] = np.where(rng.random(600) < 0.5, np.nan, (rng.random(600) < 0.1).astype(float))
    pdf["none"] = np.nan
    pdf.loc[:50, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(4)
    df = df.select(*"abc", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("y", "z", "none")])
    got = federate.fit_posteriors(df, list("abc"), ["y", "z", "none"], steps=150, prior=2.0).toPandas()
    full = np.column_stack([np.nan_to_num(pdf[list("abc")].to_numpy()), np.ones(600)])
    for t in ("y", "z"):
        there = pdf[t].notna().to_numpy()
        w, s = logistic_map(full[there], pdf[t][there].to_numpy(), 2.0)
        own = got[got.analyte == t]
        assert np.allclose(own.mu, w, atol=1e-5) and np.allclose(own.sigma, s, atol=1e-5)
    none = got[got.analyte == "none"]
    assert (none.mu == 0).all() and none.sigma.to_numpy() == pytest.approx(np.sqrt(0.5))


def test_bands_narrow_with_more_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    pdf = pd.DataFrame({"a": x, "y": (rng.random(4000) < 1 / (1 + np.exp(-x))).astype(float)})
    df = spark.createDataFrame(pdf)
    widths = []
    for n in (40, 4000):
        post = federate.fit_posteriors(df.limit(n), ["a"], ["y"], steps=40).collect()
        m = federate.predictive_moments(df.limit(200), ["a"], [r.mu for r in post], [r.sigma for r in post], 50)
        widths.append(m.agg(F.avg("pred_std")).first()[0])
    assert widths[1] < widths[0] / 4


def test_forcing_falls_by_epoch_and_flags_are_inputs(spark):
    rate = federate.falling(0.9, 0.3, 4)
    assert [round(rate(e), 6) for e in (0, 1, 2, 3, 9)] == [0.9, 0.7, 0.5, 0.3, 0.3]
    rng = np.random.default_rng(3)
    a = rng.normal(size=800)
    pdf = pd.DataFrame({"node_id": 0, "a": np.where(rng.random(800) < 0.5, np.nan, a)})
    pdf["y"] = pdf.a.isna().astype(float)  # only the presence of the feature tells the label
    pdf["z"] = pdf.y
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None)))
    losses = {}
    for flags in (False, True):
        spec = federate.ChainSpec(["a"], ["y", "z"], forcing=rate, flags=flags)
        model = federate.train_steps(df, federate.init_model(df, spec), steps=8)
        losses[flags] = model.history
        assert [len(w) for w in model.weights[0]] == [2 + flags, 3 + flags]
        again = federate.train_steps(df.repartition(5), federate.init_model(df, spec), steps=8)
        assert np.allclose(again.history, model.history, atol=1e-9)
        assert federate.score_chain(df, model, ["node_id"]).where("score IS NULL").count() == 0
    assert losses[True][-1] < losses[False][-1] and losses[True][-1] < losses[True][0]
