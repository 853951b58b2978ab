"""Clustering properties: agglomeration equals a naive reference, PCA and SOM sanity."""

import numpy as np
import pandas as pd
import pytest

from linkage import naive_agglomerate

from aquifer.operators import cluster
from aquifer.session import checkpoint_dir


@pytest.mark.parametrize("seed,linkage", [(0, "average"), (1, "average"), (2, "complete")])
def test_agglomerate_matches_naive(spark, seed, linkage):
    checkpoint_dir(spark)
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(loc=c, scale=0.3, size=(6, 2)) for c in [(0, 0), (3, 0), (0, 3)]])
    n = len(pts)
    rows = [(i, j, float(np.linalg.norm(pts[i] - pts[j]))) for i in range(n) for j in range(i + 1, n)]
    pairs = spark.createDataFrame(rows, "i long, j long, d double")
    got = {r["item"]: r["cluster"] for r in cluster.agglomerate(pairs, 1.5, linkage).collect()}
    want = naive_agglomerate(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)), 1.5, linkage)
    assert [got[i] for i in range(n)] == want


def test_pca_centred_and_sign_fixed(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.2]]) + 50
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    comps, mean, ev = cluster.fit_pca(df, ["a", "b", "c"])
    assert np.allclose(mean, x.mean(0))
    assert ev[0] > ev[1] > ev[2] and abs(ev.sum() - 1) < 1e-9
    assert (comps[np.abs(comps).argmax(0), range(comps.shape[1])] > 0).all()
    scores = cluster.apply_pca(df, ["a", "b", "c"], comps, mean, []).toPandas()
    assert abs(scores.pc0.mean()) < 1e-9


def test_moments_of_many_parts_are_those_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3)) * [1, 10, 0.1] + [1e6, 0, -3]
    rows = [tuple(map(float, v)) for v in x] + [(None, float("nan"), 1.0)]
    n, mean, m2 = cluster.co_moments(spark.createDataFrame(rows, "a double, b double, c double").repartition(7), ["a", "b", "c"])
    whole = np.vstack([x, [0, 0, 1]])
    assert n == 501 and np.allclose(mean, whole.mean(0)) and np.allclose(m2 / 500, np.cov(whole.T), rtol=1e-9)


def test_items_without_a_pair_stay(spark):
    pairs = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.9), (1, 3, 0.9)], "i long, j long, d double")
    items = spark.createDataFrame([(k,) for k in range(1, 6)], "item long")
    got = {r["item"]: r["cluster"] for r in cluster.agglomerate(pairs, 0.5, items=items).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
