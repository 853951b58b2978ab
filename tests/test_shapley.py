"""Shapley values by feature orders: exact with all orders, adding up with any, exact on a linear model."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquifer.operators.shapley import changed_sets, feature_orders, shapley_values

COLS = ["a", "b", "c", "d"]


def _frame(spark, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    return x, spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(pid=np.arange(n)))


def _curved(v):
    return 1 / (1 + F.exp(-(v[0] * v[1] + 2 * v[2] - v[3] * v[3])))


def _curved_np(x):
    return 1 / (1 + np.exp(-(x[..., 0] * x[..., 1] + 2 * x[..., 2] - x[..., 3] ** 2)))


def _by_subsets(x, bg):
    """The definition: a feature's gain weighted over all sets of the others, unchanged features from each background row."""
    out = np.zeros(4)
    for i in range(4):
        others = [j for j in range(4) if j != i]
        for size in range(4):
            for s in itertools.combinations(others, size):
                low, high = bg.copy(), bg.copy()
                low[:, list(s)] = x[list(s)]
                high[:, [*s, i]] = x[[*s, i]]
                w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                out[i] += w * (_curved_np(high) - _curved_np(low)).mean()
    return out


def test_all_orders_match_the_definition(spark):
    x, df = _frame(spark, 12, 1)
    bg, bdf = _frame(spark, 7, 2)
    got = shapley_values(df, COLS, _curved, bdf, orders=24).orderBy("pid").toPandas()
    want = np.array([_by_subsets(r, bg) for r in x])
    np.testing.assert_allclose(got[[f"phi_{c}" for c in COLS]].to_numpy(), want, atol=1e-10)
    np.testing.assert_allclose(got["base"], _curved_np(bg).mean(), atol=1e-12)


def test_few_orders_still_add_up_and_repeat(spark):
    x, df = _frame(spark, 30, 3)
    bg, bdf = _frame(spark, 60, 4)
    got = shapley_values(df, COLS, _curved, bdf.orderBy("pid"), orders=6, seed=9, rows=50).orderBy("pid").toPandas()
    phi = got[[f"phi_{c}" for c in COLS]].to_numpy()
    np.testing.assert_allclose(phi.sum(axis=1), _curved_np(x) - _curved_np(bg[:50]).mean(), atol=1e-10)
    again = shapley_values(df, COLS, _curved, bdf.orderBy("pid"), orders=6, seed=9, rows=50).orderBy("pid").toPandas()
    assert np.array_equal(phi, again[[f"phi_{c}" for c in COLS]].to_numpy())


def test_linear_model_with_weights_of_the_row_and_missing_values(spark):
    x, df = _frame(spark, 9, 5)
    bg, bdf = _frame(spark, 5, 6)
    df = df.withColumn("w", (F.col("pid") + 1).cast("double")).withColumn("b", F.when(F.col("pid") != 4, F.col("b"))) \
        .withColumn("c", F.when(F.col("pid") == 2, F.lit(float("nan"))).otherwise(F.col("c")))
    x[4, 1] = x[2, 2] = 0.0
    got = shapley_values(df, COLS, lambda v: F.col("w") * (v[0] - 3 * v[1] + v[2]) + v[3], bdf, orders=2).orderBy("pid").toPandas()
    w = np.arange(1, 10)[:, None] * np.array([[1.0, -3.0, 1.0, 0.0]]) + np.array([[0, 0, 0, 1.0]])
    np.testing.assert_allclose(got[[f"phi_{c}" for c in COLS]].to_numpy(), w * (x - bg.mean(axis=0)), atol=1e-10)


def test_orders_and_nothing_to_compare_with(spark):
    assert len(feature_orders(4, 24, 0)) == 24 and len(feature_orders(9, 7, 0)) == 7
    two = feature_orders(9, 2, 0)
    assert two[0] == two[1][::-1]
    _, df = _frame(spark, 3, 7)
    with pytest.raises(ValueError):
        shapley_values(df, COLS, _curved, df.limit(0))
    assert shapley_values(df.limit(0), COLS, _curved, df).count() == 0


def test_a_set_of_features_is_predicted_once():
    """Four features: 24 orders meet in 16 sets; a feature's share is a gain and a loss of each order."""
    sets = changed_sets(feature_orders(4, 24, 0), 4)
    assert len(sets) == 16 and all(sum(abs(w[i]) for w in sets.values()) == 48 and sum(w[i] for w in sets.values()) == 0 for i in range(4))


def test_many_sets_give_the_same_as_one_expression_each(spark, monkeypatch):
    _, df = _frame(spark, 5, 1)
    one = shapley_values(df, COLS, _curved, df.orderBy("pid")).orderBy("pid").toPandas().to_numpy()
    monkeypatch.setattr("aquifer.operators.shapley.UNROLLED", 0)
    np.testing.assert_allclose(one, shapley_values(df, COLS, _curved, df.orderBy("pid")).orderBy("pid").toPandas().to_numpy(), atol=1e-12)
