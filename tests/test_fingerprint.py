"""Principal scores from either side, fingerprints and their clustering against dense computations."""

import numpy as np
import pandas as pd
import pytest

from aquifer.operators import fingerprint
from linkage import naive_agglomerate


def _long(spark, x, nodes):
    n, d = x.shape
    return spark.createDataFrame(pd.DataFrame({"node_id": np.repeat(nodes, d), "param": np.tile(np.arange(d), n), "v": x.ravel()}))


def _scores(x, k):
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    out = (u * s)[:, :k]
    return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])


@pytest.mark.parametrize("n,d", [(20, 64), (64, 9)])
def test_scores_from_the_smaller_side(spark, n, d):
    x = np.random.default_rng(n).normal(size=(n, d)) * np.linspace(1, 3, d)
    nodes = np.arange(n) * 3 + 100
    got = fingerprint.principal_scores(_long(spark, x, nodes), "node_id", "param", "v", 6).toPandas()
    wide = got.pivot(index="node_id", columns="component", values="value").sort_index()
    assert list(wide.index) == list(nodes) and wide.shape == (n, 6)
    np.testing.assert_allclose(wide.to_numpy(), _scores(x, 6), atol=1e-8)


def test_both_sides_agree_with_missing_values(spark):
    x = np.random.default_rng(3).normal(size=(12, 12))
    x[2, 5] = x[7, 0] = 0.0
    full = _long(spark, x, np.arange(12))
    sparse = full.where("v <> 0").withColumnRenamed("v", "value_")
    square = fingerprint.principal_scores(sparse, "node_id", "param", "value_", 4).toPandas()
    extra = full.selectExpr("node_id", "param", "v").unionByName(spark.createDataFrame([(0, 99, 0.0)], "node_id long, param long, v double"))
    dual = fingerprint.principal_scores(extra, "node_id", "param", "v", 4).toPandas()  # one constant column more: node products
    key = ["node_id", "component"]
    np.testing.assert_allclose(square.sort_values(key)["value"], dual.sort_values(key)["value"], atol=1e-8)


def test_fingerprints_of_many_nodes_and_their_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 40)) * 4
    x = centres[np.arange(18) % 3] + rng.normal(size=(18, 40)) * 0.3
    env = rng.normal(size=(18, 2)) * 0.1 + (np.arange(18) % 3)[:, None]
    cov = spark.createDataFrame([(int(i), f"e{j}", float(env[i, j])) for i in range(18) for j in range(2)],
                                "node_id long, feature string, value double")
    prints = fingerprint.node_fingerprints(cov, _long(spark, x, np.arange(18)), {"e0": 3.0}, components=15).cache()
    assert {r.feature for r in prints.select("feature").distinct().collect()} == {"env_e0", "env_e1"} | {f"pc{k}" for k in range(15)}
    z = prints.toPandas().pivot(index="node_id", columns="feature", values="z").to_numpy()
    np.testing.assert_allclose(z.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(z.std(axis=0), 1, atol=1e-9)
    want = np.column_stack([env, _scores(x, 15)])
    want = (want - want.mean(axis=0)) / want.std(axis=0)
    np.testing.assert_allclose(np.sort((z @ z.T).ravel()), np.sort((want @ want.T).ravel()), atol=1e-6)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    got = {r["item"]: r["cluster"] for r in fingerprint.cluster_nodes(prints, -0.02).collect()}
    dist = 1 - u @ u.T
    assert got == dict(enumerate(naive_agglomerate(dist, 1.02, "average")))
    assert 1 < len(set(got.values())) < 18


def test_no_nodes(spark):
    assert fingerprint.principal_scores(spark.createDataFrame([], "node_id long, param long, v double"), "node_id", "param", "v").count() == 0
