"""Sources/sinks round trips and the distributed chain trainer."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from aquifer.operators import federate
from aquifer.sources import ingest


def test_csv_ingest_coerces_and_renames(spark):
    d = tempfile.mkdtemp(prefix="aq-csv-")
    p = os.path.join(d, "s.csv")
    with open(p, "w") as f:
        f.write("gm_well_id, PFHA ,HFPA-DA,TDS,gm_dataset_name\nW1, 1.5 ,abc,3,x\nW2,NaN,2,4,y\n")
    df = ingest.read_samples_csv(spark, p)
    assert df.columns == ["gm_well_id", "PFHxA", "HFPO_DA", "TDS"]
    rows = df.orderBy("gm_well_id").collect()
    assert rows[0]["PFHxA"] == 1.5 and rows[0]["HFPO_DA"] is None
    assert rows[1]["PFHxA"] is None and rows[1]["HFPO_DA"] == 2.0


def test_stage_registry_checkpoint(spark):
    root = tempfile.mkdtemp(prefix="aq-stage-")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "known")], "id string, basin string")

    ingest.stage(spark, f"{root}/st", build, "basin")
    ingest.stage(spark, f"{root}/st", build, "basin")
    assert len(calls) == 1
    ingest.append_registry(spark, f"{root}/reg", "r1", {"rounds": 3}, 0.1234567)
    ingest.append_registry(spark, f"{root}/reg", "r2", {"rounds": 4}, 0.5)
    reg = spark.read.parquet(f"{root}/reg")
    assert reg.count() == 2 and 0.123457 in [r["final_loss"] for r in reg.collect()]
    params = spark.createDataFrame([(0, 1, 0.5)], "node_id long, param long, v double")
    assert ingest.checkpoint_params(params, root, "r1", 3) is params
    again = ingest.checkpoint_params(params, root, "r1", 4)
    assert again.count() == 1
    ingest.write_run_config(spark, root, "r1", {"a": 1})
    assert spark.read.parquet(f"{root}/runs").count() == 1


def _toy(spark, parts):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 2))
    y1 = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(float)
    y2 = (x[:, 1] + y1 > 0.5).astype(float)
    y1[rng.random(n) < 0.2] = np.nan
    pdf = pd.DataFrame({"node_id": rng.integers(0, 3, n), "a": x[:, 0], "b": x[:, 1], "y1": y1, "y2": y2})
    return spark.createDataFrame(pdf).repartition(parts)


def test_chain_loss_falls_and_is_partition_independent(spark):
    spec = federate.ChainSpec(features=["a", "b"], targets=["y1", "y2"])
    m1 = federate.train_steps(_toy(spark, 1), federate.init_model(_toy(spark, 1), spec), steps=6)
    m4 = federate.train_steps(_toy(spark, 4), federate.init_model(_toy(spark, 4), spec), steps=6)
    assert m1.history[-1] < m1.history[0]
    for n in m1.weights:
        for k in range(2):
            assert np.allclose(m1.weights[n][k], m4.weights[n][k], atol=1e-9)


def test_chain_gradient_matches_numpy(spark):
    spec = federate.ChainSpec(features=["a", "b"], targets=["y1", "y2"])
    df = _toy(spark, 3)
    model = federate.init_model(df, spec)
    pdf = df.toPandas()
    pw = federate.class_weights(df, spec)
    rows = federate._gradient_sums(df, spec, model.weights, pw, spec.width(1))
    local = federate._chain_pass(pdf, spec, model.weights, pw, None)
    want = {(n, k): np.asarray(g) for n, k, _, _, g in local}
    for r in rows:
        assert np.allclose(np.asarray(r["g"][: spec.width(r["link"])]), want[(r["node"], r["link"])], atol=1e-9)


def test_results_sink(spark):
    root = tempfile.mkdtemp(prefix="aq-res-")
    pred = spark.createDataFrame([("A", 1.0, 0.9), ("A", 0.0, 0.2), ("B", 1.0, 0.4)], "analyte string, y double, score double")
    ingest.write_results(pred, root)
    pairs = spark.read.json(f"{root}/pairs_json")
    assert sorted({r["analyte"] for r in pairs.collect()}) == ["A", "B"] and pairs.count() == 3
    assert spark.read.parquet(f"{root}/predictions").count() == 3


def test_forcing_rate_edges(spark):
    from pyspark.sql import functions as F

    from aquifer.operators import derive

    df = spark.createDataFrame([(i, float(i % 2) if i % 3 else None, 0.25) for i in range(300)],
                               "k int, y double, score double")
    none = df.select(derive.known_label_context(df, "y", "score", ratio=0.0, keys=["k"]).alias("c")).collect()
    assert all(r["c"] == 0.25 for r in none)
    allk = df.select("y", derive.known_label_context(df, "y", "score", ratio=1.0, keys=["k"]).alias("c")).collect()
    assert all(r["c"] == (r["y"] if r["y"] is not None else 0.25) for r in allk)
    half = df.select("y", derive.known_label_context(df, "y", "score", ratio=0.5, keys=["k"]).alias("c"))
    share = half.where(F.col("y").isNotNull()).select(F.avg((F.col("c") == F.col("y")).cast("double"))).first()[0]
    assert 0.3 < share < 0.8
    again = df.select(derive.known_label_context(df, "y", "score", ratio=0.5, keys=["k"]).alias("c")).collect()
    assert [r["c"] for r in again] == [r["c"] for r in half.select("c").collect()]


def test_gradients_with_missing_features_and_forcing_do_not_depend_on_partitions(spark):
    from aquifer.operators import federate

    rng = np.random.default_rng(5)
    rows = [(int(i % 2), None if i % 7 == 0 else float(rng.normal()), float(rng.normal()),
             None if i % 5 == 0 else float(i % 3 == 0), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "node_id int, a double, b double, t0 double, t1 double")
    for forcing in (1.0, 0.5):
        spec = federate.ChainSpec(["a", "b"], ["t0", "t1"], forcing=forcing)
        got = []
        for parts in (1, 7):
            m = federate.train_steps(df.repartition(parts), federate.init_model(df, spec), steps=2)
            got.append(np.concatenate([w for n in sorted(m.weights) for w in m.weights[n]]))
            assert np.isfinite(got[-1]).all() and len(m.history) == 2
        assert np.allclose(*got, atol=1e-9)


def test_gaussian_draws_are_standard_normal():
    from aquifer.operators.federate import gaussian_draw

    x = np.array([gaussian_draw(d, j) for d in range(2000) for j in range(5)])
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.03


def test_tree_baseline_without_labelled_test_rows_and_with_missing_features(spark):
    from aquifer.operators import models

    rows = [(float(i % 9) if i % 4 else None, float(i % 5), float(i % 9 > 4)) for i in range(120)]
    train = spark.createDataFrame(rows, "a double, b double, y double")
    test = spark.createDataFrame([(1.0, 2.0, None)], "a double, b double, y double")
    m, imp = models.independent_gbt(train, test, ["a", "b"], ["y"], max_iter=2)
    assert [(r.auroc, r.n_test) for r in m.collect()] == [(None, 0)] and imp.count() == 2


def test_pooled_average_equals_the_average_over_edges(spark):
    """Where tiers 1 and 2 are all linked, one sum a parameter gives what the sum over each node's neighbours gives."""
    import numpy as np
    from aquifer.operators import network

    rng = np.random.default_rng(2)
    nodes = spark.createDataFrame([(i, int(i % 3) + 1, float(rng.integers(1, 50)), i % 2) for i in range(15)],
                                  "node_id long, tier int, volume double, pool int")
    params = spark.createDataFrame([(i, p, float(rng.normal())) for i in range(15) for p in range(4) if (i, p) != (3, 2)],
                                   "node_id long, param int, v double")

    def rows(df):
        return {(r.node_id, r.param): round(r.v, 9) for r in df.collect()}

    one = nodes.withColumn("pool", nodes["pool"] * 0)
    plain = network.volume_weighted_average(params, nodes, network.tier_topology(nodes))
    pooled = rows(network.pooled_average(params, one, "pool"))
    assert pooled == rows(plain) and len(pooled) >= 4 * 15 - 1
    split = rows(network.pooled_average(params, nodes, "pool"))
    edges = network.intra_cluster_topology(nodes, "pool")
    assert split == rows(network.volume_weighted_average(params, nodes, edges))
