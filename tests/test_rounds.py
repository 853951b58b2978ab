"""Training rounds over a parameter table: held against the single-table trainer, phases, personalised tails."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquifer.operators import federate, rounds


def _frame(spark, seed=0, n=500, flip=()):
    rng = np.random.default_rng(seed)
    node = np.where(rng.random(n) < 0.4, 1, rng.integers(1, 5, n))  # one node holds over a third of all rows
    a, b = rng.normal(size=(2, n))
    a[rng.random(n) < 0.1] = np.nan
    sign = np.where(np.isin(node, flip), -1, 1)
    y1 = (np.nan_to_num(a) * sign + 0.2 * rng.normal(size=n) > 0).astype(float)
    y2 = (b * sign + 0.5 * y1 > 0.2).astype(float)
    y1[rng.random(n) < 0.2] = np.nan
    y1[node == 4], y2[node == 4] = np.nan, np.nan  # a node without labels
    pdf = pd.DataFrame({"node_id": node, "a": a, "b": b, "y1": y1, "y2": y2, "v": "clash", "slice": 9})
    return spark.createDataFrame(pdf).withColumn("node_id", F.col("node_id").cast("long"))


def _table(params):
    return {(r.node_id, r.analyte, r.param): r.v for r in params.collect()}


@pytest.mark.parametrize("flags", [False, True])
def test_steps_equal_the_driver_trainer(spark, flags):
    df = _frame(spark)
    spec = federate.ChainSpec(["a", "b"], ["y1", "y2"], flags=flags)
    want = federate.train_steps(df, federate.init_model(df, spec), steps=4)
    blocks = rounds.pack_rows(df.unionByName(df.limit(1).withColumn("node_id", F.lit(None).cast("long"))), spec, block_rows=2)
    assert blocks.slices.where("node_id = 1 AND slice > 0").count() > 0  # the hot node lies in several slices
    got = _table(rounds.train(blocks, rounds.zero_params(blocks), 4))
    expected = _table(want.to_frame(spark))
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)
    assert all(v == 0 for k, v in got.items() if k[0] == 4)


def test_forced_steps_repeat_and_empty_frame(spark):
    df = _frame(spark)
    spec = federate.ChainSpec(["a", "b"], ["y1", "y2"], forcing=federate.falling(0.9, 0.3, 3))
    runs = []
    for parts in (2, 5):
        blocks = rounds.pack_rows(df.repartition(parts), spec, block_rows=parts * 10)
        runs.append(_table(rounds.train(blocks, rounds.zero_params(blocks), 2)))
    assert all(runs[0][k] == pytest.approx(runs[1][k], abs=1e-9) for k in runs[0])
    blocks = rounds.pack_rows(df.limit(0), spec)
    assert rounds.step(blocks, rounds.zero_params(blocks)).count() == 0


def test_rounds_average_then_split_into_groups(spark, tmp_path):
    spec = federate.ChainSpec(["a", "b"], ["y1", "y2"])
    tiers = spark.createDataFrame([(1, 200.0, 1), (2, 100.0, 1), (3, 50.0, 2), (4, 10.0, 3)], "node_id long, volume double, tier int")
    calm = _frame(spark)
    params, log, groups = rounds.run_rounds(calm, spec, tiers, rounds=3, epochs=1, every=2, warmup=9)
    rows = log.orderBy("round").collect()
    assert [r.kind for r in rows] == ["local", "local", "global"] and rows[2].loss < rows[0].loss and groups.count() == 0
    t = _table(params)
    assert all(t[1, a, p] == pytest.approx(t[3, a, p]) for n, a, p in t if n == 1) and t[4, "y1", 0] == 0
    fights = _frame(spark, flip=(2,))  # two hubs whose gradients point apart
    params, log, groups = rounds.run_rounds(fights, spec, tiers, rounds=3, epochs=1, every=2, warmup=1, save=str(tmp_path))
    assert [r.kind for r in log.orderBy("round").collect()] == ["local", "groups", "groups"]
    assert {r["round"] for r in groups.collect()} == {1, 2} and groups.where("round = 1").count() == 4


def test_personalised_tails_by_tier(spark):
    df = _frame(spark)
    gspec = federate.ChainSpec(["a", "b"], ["y1"])
    blocks = rounds.pack_rows(df, gspec)
    chain = rounds.train(blocks, rounds.zero_params(blocks), 2)
    tiers = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1)], "node_id long, tier int")
    t = _table(rounds.personalize(df, chain, gspec, ["y2"], tiers, epochs=3))
    assert any(t[1, "y2", j] != 0 for j in range(4)) and all(t[n, "y2", j] == 0 for n in (3, 4) for j in range(4))
    whole = _table(rounds.personalize(df, chain, gspec, ["y2"], tiers, epochs=1, rate=1.0))
    assert all(t[2, "y2", j] == pytest.approx(0.1 * whole[2, "y2", j]) for j in range(4)) and any(t[2, "y2", j] for j in range(4))
    none = _table(rounds.personalize(df, chain, gspec, ["y2"], tiers, epochs=1, min_detections=10 ** 6))
    assert not any(none.values())
