"""Micro-fixtures from FIXTURES.md: empty input, pre-2016 dates, n = 19/20 normality threshold,
tier-3-only clusters, unseen categories, labels for NaN/junk, single-class AUROC."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aquifer.operators import derive, evaluate, network, prepare


def test_years_before_2016_floor(spark):
    df = spark.createDataFrame([(dt.datetime(2015, 12, 31, 12, 0),), (dt.datetime(2016, 1, 1),),
                                (dt.datetime(2017, 1, 1),)], "date timestamp")
    ys = [r[0] for r in derive.add_years(df).select("years_since_2016").collect()]
    assert ys[0] == pytest.approx(-1 / 365.25) and ys[1] == 0.0 and ys[2] == pytest.approx(366 / 365.25)


def test_bad_date_strings_become_null(spark):
    df = spark.createDataFrame([("2020-05-01",), ("not a date",)], "date string")
    ys = [r[0] for r in derive.add_years(df).select("years_since_2016").collect()]
    assert ys[0] is not None and ys[1] is None


def test_label_semantics(spark):
    obs = spark.createDataFrame([("a", 5.0), ("a", 4.0), ("a", float("nan")), ("a", None), ("b", 1.0)],
                                "analyte string, conc double")
    thr = spark.createDataFrame([("a", 5.0)], "analyte string, limit double")
    ys = [r["y"] for r in derive.label_exceedance(obs, thr).collect()]
    assert ys == [1.0, 0.0, None, None, None]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "node_id long, analyte string, y double, score double")
    assert evaluate.ranking_metrics(empty, ["node_id", "analyte"]).count() == 0
    obs = spark.createDataFrame([], "analyte string, conc double")
    thr = spark.createDataFrame([("a", 5.0)], "analyte string, limit double")
    assert derive.label_exceedance(obs, thr).count() == 0


@pytest.mark.parametrize("n,expect_p", [(19, False), (20, True)])
def test_normality_only_from_20(spark, n, expect_p):
    rng = np.random.default_rng(n)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=n)}))
    p = prepare.distribution_profile(df, ["x"]).first()["p_normal"]
    assert (p > 0) == expect_p


def test_single_class_group_has_no_auc(spark):
    df = spark.createDataFrame([(0, 1.0, 0.3), (0, 1.0, 0.6)], "g int, y double, score double")
    r = evaluate.ranking_metrics(df, ["g"]).first()
    assert r["auroc"] is None and r["auprc"] is None


def test_tier3_only_cluster_keeps_params(spark):
    nodes = spark.createDataFrame([(1, 3, 10, 0), (2, 3, 20, 0), (3, 1, 30, 1), (4, 2, 40, 1)],
                                  "node_id long, tier int, volume long, cluster int")
    params = spark.createDataFrame([(n, 0, float(n)) for n in range(1, 5)], "node_id long, param long, v double")
    out = {r["node_id"]: r["v"] for r in network.clustered_average(params, nodes, "cluster").collect()}
    assert out[1] == 1.0 and out[2] == 2.0  # all-satellite cluster skipped
    assert out[3] == pytest.approx((3 * 30 + 4 * 40) / 70) == out[4]


def test_unseen_category_encodes_to_zeros(spark):
    train = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, c string")
    test = spark.createDataFrame([(10, "x"), (11, "z"), (12, None)], "id int, c string")
    cats = prepare.fit_categories(train, ["c"])
    hot = {r["id"]: r["feature"] for r in prepare.one_hot_long(test, cats, "id", ["c"]).collect()}
    assert hot == {10: "c_x", 12: "c_nan"}


def test_tier_topology_rules(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "node_id long, tier int")
    e = {(r["src"], r["dst"]): r["weight"] for r in network.tier_topology(nodes).collect()}
    assert e[(1, 2)] == 1.0 and e[(3, 1)] == 0.8 and e[(1, 3)] == 1.0 and e[(1, 4)] == 1.0
    assert not any(s == 4 for s, _ in e) and (3, 4) not in e


def test_volume_average_equal_across_hubs_and_links(spark):
    nodes = spark.createDataFrame([(1, 1, 10), (2, 1, 30), (3, 2, 20), (4, 3, 5)], "node_id long, tier int, volume long")
    params = spark.createDataFrame([(n, 0, float(n * n)) for n in range(1, 5)], "node_id long, param long, v double")
    avg = {r["node_id"]: r["v"] for r in network.volume_weighted_average(params, nodes, network.tier_topology(nodes))
           .collect()}
    want = (1 * 10 + 4 * 30 + 9 * 20) / 60
    assert avg[1] == pytest.approx(want) and avg[2] == pytest.approx(want) and avg[3] == pytest.approx(want)
    assert avg[4] == 16.0


def test_recall_alpha_without_positives(spark):
    df = spark.createDataFrame([("a", 0.0, 0.9), ("a", 0.0, 0.1), ("b", 1.0, 0.9), ("b", 1.0, 0.1)],
                               "analyte string, y double, p double")
    r = {x["analyte"]: x for x in evaluate.recall_alpha(df, ["analyte"], F.col("p")).collect()}
    assert r["a"]["recall"] is None and r["a"]["alpha_global"] == 1.0 and r["a"]["alpha_local"] == 1.0
    assert r["b"]["recall"] == 0.5 and r["b"]["alpha_global"] == 1.0 and r["b"]["alpha_local"] == 1.0


def test_labels_fitted_on_train(spark):
    import pytest
    from aquifer.operators import prepare

    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "kind string")
    codes = prepare.fit_labels(train, "kind")
    test = spark.createDataFrame([(1, "c", 7), (2, None, 7), (3, "a", 7), (3, "a", 7)], "id int, kind string, kind_code int")
    got = prepare.encode_labels(test, codes, "kind")
    assert got.columns == test.columns
    assert sorted((r.id, r.kind_code) for r in got.collect() if r.kind) == [(1, 2), (3, 0), (3, 0)]
    assert [r.kind_code for r in got.where("id = 2").collect()] == [None]
    odd = spark.createDataFrame([(1, "zz")], "id int, kind string")
    with pytest.raises(Exception, match="unseen label in kind: zz"):
        prepare.encode_labels(odd, codes, "kind").collect()


def test_a_skipped_chain_link_is_a_zero_feature(spark):
    """A link with one class only trains no model and stands as a constant column before the next link."""
    import numpy as np
    from aquifer.operators import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    rows = [(i, float(a), float(b), 1.0, float(a + b > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, f1 double, f2 double, y_same double, y_sum double")
    out = models.chain_gbt(df.where("sample_id < 80"), df.where("sample_id >= 80"), ["f1", "f2"], ["y_same", "y_sum"], max_iter=3).collect()
    assert [(r.analyte, r.n_features) for r in out] == [("y_sum", 3)] and out[0].auroc > 0.8
