"""The fitted partition: stored and loaded, unseen and missing values, lacking and extra columns."""

from aquifer.operators.partition import fit_partition, load_partition, long_blocks

ROWS = "k long, TDS double, FE double, Texture_USDA string, note string, depth double, empty double, PFOA double, PFBS double, node_tier int"


def _tables(spark):
    train = spark.createDataFrame([(i, float(i), float(i % 3), "ab"[i % 2], "n" if i % 4 else None, float(i * i), None, i / 10, 1.0, i % 3)
                                   for i in range(40)], ROWS)
    test = spark.createDataFrame([(100, 19.5, None, "zz", None, 1.0, None, 0.5, None, 2), (101, None, 1.0, None, "n", 2.0, 3.0, None, 0.0, None),
                                  (101, None, 1.0, None, "n", 2.0, 3.0, None, 0.0, None)], ROWS)
    return train, test


def test_parts_of_test_rows(spark):
    train, test = _tables(spark)
    fitted = fit_partition(train, ["k"], chain=["PFOA"], classes={"A": ["PFOA", "PFBS"]})
    rows = fitted.apply(test).orderBy("k").collect()
    assert [r.k for r in rows] == [100, 101, 101] and rows[1] == rows[2]
    names = {(r.block, r.pos): r.feature for r in fitted.features().collect()}
    assert [names["X_glob", i] for i in range(4)] == ["TDS", "FE", "Texture_USDA_a", "Texture_USDA_b"]
    assert [names["X_loc", i] for i in range(3)] == ["depth", "note_n", "note_nan"]  # `empty` has no training value
    first = rows[0]
    assert first.X_glob.size == 4 and list(first.X_glob.indices) == [0, 1]  # an unseen texture has no entry
    assert abs(first.X_glob["values"][0]) < 1e-9 and first.X_glob["values"][1] is None
    assert list(first.X_loc.indices) == [0, 2] and first.X_loc["values"][1] == 1.0  # a NULL note is a category of its own
    assert first.Y_glob.asDict() == {"PFOA": 0.5} and first.Y_loc.asDict() == {"PFBS": None} and first.geo.asDict() == {"node_tier": 2}


def test_saved_and_loaded(spark, tmp_path):
    train, test = _tables(spark)
    fitted = fit_partition(train, ["k"], chain=["PFOA"], classes={"A": ["PFOA", "PFBS"]})
    fitted.save(str(tmp_path / "part"))
    again = load_partition(spark, str(tmp_path / "part"))
    want = fitted.apply(test).orderBy("k").collect()
    assert again.apply(test).orderBy("k").collect() == want
    wider = test.selectExpr("*", "1 as _code0", "'x' as other").drop("FE", "note")
    got = again.apply(wider).orderBy("k").collect()  # a planned column that is not there is missing, extra ones are left out
    assert got[1].X_glob["values"][1] is None and list(got[1].X_loc.indices) == [0, 2]
    assert again.apply(test.limit(0)).count() == 0


def test_quantile_scaled_columns_and_no_categories(spark):
    import numpy as np
    x = np.random.default_rng(0).gamma(2.0, size=400)  # skewed between the bounds of the quantile scaler
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, TDS double")
    fitted = fit_partition(df, ["k"])
    plan = fitted.plan.first()
    assert plan.scaler == "quantile" and len(plan.quantiles) == 400
    v = np.array([r["values"][0] for r in fitted.apply(df).orderBy("k").selectExpr("X_glob.values").collect()])
    assert (np.argsort(v, kind="stable") == np.argsort(x, kind="stable")).all() and abs(np.median(v)) < 1e-6
    r = fitted.apply(df).first()
    assert r.X_loc.size == 0 and r.Y_glob is None and r.geo is None
    assert long_blocks(fitted.apply(df), fitted).count() == 400


def test_blocks_read_the_rows_once(spark, tmp_path):
    spark.createDataFrame([(i, float(i % 7), float(i), float(i % 3), f"q{i % 4}", 2.0 * i) for i in range(40)],
                          "k long, TDS double, PFOA double, PFBS double, season string, node_tier double").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    fitted = fit_partition(df, ["k"])
    long = long_blocks(fitted.apply(df), fitted)
    assert long.columns == ["k", "block", "feature", "value"] and long.count() == 5 * 40
    assert long._jdf.queryExecution().optimizedPlan().toString().count("Relation [k#") == 1
