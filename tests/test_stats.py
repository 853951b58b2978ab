"""Distributed order statistics and the normality test."""

import math

import numpy as np
import pandas as pd
import pytest

from aquifer.operators import prepare
from aquifer.operators.stats import exact_quantiles, global_rank


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000).astype(str), "x": np.round(rng.normal(size=3000), 2)})
    pdf.loc[pdf.g == "0", "x"] = 7.0  # a group that is one long tie
    q = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).toPandas()
    for _, r in q.iterrows():
        assert r.q == pytest.approx(np.quantile(pdf[pdf.g == r.g].x, r.p), abs=1e-12)


def test_global_rank_is_a_permutation(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": 0, "x": rng.permutation(2000).astype(float)})
    r = global_rank(spark.createDataFrame(pdf), ["g"], "x").toPandas()
    assert (r.sort_values("x")._rank.to_numpy() == np.arange(2000)).all()


def test_k2_pvalue_closed_form(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.exponential(size=500)})
    prof = prepare.distribution_profile(spark.createDataFrame(pdf), ["a", "b"]).toPandas().set_index("col")
    for c in ["a", "b"]:
        x = pdf[c].to_numpy()
        m = x.mean()
        m2, m3, m4 = ((x - m) ** 2).mean(), ((x - m) ** 3).mean(), ((x - m) ** 4).mean()
        g, k = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
        assert prof.loc[c, "skew"] == pytest.approx(g, rel=1e-9)
        assert prof.loc[c, "kurt"] == pytest.approx(k, rel=1e-9)
        assert prof.loc[c, "p_normal"] == pytest.approx(prepare.k2_reference(500, g, k), rel=1e-9)
    assert prof.loc["b", "p_normal"] < 1e-6 < prof.loc["a", "p_normal"]


def test_scaler_thresholds(spark):
    # 9 values -> robust (n < 10); constant -> standard with unit scale; all-NULL -> dropped
    pdf = pd.DataFrame({"few": [1.0, 2, 3, 4, 5, 6, 7, 8, 9] + [None] * 11, "const": [2.0] * 20,
                        "gone": [None] * 20})
    df = spark.createDataFrame(pdf, "few double, const double, gone double")
    plan = prepare.fit_scalers(df, ["few", "const", "gone"])
    assert plan.kind["few"] == "robust" and "gone" not in plan.kind
    assert plan.scale["const"] == 1.0
    out = prepare.apply_scalers(df, plan).toPandas()
    assert list(out.columns) == ["few", "const"]
    assert out["few"].isna().sum() == 11


def test_split_is_chronological_partition(spark):
    from aquifer.sources import fixtures as fx
    from harness import SF_SMALL

    o = fx.obs_long(spark, SF_SMALL).select("sample_id", "ts")
    s = prepare.chronological_split(o, "ts", "sample_id", 0.8).toPandas()
    n = len(s)
    assert s.sample_id.is_unique and n == o.count()
    assert (s.split == "train").sum() == round(0.8 * n)
    tr, te = s[s.split == "train"], s[s.split == "test"]
    assert tr.ts.dt.date.max() <= te.ts.dt.date.min()


def test_num_coercion(spark):
    from aquifer.functions import num

    df = spark.createDataFrame([("NaN",), ("abc",), (" 1.5 ",), (None,)], "s string")
    vals = [r[0] for r in df.select(num("s")).collect()]
    assert vals[0] is None and vals[1] is None and vals[2] == 1.5 and vals[3] is None
    assert not math.isnan(vals[2])


def test_vif_matches_regression(spark):
    from aquifer.operators import profile

    rng = np.random.default_rng(7)
    a = rng.normal(size=400)
    b = 0.8 * a + 0.6 * rng.normal(size=400)
    c = rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    got = {r[0]: r[2] for r in profile.vif(spark.createDataFrame(pdf), ["a", "b", "c"])}
    for col in "abc":
        others = [x for x in "abc" if x != col]
        X = np.column_stack([np.ones(400)] + [pdf[o] for o in others])
        beta, *_ = np.linalg.lstsq(X, pdf[col], rcond=None)
        resid = pdf[col] - X @ beta
        r2 = 1 - (resid ** 2).sum() / ((pdf[col] - pdf[col].mean()) ** 2).sum()
        assert got[col] == pytest.approx(1 / (1 - r2), rel=1e-6)


@pytest.mark.parametrize("slices", [2, 7, 64])
def test_sorted_ordinal_at_any_number_of_slices(spark, slices):
    from aquifer.operators import stats

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 2000), "v": [f"k{i:05d}" for i in rng.permutation(2000)]})
    r = stats.sorted_ordinal(spark.createDataFrame(pdf), ["g"], "v", "o", slices).toPandas()
    for _, grp in r.groupby("g"):
        assert (grp.sort_values("v").o.to_numpy() == np.arange(len(grp))).all()


@pytest.mark.parametrize("slices", [2, 7, 64])
def test_prefix_with_infinities_null_groups_and_a_giant_tie(spark, slices):
    from aquifer.operators import stats

    inf = float("inf")
    rows = [(g, v, 1) for g in ("a", None) for v in [-inf, -inf, -1.0, 0.0, inf, 2.0] + [5.0] * 300]
    rows += [("a", None, 1), ("a", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = stats.global_prefix(df, ["g"], "v", "w", "below", slices).toPandas()
    assert len(got) == 612
    for _, own in got.groupby("g", dropna=False):
        own = own.sort_values(["below"])
        assert own.below.tolist() == list(range(306)) and own.v.is_monotonic_increasing
    q = stats.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()
    assert sorted((str(r.g), r.p, r.q) for r in q) == [
        (g, p, x) for g in ("None", "a") for p, x in ((0.0, -inf), (0.5, 5.0), (1.0, inf))]


def test_ranking_metrics_with_infinite_scores_and_null_keys(spark):
    from aquifer.operators.evaluate import ranking_metrics

    rows = [(k, y, s) for k in ("a", None) for y, s in [(0.0, -float("inf")), (1.0, 0.2), (0.0, 0.3), (1.0, 0.9)]]
    got = ranking_metrics(spark.createDataFrame(rows, "k string, y double, score double"), ["k"]).collect()
    assert len(got) == 2
    for r in got:
        assert r.auroc == pytest.approx(0.75) and r.roc_area == pytest.approx(0.75)
        assert r.auprc == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_split_keeps_repeated_and_null_ids(spark):
    rows = [("2020-01-01", 1), ("2020-01-02", 2), ("2020-01-02", 2), ("2020-01-02", None), (None, 5)]
    s = prepare.chronological_split(spark.createDataFrame(rows, "d string, id long"), "d", "id", 0.4).collect()
    assert sorted((str(r.id), r.split) for r in s) == [
        ("1", "train"), ("2", "test"), ("2", "train"), ("5", "test"), ("None", "test")]


@pytest.mark.parametrize("accuracy", [4, 50, 2000])
def test_quantiles_by_brackets(spark, accuracy):
    """Coarse and fine bounds, giant ties, infinities, NULL and NaN, null groups and groups of one give exact values."""
    from aquifer.operators.stats import bracket_histogram

    rng = np.random.default_rng(4)
    inf = math.inf
    groups = {"many": rng.normal(size=5000), "ties": np.repeat([1.0, 2.0, 3.0], [10, 3000, 11]), "one": [4.0], "two": [1.0, 2.0],
              None: np.append(rng.integers(0, 50, 900), [-inf, inf, inf]), "wide": rng.lognormal(0, 9, 4000)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("many", None), ("many", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "x", probs, accuracy).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, xs in groups.items():
        for p in probs:
            want = np.min(xs) if p == 0 else np.max(xs) if p == 1 else np.quantile(np.array(xs, float), p)
            assert np.isnan(want) or got[g, p] == pytest.approx(want, rel=1e-12)  # numpy has NaN between infinities
    if accuracy == 2000:
        kept = bracket_histogram(df.where("g = 'many'"), ["g"], "x", [0.5], accuracy).where("_o.x IS NOT NULL").count()
        assert kept < 100  # of 5000 values
    single = exact_quantiles(df.where("g = 'wide'"), [], "x", [0.5], accuracy).first()
    assert single.q == pytest.approx(np.quantile(groups["wide"], 0.5), rel=1e-12)


def pairwise(x, method):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = (pd.Series(x[both, k]) for k in (i, j))
            out[i, j] = (a.rank() if method == "spearman" else a).corr(b.rank() if method == "spearman" else b)
    return out


@pytest.mark.parametrize("hot", [5, 100_000])
def test_spearman_from_joint_counts(spark, hot):
    from aquifer.operators import profile

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 5, 900), rng.normal(size=900).round(1), np.where(rng.random(900) < 0.4, 7.0, rng.normal(size=900)),
                         np.full(900, 3.0)])
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).repartition(4)
    got = {("abcd".index(r.a), "abcd".index(r.b)): r.r for r in profile.spearman_pairs(df, list("abcd"), hot).collect()}
    for pair, want in pairwise(x, "spearman").items():
        assert got[pair] is None if np.isnan(want) else got[pair] == pytest.approx(want, abs=1e-9)
    assert profile.spearman_pairs(df.limit(0), list("ab")).count() == 0


def test_pearson_of_three_hundred_columns(spark):
    from aquifer.operators import profile

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 300)) + 1e6
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=400)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    names = [f"k{i}" for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    want = pairwise(x[:, :12], "pearson")
    for tile in (256, 7):
        cols = names if tile == 256 else names[:12]
        got = {(int(r.a[1:]), int(r.b[1:])): r.r for r in profile.pearson_pairs(df, cols, tile).collect()}
        assert len(got) == len(cols) * (len(cols) - 1) // 2
        for pair, r in want.items():
            assert got[pair] is None if 7 in pair else got[pair] == pytest.approx(r, abs=1e-9)


def test_nan_scores_count_nowhere(spark):
    from aquifer.operators.evaluate import ranking_metrics, roc_points

    nan = float("nan")
    rows = [("a", 0.0, 0.1), ("a", 1.0, 0.2), ("a", 0.0, 0.3), ("a", 1.0, 0.9)]
    more = rows + [("a", 1.0, nan), ("a", 0.0, nan), ("b", 1.0, nan)]
    schema = "k string, y double, score double"
    clean, dirty = spark.createDataFrame(rows, schema), spark.createDataFrame(more, schema)
    assert ranking_metrics(dirty, ["k"]).collect() == ranking_metrics(clean, ["k"]).collect()
    assert sorted(map(str, roc_points(dirty, ["k"]).collect())) == sorted(map(str, roc_points(clean, ["k"]).collect()))
