"""Stage 3 queries: split, distribution profile, scaler plans, scaling, encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

import numpy as np

from aquifer.functions import r6
from aquifer.operators import prepare
from aquifer.operators.stats import exact_quantiles, to_long
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx

ENVC = fx.ENV_COLUMNS

# DuckDB twin of the profile + scaler choice (population moments, K^2 closed form).
PROFILE_SQL = """
, mo AS (SELECT col, count(x) AS n, avg(x) AS mean FROM env_long WHERE x IS NOT NULL GROUP BY col)
, mm AS (SELECT e.col, any_value(n) AS n, any_value(mean) AS mean, avg(pow(x - mean, 2)) AS m2,
         avg(pow(x - mean, 3)) AS m3, avg(pow(x - mean, 4)) AS m4
         FROM env_long e JOIN mo USING (col) WHERE x IS NOT NULL GROUP BY e.col)
, sk AS (SELECT col, n::DOUBLE AS n, mean, sqrt(m2) AS std, m3 / pow(m2, 1.5) AS skew, m4 / (m2*m2) - 3 AS kurt FROM mm)
, k1 AS (SELECT *, skew * sqrt((n+1)*(n+3) / (6.0*(n-2))) AS y,
         3.0*(n*n+27*n-70)*(n+1)*(n+3) / ((n-2)*(n+5)*(n+7)*(n+9)) AS beta2,
         (kurt + 3 - 3.0*(n-1)/(n+1)) / sqrt(24.0*n*(n-2)*(n-3) / ((n+1)*(n+1)*(n+3)*(n+5))) AS xk,
         6.0*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6.0*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sb1 FROM sk)
, k2 AS (SELECT *, sqrt(2*(beta2-1)) - 1 AS w2, 6.0 + 8.0/sb1*(2.0/sb1 + sqrt(1 + 4.0/(sb1*sb1))) AS a FROM k1)
, k3 AS (SELECT *, asinh(y * sqrt((w2-1)/2)) / sqrt(ln(w2)/2) AS z1, 1 + xk*sqrt(2/(a-4.0)) AS dn FROM k2)
, k4 AS (SELECT *, ((1 - 2/(9.0*a)) - sign(dn) * pow((1 - 2.0/a) / abs(dn), 1.0/3)) / sqrt(2/(9.0*a)) AS z2 FROM k3)
, prof AS (SELECT col, n::BIGINT AS n, mean, std, skew, kurt,
           CASE WHEN std = 0 THEN 0.0 WHEN n >= 20 THEN exp(-(z1*z1 + z2*z2)/2) ELSE 0.0 END AS p_normal FROM k4)
, choice AS (SELECT *, CASE WHEN n < 10 THEN 'robust'
           WHEN p_normal > 0.05 AND abs(skew) < 0.5 AND abs(kurt) < 1.0 THEN 'standard'
           WHEN abs(skew) > 2.0 OR abs(kurt) > 3.0 THEN 'robust' WHEN abs(skew) > 1.0 THEN 'quantile'
           ELSE 'standard' END AS scaler FROM prof)
"""

SPLIT_SQL = """
SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY coalesce(ts::DATE, DATE '9999-12-31'), sample_id)
   <= round_even(0.8 * count(*) OVER (), 0) THEN 'train' ELSE 'test' END AS split FROM obs"""


@query("w_split", S.with_(S.OBS) + SPLIT_SQL)
def w_split(spark, d):
    o = fx.obs_long(spark, d).select("sample_id", "ts")
    return prepare.chronological_split(o, "ts", "sample_id", 0.8).select("sample_id", "split")


@query("w_split_counts", S.with_(S.OBS) + f"""
SELECT split, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM (SELECT o.ts, s.split FROM obs o JOIN ({SPLIT_SQL}) s
       USING (sample_id)) GROUP BY split""")
def w_split_counts(spark, d):
    o = fx.obs_long(spark, d).select("sample_id", "ts")
    s = prepare.chronological_split(o, "ts", "sample_id", 0.8)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                  F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                                  F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("t_profile", S.with_(S.ENV, S.ENV_LONG) + PROFILE_SQL + """
SELECT col, n, round(mean, 4) AS mean, round(std, 4) AS std, round(skew, 6) AS skew, round(kurt, 6) AS kurt,
       round(p_normal, 6) AS p_normal FROM prof""")
def t_profile(spark, d):
    p = prepare.distribution_profile(fx.env_covariates(spark, d), ENVC)
    return p.select("col", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                    r6("skew").alias("skew"), r6("kurt").alias("kurt"), r6("p_normal").alias("p_normal"))


@query("t_scaler_choice", S.with_(S.ENV, S.ENV_LONG) + PROFILE_SQL + "SELECT col, scaler FROM choice")
def t_scaler_choice(spark, d):
    p = prepare.choose_scaler(prepare.distribution_profile(fx.env_covariates(spark, d), ENVC))
    return p.select("col", "scaler")


def _train_test(spark, d):
    e = fx.env_covariates(spark, d)
    return e.where(F.col("l_orderkey") % 5 != 0), e.where(F.col("l_orderkey") % 5 == 0)


_SCALE_SQL = S.with_(S.ENV) + """
, env_tr AS (SELECT * FROM env WHERE l_orderkey % 5 <> 0)
, env_long AS (SELECT * FROM (SELECT node_id, TDS, FE, SO4, MN, NO3N, heavy FROM env_tr)
               UNPIVOT (x FOR col IN (TDS, FE, SO4, MN, NO3N, heavy)))""" + PROFILE_SQL + """
, qs AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3
         FROM env_long GROUP BY col)
, plan AS (SELECT c.col, scaler, CASE WHEN scaler = 'standard' THEN mean ELSE q2 END AS center,
           CASE WHEN scaler = 'standard' THEN (CASE WHEN std > 0 THEN std ELSE 1.0 END)
                ELSE (CASE WHEN q3 - q1 <> 0 THEN q3 - q1 ELSE 1.0 END) END AS scale
           FROM choice c JOIN qs USING (col) WHERE scaler IN ('standard', 'robust'))
, target AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, TDS, FE, SO4, MN, NO3N, heavy FROM env WHERE __WHERE__)
             UNPIVOT (x FOR col IN (TDS, FE, SO4, MN, NO3N, heavy)))
SELECT l_orderkey, l_linenumber, t.col, round((x - center) / scale, 6) AS scaled FROM target t JOIN plan USING (col)"""


def _scaled_long(spark, d, test: bool):
    train, test_df = _train_test(spark, d)
    plan = prepare.fit_scalers(train, ENVC, kinds=("standard", "robust"))
    keep = [c for c in ENVC if plan.kind.get(c) in ("standard", "robust")]
    tgt = test_df if test else train
    scaled = prepare.apply_scalers(tgt.select("l_orderkey", "l_linenumber", *keep), plan,
                                   keep=["l_orderkey", "l_linenumber"])
    long = scaled.unpivot(["l_orderkey", "l_linenumber"], keep, "col", "scaled")
    return long.withColumn("scaled", r6("scaled"))


@query("t_scale", _SCALE_SQL.replace("__WHERE__", "l_orderkey % 5 <> 0"))
def t_scale(spark, d):
    """Standard (population std) and robust (median / IQR) scaling fitted and applied on train."""
    return _scaled_long(spark, d, test=False)


@query("t_scale_test", _SCALE_SQL.replace("__WHERE__", "l_orderkey % 5 = 0"))
def t_scale_test(spark, d):
    """The train plan applied to the held-out rows."""
    return _scaled_long(spark, d, test=True)


@query("t_quantile")
def t_quantile(spark, d):
    """T5: quantile -> normal transform of all columns (pandas UDF over a 1000-point exact quantile plan fitted on train)."""
    train, test_df = _train_test(spark, d)
    plan = prepare.ScalerPlan(kind={c: "quantile" for c in ENVC})
    probs = list(np.linspace(0, 1, prepare.QUANTILE_GRID))
    found = {(r["col"], r["p"]): r["q"] for r in exact_quantiles(to_long(train, ENVC), ["col"], "x", probs).collect()}
    plan.quantiles = {c: [found[c, p] for p in probs] for c in ENVC}
    return prepare.apply_scalers(test_df.select("l_orderkey", "l_linenumber", *ENVC), plan, keep=["l_orderkey", "l_linenumber"])


@query("t_onehot", """
WITH tr AS (SELECT * FROM part WHERE p_partkey % 4 <> 0), te AS (SELECT * FROM part WHERE p_partkey % 4 = 0)
, cats AS (SELECT DISTINCT 'p_brand' AS col, p_brand AS value FROM tr UNION SELECT DISTINCT 'p_type', p_type FROM tr)
, lg AS (SELECT p_partkey, 'p_brand' AS col, p_brand AS value FROM te UNION ALL
         SELECT p_partkey, 'p_type', p_type FROM te)
SELECT p_partkey, lg.col || '_' || lg.value AS feature, 1.0::DOUBLE AS value FROM lg JOIN cats
  ON lg.col = cats.col AND lg.value = cats.value""")
def t_onehot(spark, d):
    """Categories fitted on train rows, applied to test rows; unseen categories encode as all zeros."""
    p = fx.categories(spark, d)
    train, test_df = p.where(F.col("p_partkey") % 4 != 0), p.where(F.col("p_partkey") % 4 == 0)
    cats = prepare.fit_categories(train, ["p_brand", "p_type"])
    return prepare.one_hot_long(test_df, cats, "p_partkey", ["p_brand", "p_type"])


@query("t_label_encode", """
SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS p_type_code FROM part""")
def t_label_encode(spark, d):
    p = fx.categories(spark, d).select("p_partkey", "p_type")
    return prepare.label_encode(p, "p_type").withColumn("p_type_code", F.col("p_type_code").cast("int"))


_ROLES_SQL = S.with_(S.OBS, S.WIDE) + """
, w AS (SELECT sample_id, well_id AS gm_well_id, day, click AS PFOA, error AS TDS, purchase, signup, view FROM wide)
, cols AS (SELECT * FROM (VALUES ('sample_id', 'bigint'), ('gm_well_id', 'bigint'), ('day', 'date'), ('PFOA', 'double'),
           ('TDS', 'double'), ('purchase', 'double'), ('signup', 'double'), ('view', 'double')) t("column", dtype))
, roles AS (SELECT "column", CASE
    WHEN regexp_matches(upper("column"), 'PF|FTS|MCL|HFPO|ADONA|PFAS|11CL|9CL|NETFO|NMEFO|FOSA|ETFO|MEFO') THEN 'target'
    WHEN "column" IN ('cluster_id', 'gm_well_id', 'node_tier', 'basin_cluster_id', 'latitude', 'longitude',
                      'gm_gis_dwr_basin', 'gm_gis_county') THEN 'admin'
    WHEN "column" IN ('TDS', 'SO4', 'FE', 'MN', 'NO3N') THEN 'global' ELSE 'local' END AS role,
    CASE WHEN dtype IN ('double', 'bigint') THEN 'num' ELSE 'cat' END AS kind FROM cols)
, present AS (SELECT col AS "column", count(x) AS n_present FROM (SELECT sample_id::VARCHAR AS sample_id,
    gm_well_id::VARCHAR AS gm_well_id, day::VARCHAR AS day, PFOA::VARCHAR AS PFOA, TDS::VARCHAR AS TDS,
    purchase::VARCHAR AS purchase, signup::VARCHAR AS signup, view::VARCHAR AS view FROM w)
    UNPIVOT INCLUDE NULLS (x FOR col IN (sample_id, gm_well_id, day, PFOA, TDS, purchase, signup, view)) GROUP BY col)
SELECT "column", role, kind, n_present FROM roles JOIN present USING ("column")"""


@query("t_roles", _ROLES_SQL)
def t_roles(spark, d):
    """Column-role catalog of the wide sample table joined with each column's presence
    profile (one wide aggregate over the data), i.e. which features/targets are usable."""
    w = fx.wide_samples(spark, d)
    w = w.withColumnRenamed("click", "PFOA").withColumnRenamed("error", "TDS").withColumnRenamed("well_id", "gm_well_id")
    roles = prepare.roles_frame(spark, w)
    cols = w.columns
    stack = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_present"))
                      for i, c in enumerate(cols)])
    present = w.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).select(F.inline(stack))
    return roles.join(present, "column")
