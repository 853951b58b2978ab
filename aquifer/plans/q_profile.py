"""Stage 2 queries: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.functions import r6
from aquifer.operators import profile
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx

AN = fx.FX_ANALYTES
ENVC = fx.ENV_COLUMNS


@query("g_well_counts", S.with_(S.OBS) + """
, pw AS (SELECT well_id, count(*) AS n, min(ts) AS first_ts FROM obs GROUP BY well_id)
SELECT count(*) AS n_wells, min(n) AS min_samples, max(n) AS max_samples, round(avg(n), 6) AS mean_samples,
  round(avg((n < 75)::INT::DOUBLE), 6) AS pct_lt_75, round(avg((n < 50)::INT::DOUBLE), 6) AS pct_lt_50,
  min(year(first_ts))::INT AS earliest_year FROM pw""")
def g_well_counts(spark, d):
    s = profile.well_sampling_summary(fx.obs_long(spark, d))
    return s.select("n_wells", "min_samples", "max_samples", *[r6(c).alias(c) for c in
                    ["mean_samples", "pct_lt_75", "pct_lt_50"]], "earliest_year")


@query("g_yearly", S.with_(S.OBS) + """
SELECT strftime(ts, '%Y-%m') AS period,
  count(CASE WHEN analyte='click' THEN 1 END) AS click, count(CASE WHEN analyte='error' THEN 1 END) AS error,
  count(CASE WHEN analyte='purchase' THEN 1 END) AS purchase, count(CASE WHEN analyte='signup' THEN 1 END) AS signup,
  count(CASE WHEN analyte='view' THEN 1 END) AS view
FROM obs WHERE conc > 0 GROUP BY strftime(ts, '%Y-%m')""")
def g_yearly(spark, d):
    return profile.detections_by_period(fx.obs_long(spark, d), AN)


@query("g_first_seen", S.with_(S.OBS) + """
SELECT analyte, strftime(min(ts), '%Y-%m') AS first_period FROM obs WHERE conc IS NOT NULL GROUP BY analyte""")
def g_first_seen(spark, d):
    return profile.first_tested(fx.obs_long(spark, d))


@query("g_coverage", S.with_(S.OBS, S.WIDE) + """
SELECT period, col, count(x) AS n_present, round(avg((x IS NULL)::INT::DOUBLE), 6) AS missing_frac FROM (
  SELECT strftime(day, '%Y-%m') AS period, col, x FROM wide
  UNPIVOT INCLUDE NULLS (x FOR col IN (click, error, purchase, signup, view))) GROUP BY period, col""")
def g_coverage(spark, d):
    c = profile.coverage_by_period(fx.wide_samples(spark, d), AN, "day")
    return c.withColumn("missing_frac", r6("missing_frac"))


@query("g_null_patterns", S.with_(S.OBS, S.WIDE) + """
SELECT (click IS NULL)::INT + 2*(error IS NULL)::INT + 4*(purchase IS NULL)::INT + 8*(signup IS NULL)::INT
   + 16*(view IS NULL)::INT AS null_mask,
  (CASE WHEN click IS NULL THEN '0' ELSE '1' END) || (CASE WHEN error IS NULL THEN '0' ELSE '1' END) ||
  (CASE WHEN purchase IS NULL THEN '0' ELSE '1' END) || (CASE WHEN signup IS NULL THEN '0' ELSE '1' END) ||
  (CASE WHEN view IS NULL THEN '0' ELSE '1' END) AS pattern, count(*) AS n
FROM wide GROUP BY ALL""")
def g_null_patterns(spark, d):
    return profile.null_patterns(fx.wide_samples(spark, d), AN)


@query("g_null_rate", S.with_(S.OBS, S.WIDE) + """
SELECT col, round(avg((x IS NULL)::INT::DOUBLE), 6) AS null_rate FROM wide
  UNPIVOT INCLUDE NULLS (x FOR col IN (click, error, purchase, signup, view)) GROUP BY col""")
def g_null_rate(spark, d):
    return profile.null_rates(fx.wide_samples(spark, d), AN).withColumn("null_rate", r6("null_rate"))


@query("g_geo_center", S.with_(S.SITES) + """
SELECT basin, round(avg(lat_c), 6) AS lat, round(avg(lon_c), 6) AS lon, count(*) AS n FROM sites GROUP BY basin
UNION ALL SELECT '__all__', round(avg(lat_c), 6), round(avg(lon_c), 6), count(*) FROM sites""")
def g_geo_center(spark, d):
    s = fx.sites(spark, d)
    per = profile.geo_center(s, "lat_c", "lon_c", "basin")
    allc = profile.geo_center(s, "lat_c", "lon_c").select(F.lit("__all__").alias("basin"), "lat", "lon", "n")
    return per.unionByName(allc).select("basin", r6("lat").alias("lat"), r6("lon").alias("lon"), "n")


@query("g_histogram", S.with_(S.ENV, S.ENV_LONG) + """
, rng AS (SELECT col, min(x) AS lo, max(x) AS hi FROM env_long GROUP BY col)
, b AS (SELECT e.col, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 50)), 49) END::INT AS bin
        FROM env_long e JOIN rng USING (col))
SELECT col, bin, round(lo + bin * (hi - lo) / 50, 6) AS "left", count(*) AS n FROM b GROUP BY col, bin, lo, hi""")
def g_histogram(spark, d):
    h = profile.histogram(fx.env_covariates(spark, d), ENVC, 50)
    return h.withColumn("left", r6("left"))


@query("g_boxplot", S.with_(S.ENV, S.ENV_LONG) + """
, q AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
        FROM env_long GROUP BY col)
SELECT col, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN x >= q1 - 1.5*(q3-q1) THEN x END), 6) AS whisker_lo,
  round(max(CASE WHEN x <= q3 + 1.5*(q3-q1) THEN x END), 6) AS whisker_hi,
  count(CASE WHEN x < q1 - 1.5*(q3-q1) OR x > q3 + 1.5*(q3-q1) THEN 1 END) AS n_outliers
FROM env_long JOIN q USING (col) GROUP BY col, q1, median, q3""")
def g_boxplot(spark, d):
    b = profile.boxplot_stats(fx.env_covariates(spark, d), ENVC)
    return b.select("col", *[r6(c).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                    "n_outliers")


@query("g_top_variance", S.with_(S.ENV, S.ENV_LONG) + """
SELECT col, round(var_samp(x), 4) AS variance, count(x) AS n,
  row_number() OVER (ORDER BY var_samp(x) DESC, col) AS rank FROM env_long GROUP BY col
QUALIFY rank <= 3""")
def g_top_variance(spark, d):
    t = profile.top_variance(fx.env_covariates(spark, d), ENVC, 3)
    return t.select("col", F.round("variance", 4).alias("variance"), "n", "rank")


@query("c_variance_filter", S.with_(S.ENV, S.ENV_LONG) + """
SELECT col, round(var_samp(x), 4) AS variance, count(x) AS n, coalesce(var_samp(x) > 1e-8, false) AS keep
FROM (SELECT col, x FROM env_long UNION ALL SELECT 'zero', 0.0 FROM env) GROUP BY col""")
def c_variance_filter(spark, d):
    v = profile.variance_filter(fx.env_covariates(spark, d).withColumn("zero", F.lit(0.0)), [*ENVC, "zero"])
    return v.select("col", F.round("variance", 4).alias("variance"), "n", "keep")


@query("t_pearson", S.with_(S.OBS, S.WIDE) + """
SELECT a, b, round(r, 6) AS r FROM (
  SELECT 'click' AS a, 'error' AS b, corr(click, error) AS r FROM wide UNION ALL
  SELECT 'click', 'purchase', corr(click, purchase) FROM wide UNION ALL
  SELECT 'click', 'signup', corr(click, signup) FROM wide UNION ALL
  SELECT 'click', 'view', corr(click, view) FROM wide UNION ALL
  SELECT 'error', 'purchase', corr(error, purchase) FROM wide UNION ALL
  SELECT 'error', 'signup', corr(error, signup) FROM wide UNION ALL
  SELECT 'error', 'view', corr(error, view) FROM wide UNION ALL
  SELECT 'purchase', 'signup', corr(purchase, signup) FROM wide UNION ALL
  SELECT 'purchase', 'view', corr(purchase, view) FROM wide UNION ALL
  SELECT 'signup', 'view', corr(signup, view) FROM wide)""")
def t_pearson(spark, d):
    return profile.pearson_pairs(fx.wide_samples(spark, d), AN).withColumn("r", r6("r"))


def _spearman_sql():
    pairs = [(a, b) for i, a in enumerate(AN) for b in AN[i + 1:]]
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, sample_id, {a} AS xa, {b} AS xb FROM wide "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    return S.with_(S.OBS, S.WIDE) + f""", p AS ({parts})
SELECT a, b, round(corr(ra, rb), 6) AS r FROM (
  SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0 AS ra,
         rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0 AS rb FROM p)
GROUP BY a, b"""


@query("t_spearman", _spearman_sql())
def t_spearman(spark, d):
    return profile.spearman_pairs(fx.wide_samples(spark, d), AN).withColumn("r", r6("r"))


@query("g_missing_sites", S.with_(S.SITES) + """
SELECT site_id, county FROM sites WHERE county IN ('unknown', 'NO COUNTY FOUND')""")
def g_missing_sites(spark, d):
    """Sites whose county is a missing-value sentinel (the union of two filters is one isin)."""
    s = fx.sites(spark, d)
    return s.where(F.col("county").isin(*catalog.MISSING_COUNTY_VALUES)).select("site_id", "county")


@query("t_vif")
def t_vif(spark, d):
    """VIF of the environmental covariates (rows-only; checked against normal equations in tests)."""
    e = fx.env_covariates(spark, d).withColumn("FE2", F.col("FE") * 2 + F.col("SO4"))
    rows = profile.vif(e, ENVC + ["FE2"])
    return spark.createDataFrame(rows, "col string, variance double, vif double, high boolean")


@query("t_vif_two", S.with_(S.ENV) + """
, e AS (SELECT coalesce(TDS, 0) AS TDS, coalesce(FE, 0) AS FE, coalesce(NO3N, 0) AS NO3N FROM env)
SELECT pair, round(1 / (1 - r * r), 6) AS vif FROM (SELECT 'TDS|FE' AS pair, corr(TDS, FE) AS r FROM e
  UNION ALL SELECT 'TDS|NO3N', corr(TDS, NO3N) FROM e)""")
def t_vif_two(spark, d):
    """T13 on two columns at a time, where it is 1 / (1 - r^2) for both."""
    e = fx.env_covariates(spark, d)
    rows = [(f"{a}|{b}", {r[0]: r[2] for r in profile.vif(e, [a, b])}[b]) for a, b in (("TDS", "FE"), ("TDS", "NO3N"))]
    return spark.createDataFrame(rows, "pair string, vif double").withColumn("vif", r6("vif"))


@query("j_attach", S.with_(S.OBS, S.WIDE, S.THR, S.LABELLED) + """
, lab AS (SELECT well_id * 100000 + date_diff('day', DATE '2024-01-01', ts::DATE) AS sample_id,
          max(CASE WHEN analyte = 'click' THEN y END) AS y_click FROM labelled GROUP BY 1)
SELECT w.sample_id, w.well_id, w.error, l.y_click FROM wide w JOIN lab l USING (sample_id)""")
def j_attach(spark, d):
    """Labels re-attached to features by key (never by row order)."""
    from aquifer.operators import derive

    w = fx.wide_samples(spark, d).select("sample_id", "well_id", "error")
    lab = derive.label_exceedance(fx.obs_long(spark, d), fx.fx_thresholds(spark))
    lab = lab.groupBy((F.col("well_id") * 100000 + F.datediff(F.to_date("ts"), F.lit(fx.FX_EPOCH).cast("date")))
                      .alias("sample_id")).agg(F.max(F.when(F.col("analyte") == "click", F.col("y"))).alias("y_click"))
    return w.join(lab, "sample_id")
