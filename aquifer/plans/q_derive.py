"""Stage 1 queries: ingest-time derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.functions import num, r6, slug
from aquifer.operators import derive
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx

AN = fx.FX_ANALYTES


# ----------------------------------------------------------------- flagship
@query("q_exceed_monthly", S.with_(S.OBS, S.THR, S.LABELLED) + """
SELECT analyte, strftime(ts, '%Y-%m') AS month, count(*) AS n_obs, count(y) AS tested,
       count(CASE WHEN y = 1.0 THEN 1 END) AS exceed, round(avg(y), 6) AS prevalence
FROM labelled GROUP BY analyte, strftime(ts, '%Y-%m')""")
def q_exceed_monthly(spark, d):
    """Threshold exceedance per analyte and month: scan -> broadcast label join -> partial aggregate."""
    lab = derive.label_exceedance(fx.obs_long(spark, d), fx.fx_thresholds(spark))
    return lab.groupBy("analyte", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count("y").alias("tested"),
        F.count_if(F.col("y") == 1.0).alias("exceed"),
        r6(F.avg("y")).alias("prevalence"),
    )


@query("p_label", S.with_(S.OBS, S.THR, S.LABELLED) + "SELECT sample_id, well_id, analyte, conc, y FROM labelled")
def p_label(spark, d):
    lab = derive.label_exceedance(fx.obs_long(spark, d), fx.fx_thresholds(spark))
    return lab.select("sample_id", "well_id", "analyte", "conc", "y")


@query("p_label_wide", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, well_id,
  CASE WHEN click >= 40 THEN 1.0 WHEN click < 40 THEN 0.0 END::DOUBLE AS click_MCL_Status,
  CASE WHEN error >= 40 THEN 1.0 WHEN error < 40 THEN 0.0 END::DOUBLE AS error_MCL_Status,
  CASE WHEN purchase >= 100 THEN 1.0 WHEN purchase < 100 THEN 0.0 END::DOUBLE AS purchase_MCL_Status,
  CASE WHEN signup >= 20 THEN 1.0 WHEN signup < 20 THEN 0.0 END::DOUBLE AS signup_MCL_Status,
  NULL::DOUBLE AS view_MCL_Status
FROM wide""")
def p_label_wide(spark, d):
    w = fx.wide_samples(spark, d).drop("day")
    return derive.label_wide(w, AN, fx.FX_THRESHOLDS)


# Lab-code names given to the fixture analyte columns to exercise the rename map.
_RAW_NAMES = {"click": " PFHA", "error": "PFOS ", "purchase": "HFPA-DA", "signup": "PFBTA",
              "view": "Ratio_15_Bar_Water_to_Clay_<2mm"}


@query("p_rename", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, well_id, click AS PFHxA, error AS PFOS, purchase AS HFPO_DA, signup AS PFBA,
       view AS Ratio_Water_Clay FROM wide""")
def p_rename(spark, d):
    w = fx.wide_samples(spark, d).drop("day")
    raw = w.select("sample_id", "well_id", *[F.col(a).alias(_RAW_NAMES[a]) for a in AN])
    return derive.rename_columns(raw)


@query("p_coerce", """
SELECT event_id, props,
  CASE WHEN isnan(TRY_CAST(trim(props) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(props) AS DOUBLE) END AS props_num,
  TRY_CAST(trim(regexp_extract(props, ':([^}]*)', 1)) AS DOUBLE) AS k_num,
  TRY_CAST(trim(value::VARCHAR) AS DOUBLE) AS value_num
FROM events""")
def p_coerce(spark, d):
    """Text -> DOUBLE with junk -> NULL (ANSI-safe try_cast, NaN -> NULL)."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(
        "event_id", "props",
        num("props").alias("props_num"),
        num(F.regexp_extract("props", r":([^}]*)", 1)).alias("k_num"),
        num("value").alias("value_num"),
    )


@query("p_years", """
SELECT event_id, round(date_diff('day', DATE '2016-01-01', ts::DATE) / 365.25, 6) AS years_since_2016,
       year(ts)::INT AS year FROM events""")
def p_years(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    out = derive.add_years(ev, "ts")
    return out.select("event_id", r6("years_since_2016").alias("years_since_2016"), F.year("ts").alias("year"))


@query("p_leaching", S.with_(S.ENV) + """
SELECT l_orderkey, l_linenumber, round(FE * SO4 / (NO3N + 1e-6), 6) AS leaching_index,
       round(SO4 * MN + NO3N, 6) AS atm_loading FROM env""")
def p_leaching(spark, d):
    e = fx.env_covariates(spark, d).select(
        "l_orderkey", "l_linenumber",
        F.col("FE").alias("Soil_Moisture_mm"), F.col("SO4").alias("Gradation_Uniformity"),
        F.col("NO3N").alias("Ratio_Water_Clay"),
        F.col("SO4").alias("pm2_5_atm"), F.col("MN").alias("air_humidity"), F.col("NO3N").alias("pm10_atm"),
    )
    out = derive.engineer_features(e)
    return out.select("l_orderkey", "l_linenumber", r6("leaching_index").alias("leaching_index"),
                      r6("atm_loading").alias("atm_loading"))


@query("p_chem", S.with_(S.ENV) + """
SELECT l_orderkey, l_linenumber, round(ln(1 + TDS), 6) AS env_ionic_strength,
  round(ln(1 + (FE + SO4 + MN + 0.1) / (NO3N + 0.1)), 6) AS redox_proxy,
  coalesce((ln(1 + (FE + SO4 + MN + 0.1) / (NO3N + 0.1)) > 0)::INT, 0) AS env_redox_reducing
FROM env""")
def p_chem(spark, d):
    out = derive.chem_features(fx.env_covariates(spark, d))
    return out.select("l_orderkey", "l_linenumber", r6("env_ionic_strength").alias("env_ionic_strength"),
                      r6("redox_proxy").alias("redox_proxy"), "env_redox_reducing")


@query("p_unpivot", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, analyte, conc FROM wide UNPIVOT (conc FOR analyte IN (click, error, purchase, signup, view))""")
def p_unpivot(spark, d):
    return derive.to_long(fx.wide_samples(spark, d), ["sample_id"], AN).select("sample_id", "analyte", "conc")


@query("p_pivot", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, well_id, strftime(day, '%Y-%m-%d') AS day, click, error, purchase, signup, view FROM wide""")
def p_pivot(spark, d):
    w = fx.wide_samples(spark, d)
    return w.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("p_all_missing", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, (click IS NULL AND error IS NULL AND purchase IS NULL AND signup IS NULL AND view IS NULL) AS all_missing,
       (click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL
        AND view IS NOT NULL) AS complete FROM wide""")
def p_all_missing(spark, d):
    w = derive.all_missing_flag(fx.wide_samples(spark, d), AN)
    complete = F.lit(True)
    for a in AN:
        complete = complete & F.col(a).isNotNull()
    return w.select("sample_id", "all_missing", complete.alias("complete"))


@query("p_node_has_label", S.with_(S.OBS, S.THR, S.LABELLED) + """
SELECT well_id % 10 AS node_id, bool_or(y IS NOT NULL) AS has_label, count(y) AS n_labelled
FROM labelled GROUP BY well_id % 10""")
def p_node_has_label(spark, d):
    """P14 node test: does the node have any label?"""
    lab = derive.label_exceedance(fx.obs_long(spark, d), fx.fx_thresholds(spark))
    return lab.groupBy((F.col("well_id") % 10).alias("node_id")).agg(
        F.bool_or(F.col("y").isNotNull()).alias("has_label"), F.count("y").alias("n_labelled"))


@query("p_mask", S.with_(S.OBS, S.WIDE) + """
SELECT sample_id, coalesce(click, 0.0) AS click, coalesce(error, 0.0) AS error, coalesce(purchase, 0.0) AS purchase,
  coalesce(signup, 0.0) AS signup, coalesce(view, 0.0) AS view,
  (click IS NOT NULL)::DOUBLE AS click_present, (error IS NOT NULL)::DOUBLE AS error_present,
  (purchase IS NOT NULL)::DOUBLE AS purchase_present, (signup IS NOT NULL)::DOUBLE AS signup_present,
  (view IS NOT NULL)::DOUBLE AS view_present FROM wide""")
def p_mask(spark, d):
    return derive.missing_mask(fx.wide_samples(spark, d), AN, ["sample_id"])


@query("p_impute", S.with_(S.OBS, S.WIDE) + """
, med AS (SELECT quantile_cont(click, 0.5) AS mc, quantile_cont(error, 0.5) AS me, quantile_cont(purchase, 0.5) AS mp,
  quantile_cont(signup, 0.5) AS ms, quantile_cont(view, 0.5) AS mv FROM wide WHERE day < DATE '2024-01-25')
SELECT sample_id, round(coalesce(click, mc), 6) AS click, round(coalesce(error, me), 6) AS error,
  round(coalesce(purchase, mp), 6) AS purchase, round(coalesce(signup, ms), 6) AS signup,
  round(coalesce(view, mv), 6) AS view FROM wide, med""")
def p_impute(spark, d):
    """Medians fitted on the early days (train), applied to all rows."""
    w = fx.wide_samples(spark, d)
    train = w.where(F.col("day") < F.lit("2024-01-25").cast("date"))
    out = derive.median_impute(train, AN, apply_to=w)
    return out.select("sample_id", *[r6(a).alias(a) for a in AN])


@query("p_weights", """
WITH feats AS (SELECT DISTINCT 'gm_well_category_' || p_brand AS feature FROM part
  UNION ALL SELECT DISTINCT 'Texture_USDA_' || p_type FROM part
  UNION ALL SELECT DISTINCT 'gm_gis_dwr_basin_' || upper(p_type) FROM part
  UNION ALL SELECT * FROM (VALUES ('Facility_1km'), ('Gradation_Uniformity'), ('Silt_Total'), ('pm10_atm'),
                                  ('TDS')) t(feature))
SELECT feature, CASE
  WHEN feature IN ('Facility_50km', 'Facility_1km', 'Facility_3km', 'Facility_10km') THEN 4.0
  WHEN feature IN ('Gradation_Uniformity') THEN 3.0 WHEN feature IN ('Silt_Total') THEN 2.0
  WHEN feature IN ('pm10_atm') THEN 1.0
  WHEN contains(lower(feature), 'texture_usda') THEN 2.0 WHEN contains(lower(feature), 'gm_well_category') THEN 4.0
  WHEN contains(lower(feature), 'gm_gis_dwr_basin') THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM feats""")
def p_weights(spark, d):
    """P20: weights for one-hot feature names derived from the category table plus tier-listed names."""
    part = fx.categories(spark, d)
    feats = (
        part.select(F.concat(F.lit("gm_well_category_"), "p_brand").alias("feature")).distinct()
        .unionByName(part.select(F.concat(F.lit("Texture_USDA_"), "p_type").alias("feature")).distinct())
        .unionByName(part.select(F.concat(F.lit("gm_gis_dwr_basin_"), F.upper("p_type")).alias("feature")).distinct())
        .unionByName(spark.createDataFrame([(f,) for f in ["Facility_1km", "Gradation_Uniformity", "Silt_Total",
                                                           "pm10_atm", "TDS"]], "feature string"))
    )
    return derive.feature_weights(feats, catalog.weight_table(spark))


@query("p_hazard", S.with_(S.OBS) + """
SELECT sample_id, well_id, analyte, CASE WHEN conc > 4.0 THEN 'red' ELSE 'blue' END AS hazard FROM obs""")
def p_hazard(spark, d):
    return derive.hazard_flag(fx.obs_long(spark, d)).select("sample_id", "well_id", "analyte", "hazard")


@query("p_context", S.with_(S.PRED) + """
SELECT node_id, analyte, mode, count(*) AS n, round(sum(coalesce(y, score)), 6) AS ctx_sum,
       count(CASE WHEN y IS NULL THEN 1 END) AS n_predicted FROM pred GROUP BY node_id, analyte, mode""")
def p_context(spark, d):
    """Chain context = known label, else the model score."""
    p = fx.predictions(spark, d)
    ctx = derive.known_label_context(p, "y", "score")
    return p.groupBy("node_id", "analyte", "mode").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(ctx)).alias("ctx_sum"), F.count_if(F.col("y").isNull()).alias("n_predicted"))


@query("p_slug", """
SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g'),
  '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'column_unknown') AS slug FROM part""")
def p_slug(spark, d):
    return fx.categories(spark, d).select("p_partkey", slug("p_name").alias("slug"))
