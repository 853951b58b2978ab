"""Ingest-time derivations: renames, coercion, dates, engineered features, labels, reshaping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.functions import hash_uniform, nan_to_null, num, years_since


# --------------------------------------------------------------------- P1 / P2
def normalize_name(name: str, rename_map: dict[str, str] | None = None) -> str:
    rename_map = catalog.RENAME_MAP if rename_map is None else rename_map
    n = name.strip()
    n = rename_map.get(n, n)
    return n.replace(" ", "_").replace("-", "_")


def rename_columns(df: DataFrame, rename_map: dict[str, str] | None = None) -> DataFrame:
    """Strip, map lab codes to standard names, ' ' and '-' -> '_' in one projection.

    Raises when two input columns land on the same name (the projection would be ambiguous).
    """
    new = [normalize_name(c, rename_map) for c in df.columns]
    dup = {n for n in new if new.count(n) > 1}
    if dup:
        raise ValueError(f"rename collision: {sorted(dup)}")
    return df.select([F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, new)])


def coerce_analytes(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Every column whose name matches the analyte pattern becomes DOUBLE, junk -> NULL."""
    rx = re.compile(catalog.ANALYTE_NAME_PATTERN if pattern is None else pattern)
    return df.select([num(F.col(f"`{c}`")).alias(c) if rx.match(c) else F.col(f"`{c}`") for c in df.columns])


# --------------------------------------------------------------------- P3 / P4
def add_years(df: DataFrame, date_col: str = "date", start: str = catalog.EPOCH_START,
              out: str = "years_since_2016") -> DataFrame:
    """Parse the date (bad -> NULL) and add fractional years since `start`."""
    d = F.col(date_col)
    parsed = d if dict(df.dtypes)[date_col] in ("timestamp", "date", "timestamp_ntz") else F.try_to_timestamp(d)
    return df.withColumn(out, years_since(parsed, start))


# --------------------------------------------------------------------- P5 - P8
def engineer_features(df: DataFrame, leaching=("Soil_Moisture_mm", "Gradation_Uniformity", "Ratio_Water_Clay"),
                      atm=("pm2_5_atm", "air_humidity", "pm10_atm")) -> DataFrame:
    """Leaching index a*b/(c+1e-6) and atmospheric load a*b+c; skipped when a source is absent."""
    cols = set(df.columns)
    if all(c in cols for c in leaching):
        a, b, c = (F.col(x) for x in leaching)
        df = df.withColumn("leaching_index", F.try_divide(a * b, c + F.lit(1e-6)))
    if all(c in cols for c in atm):
        a, b, c = (F.col(x) for x in atm)
        df = df.withColumn("atm_loading", a * b + c)
    return df


def chem_features(df: DataFrame) -> DataFrame:
    """Ionic strength log1p(TDS); redox proxy and reducing flag (missing -> 0)."""
    redox = F.log1p(F.try_divide(F.col("FE") + F.col("SO4") + F.col("MN") + F.lit(0.1), F.col("NO3N") + F.lit(0.1)))
    return (
        df.withColumn("env_ionic_strength", nan_to_null(F.log1p("TDS")))
        .withColumn("redox_proxy", nan_to_null(redox))
        .withColumn("env_redox_reducing", F.coalesce((F.col("redox_proxy") > 0).cast("int"), F.lit(0)))
    )


# --------------------------------------------------------------------------- P9
def label_exceedance(obs: DataFrame, thresholds: DataFrame, conc: str = "conc", analyte: str = "analyte",
                     out: str = "y") -> DataFrame:
    """1.0 if conc >= limit, 0.0 if below; NULL when conc is missing or the analyte has no limit.

    `thresholds` is a dimension table (analyte, limit) with one row per analyte, so the
    broadcast is bounded by the analyte catalog, not by the data.
    """
    t = F.broadcast(thresholds.select(F.col("analyte").alias("__a"), F.col("limit").alias("__limit")))
    j = obs.join(t, obs[analyte] == t["__a"], "left")
    c = nan_to_null(F.col(conc))
    y = F.when(c >= F.col("__limit"), F.lit(1.0)).when(c < F.col("__limit"), F.lit(0.0))
    return j.withColumn(out, y).drop("__a", "__limit")


def label_wide(df: DataFrame, analytes: list[str], limits: dict[str, float], suffix: str = "_MCL_Status") -> DataFrame:
    """P9 on a wide table: one label column per present analyte; the concentration column is dropped."""
    present = [a for a in analytes if a in df.columns]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in present]
    labs = []
    for a in present:
        c = nan_to_null(F.col(f"`{a}`"))
        if a in limits:
            lim = F.lit(float(limits[a]))
            labs.append(F.when(c >= lim, 1.0).when(c < lim, 0.0).alias(a + suffix))
        else:
            labs.append(F.lit(None).cast("double").alias(a + suffix))
    return df.select(*keep, *labs)


# -------------------------------------------------------------------------- P10
def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "analyte", value: str = "conc",
            drop_nulls: bool = True) -> DataFrame:
    """P10: wide -> long with `unpivot`; missing cells are dropped (long form stores only observations)."""
    long = df.unpivot(ids, values, name, value)
    return long.where(F.col(value).isNotNull()) if drop_nulls else long


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, values: list[str], agg: str = "max") -> DataFrame:
    """P10: long -> wide with explicit pivot values (static schema, no extra distinct job)."""
    fn = getattr(F, agg)
    return df.groupBy(*ids).pivot(name, values).agg(fn(value))


# -------------------------------------------------------------------- P14 / P16
def all_missing_flag(df: DataFrame, targets: list[str], out: str = "all_missing") -> DataFrame:
    """True when every target column is NULL."""
    cond = F.lit(True)
    for t in targets:
        cond = cond & F.col(t).isNull()
    return df.withColumn(out, cond)


def missing_mask(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """Zero-filled values followed by presence flags ([x, mask], width 2d)."""
    vals = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]
    mask = [F.col(c).isNotNull().cast("double").alias(f"{c}_present") for c in cols]
    return df.select(*ids, *vals, *mask)


# -------------------------------------------------------------------------- P17
def median_impute(train: DataFrame, cols: list[str], apply_to: DataFrame | None = None) -> DataFrame:
    """Exact median (linear interpolation) per column, fitted on `train`, applied by coalesce.

    Fitting is one distributed aggregate; its single row (one value per column) is the
    plan, applied to `apply_to` as literals -- the same fit/transform split as spark.ml Imputer.
    """
    from aquifer.operators.stats import exact_quantiles, to_long

    med = exact_quantiles(to_long(train, cols), ["col"], "x", [0.5])
    plan = {r["col"]: r["q"] for r in med.collect()}  # one value per column: the fitted plan
    target = train if apply_to is None else apply_to
    out = [F.coalesce(F.col(c), F.lit(plan.get(c)).cast("double")).alias(c) if c in cols else F.col(c)
           for c in target.columns]
    return target.select(*out)


# -------------------------------------------------------------------------- P20
def feature_weights(features: DataFrame, weights: DataFrame, name: str = "feature") -> DataFrame:
    """P20: weight per feature name: explicit tier table first, then one-hot name tokens, default 1.0."""
    w = F.broadcast(weights.select(F.col("feature").alias("__f"), F.col("w").alias("__w")))
    j = features.join(w, features[name] == w["__f"], "left")
    low = F.lower(F.col(name))
    tok = None
    for token, weight in catalog.ONEHOT_WEIGHT_TOKENS:
        cond = low.contains(token)
        tok = F.when(cond, F.lit(weight)) if tok is None else tok.when(cond, F.lit(weight))
    return j.select(*features.columns, F.coalesce(F.col("__w"), tok, F.lit(1.0)).alias("w"))


# -------------------------------------------------------------------------- P21
def hazard_flag(df: DataFrame, conc: str = "conc", limit: float = catalog.HAZARD_LIMIT) -> DataFrame:
    """P21: 'red' when strictly above the limit, else 'blue'."""
    return df.withColumn("hazard", F.when(F.col(conc) > F.lit(limit), F.lit("red")).otherwise(F.lit("blue")))


# -------------------------------------------------------------------------- P22
def known_label_context(df: DataFrame, y: str = "y", p: str = "score", ratio: float | None = None,
                        seed: int = 42, keys: list[str] | None = None) -> Column:
    """True label where known, else the prediction; with `ratio`, a seeded fraction of known labels."""
    if ratio is None:
        return F.coalesce(F.col(y), F.col(p))
    u = hash_uniform(seed, *(keys or []))
    return F.when(F.col(y).isNotNull() & (u < F.lit(ratio)), F.col(y)).otherwise(F.col(p))
