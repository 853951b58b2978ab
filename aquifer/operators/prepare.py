"""Preparation for modelling: chronological split, distribution profile, scaler plans,
scaling, quantile-normal transform, one-hot and label encoding, column roles."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.operators.stats import exact_quantiles, sorted_ordinal, to_long

FAR_FUTURE = "9999-12-31"


# --------------------------------------------------------------------------- W1
def chronological_split(df: DataFrame, date_col: str, id_col: str, train_frac: float = 0.8) -> DataFrame:
    """First bround(frac*n) rows in (day, id) order are 'train', the rest 'test'; NULL dates last.

    No global sort: per-day counts (a small table) give the cut day; only rows of the cut day are
    ranked, with the skew-safe distributed rank (a single day may hold a third of the data).
    """
    day = F.coalesce(F.to_date(F.col(date_col)), F.lit(FAR_FUTURE).cast("date"))
    base = df.withColumn("_day", day)
    daily = base.groupBy("_day").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # small table
    cum = daily.withColumn("_cum", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    cum = cum.withColumn("_k", F.bround(F.col("_n") * train_frac, 0).cast("long"))
    cut = cum.where(F.col("_cum") > F.col("_k")).orderBy("_day").select("_day", "_c", "_cum", "_k").first()
    if cut is None:  # everything is train
        return df.withColumn("split", F.lit("train"))
    cut_day, take = cut["_day"], cut["_k"] - (cut["_cum"] - cut["_c"])
    cut_lit = F.lit(cut_day).cast("date")
    # the rows of the cut day are ranked themselves, so repeated and NULL ids (last) stay what they are
    inside = sorted_ordinal(base.where(F.col("_day") == cut_lit).drop("_day"), [], id_col, "_rank")
    inside = inside.withColumn("split", F.when(F.col("_rank") < F.lit(take), "train").otherwise("test")).drop("_rank")
    other = base.where(F.col("_day") != cut_lit).withColumn(
        "split", F.when(F.col("_day") < cut_lit, F.lit("train")).otherwise(F.lit("test"))).drop("_day")
    return other.unionByName(inside)


# ------------------------------------------------------------------------- T1
def _k2_pvalue(n: Column, g: Column, k: Column) -> Column:
    """D'Agostino-Pearson K^2 omnibus p-value from n, biased skewness g and biased excess kurtosis k."""
    n = n.cast("double")
    y = g * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1
    delta = 1.0 / F.sqrt(F.log(F.sqrt(w2)))
    alpha = F.sqrt(2.0 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (k + 3 - e) / F.sqrt(var)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denom) * F.pow((1 - 2.0 / a) / F.abs(denom), 1.0 / 3)
    z2 = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2.0)


def distribution_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column n, mean, population std, biased skewness/kurtosis and the normality p-value.
    One wide aggregate for all columns (no unpivot/shuffle), then stacked to one row per column."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.skewness(x).alias(f"g{i}"), F.kurtosis(x).alias(f"k{i}")]
    row = df.agg(*aggs)
    stack = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                               F.col(f"s{i}").alias("std"), F.col(f"g{i}").alias("skew"), F.col(f"k{i}").alias("kurt"))
                      for i, c in enumerate(cols)])
    prof = row.select(F.inline(stack))
    p = F.when(F.col("std") == 0, F.lit(0.0)).when(F.col("n") >= 20, _k2_pvalue(F.col("n"), F.col("skew"),
                                                                               F.col("kurt"))).otherwise(F.lit(0.0))
    return prof.withColumn("p_normal", F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0)))


# ------------------------------------------------------------------------- T2
def choose_scaler(profile: DataFrame) -> DataFrame:
    """Standard / robust / quantile choice per column from its profile row."""
    s, k = F.abs(F.col("skew")), F.abs(F.col("kurt"))
    kind = (
        F.when(F.col("n") < 10, "robust")
        .when((F.col("p_normal") > 0.05) & (s < 0.5) & (k < 1.0), "standard")
        .when((s > 2.0) | (k > 3.0), "robust")
        .when(s > 1.0, "quantile")
        .otherwise("standard")
    )
    return profile.withColumn("scaler", kind)


# ------------------------------------------------------------------ T3 - T6
QUANTILE_GRID = 1000
CLIP = 1e-7


@dataclass
class ScalerPlan:
    """Fitted per-column scalers: kind, center, scale and (for quantile) the reference quantiles."""

    kind: dict[str, str] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    quantiles: dict[str, list[float]] = field(default_factory=dict)


def fit_scalers(train: DataFrame, cols: list[str], kinds: tuple[str, ...] = ("standard", "robust", "quantile")
                ) -> ScalerPlan:
    """T2-T5 fit: profile, choose, then one pass for moments and one for exact quantiles.
    All-missing columns are dropped from the plan. The plan is small (O(columns x 1000)).
    Columns whose chosen kind is not in `kinds` are recorded but not fitted (saves the 1000-point
    quantile grid when only standard/robust scaling is applied)."""
    prof = choose_scaler(distribution_profile(train, cols)).collect()
    plan = ScalerPlan()
    need_q = {}
    for r in prof:
        if r["n"] == 0:
            continue
        plan.kind[r["col"]] = r["scaler"]
        if r["scaler"] not in kinds:
            continue
        if r["scaler"] == "standard":
            plan.center[r["col"]] = r["mean"]
            plan.scale[r["col"]] = r["std"] if r["std"] and r["std"] > 0 else 1.0
        elif r["scaler"] == "robust":
            need_q[r["col"]] = [0.25, 0.5, 0.75]
        else:
            n_q = min(QUANTILE_GRID, r["n"])
            need_q[r["col"]] = list(np.linspace(0, 1, n_q))
    if need_q:
        probs = sorted({p for ps in need_q.values() for p in ps})
        long = to_long(train, list(need_q))
        q = exact_quantiles(long, ["col"], "x", probs).collect()
        by_col: dict[str, dict[float, float]] = {}
        for r in q:
            by_col.setdefault(r["col"], {})[r["p"]] = r["q"]
        for c, ps in need_q.items():
            vals = by_col.get(c, {})
            if plan.kind[c] == "robust":
                iqr = vals[0.75] - vals[0.25]
                plan.center[c] = vals[0.5]
                plan.scale[c] = iqr if iqr != 0 else 1.0
            else:
                plan.quantiles[c] = [vals[p] for p in ps]
    return plan


def _quantile_normal_udf(quantiles: list[float]):
    """Vectorised quantile -> normal transform (interpolate forward and backward, average, probit)."""
    from statistics import NormalDist

    q = np.asarray(quantiles, dtype=float)
    refs = np.linspace(0, 1, len(q))
    inv = np.vectorize(NormalDist().inv_cdf, otypes=[float])

    @F.pandas_udf("double")
    def transform(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        out = np.full(v.shape, np.nan)
        ok = ~np.isnan(v)
        if ok.any():
            xv = v[ok]
            fwd = np.interp(xv, q, refs)
            bwd = -np.interp(-xv, -q[::-1], -refs[::-1])
            p = 0.5 * (fwd + bwd)
            p = np.where(xv <= q[0], 0.0, p)
            p = np.where(xv >= q[-1], 1.0, p)
            places, at = np.unique(np.clip(p, CLIP, 1 - CLIP), return_inverse=True)
            out[ok] = inv(places)[at]  # equal values are transformed once a batch
        return pd.Series(out)

    return transform


def apply_scalers(df: DataFrame, plan: ScalerPlan, keep: list[str] | None = None) -> DataFrame:
    """Scale each planned column; columns without a plan are dropped; NULL stays NULL."""
    keep = keep or []
    exprs = []
    for c in df.columns:
        if c in keep:
            exprs.append(F.col(c))
        elif c in plan.kind:
            x = F.col(c).cast("double")
            if plan.kind[c] == "quantile" and c in plan.quantiles:
                exprs.append(_quantile_normal_udf(plan.quantiles[c])(x).alias(c))
            elif c in plan.center:
                exprs.append(((x - F.lit(plan.center[c])) / F.lit(plan.scale[c])).alias(c))
            # a column whose kind was not fitted (see fit_scalers(kinds=...)) is dropped
    return df.select(*exprs)


# ------------------------------------------------------------------- T7 / T8
def fit_categories(train: DataFrame, cols: list[str]) -> DataFrame:
    """Category table (col, value, idx) from train; NULL is its own category (last); idx by sorted value.
    The distinct table is ranked with the size-checked distributed ordinal (no unbounded single sort)."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "col", "value")
    return sorted_ordinal(long.distinct(), ["col"], "value", "idx")


def one_hot_long(df: DataFrame, cats: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """T7 in long form: (id, feature '<col>_<value>', 1.0) for each hot cell; unseen -> no row (all zeros)."""
    long = df.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([id_col], cols, "col",
                                                                                          "value")
    j = long.join(cats, (long["col"] == cats["col"]) & long["value"].eqNullSafe(cats["value"]))
    name = F.concat(long["col"], F.lit("_"), F.coalesce(long["value"], F.lit("nan")))
    return j.select(long[id_col], name.alias("feature"), F.lit(1.0).alias("value"))


def one_hot_wide(df: DataFrame, cats_rows: list, cols: list[str]) -> DataFrame:
    """T7 wide: one DOUBLE column per training category (names known from the small category plan)."""
    exprs = [F.col(c) for c in df.columns]
    for r in cats_rows:
        if r["col"] in cols:
            v = r["value"]
            cond = F.col(r["col"]).cast("string").eqNullSafe(F.lit(v))
            exprs.append(F.when(cond, 1.0).otherwise(0.0).alias(f"{r['col']}_{'nan' if v is None else v}"))
    return df.select(*exprs)


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1 (distributed ordinal of the distinct table, joined back;
    AQE broadcasts the code table when it is small)."""
    out = out or f"{col}_code"
    d = df.select(col).distinct().where(F.col(col).isNotNull())
    codes = sorted_ordinal(d, [], col, out)
    return df.join(codes, col, "left")


def fit_labels(train: DataFrame, col: str) -> DataFrame:
    """T8 fit: (value, code) with the sorted distinct training values numbered from 0; NULL has no code."""
    d = train.select(F.col(col).alias("value")).distinct().where(F.col("value").isNotNull())
    return sorted_ordinal(d, [], "value", "code")


def encode_labels(df: DataFrame, codes: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """T8 apply: every row with its value's training code; a value that training did not have raises when the row is read.

    NULL stays NULL. `out` (default `<col>_code`) replaces a column of that name."""
    out = out or f"{col}_code"
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    unseen = F.raise_error(F.concat(F.lit(f"unseen label in {col}: "), F.col(f"`{col}`").cast("string"))).cast("int")
    j = df.join(table, F.col(f"`{col}`") == F.col("_value"), "left")
    code = F.when(F.col(f"`{col}`").isNull(), F.lit(None).cast("int")).when(F.col("_code").isNull(), unseen).otherwise(F.col("_code").cast("int"))
    return j.withColumn(out, code).drop("_value", "_code")


# ------------------------------------------------------------------- P11/P12
def column_roles(columns: list[str], dtypes: dict[str, str], global_feats: list[str] | None = None) -> dict:
    """Schema-only pass -> role per column (target / admin / global / local) and num/cat."""
    global_feats = catalog.GLOBAL_FEATS if global_feats is None else global_feats
    roles = {}
    for c in columns:
        up = c.upper()
        if any(t in up for t in catalog.TARGET_TOKENS) and c != "PFAS_total":
            role = "target"
        elif c in catalog.ADMIN_COLS:
            role = "admin"
        elif c in global_feats:
            role = "global"
        else:
            role = "local"
        kind = "num" if dtypes.get(c, "string") in ("double", "float", "int", "bigint", "smallint", "tinyint") or \
            dtypes.get(c, "").startswith("decimal") else "cat"
        roles[c] = (role, kind)
    return roles


def roles_frame(spark, df: DataFrame, global_feats: list[str] | None = None) -> DataFrame:
    r = column_roles(df.columns, dict(df.dtypes), global_feats)
    return spark.createDataFrame([(c, a, b) for c, (a, b) in r.items()], "column string, role string, kind string")


def k2_reference(n: float, g: float, k: float) -> float:
    """Scalar twin of `_k2_pvalue` for tests."""
    y = g * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / math.sqrt(math.log(math.sqrt(w2)))
    alpha = math.sqrt(2.0 / (w2 - 1))
    z1 = delta * math.asinh(y / alpha)
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (k + 3 - e) / math.sqrt(var)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + math.sqrt(1 + 4.0 / sb1 ** 2))
    d = 1 + x * math.sqrt(2 / (a - 4.0))
    t2 = math.copysign(1, d) * ((1 - 2.0 / a) / abs(d)) ** (1 / 3)
    z2 = (1 - 2 / (9.0 * a) - t2) / math.sqrt(2 / (9.0 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)
