"""Data profiling: sampling density, detections over time, coverage, null patterns,
histograms, box-plot statistics, variance ranking, correlations and VIF."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aquifer.operators.stats import global_prefix, quantiles_wide, to_long
from aquifer.session import write_down


# ------------------------------------------------------------------- G1 / G5
def well_sampling_summary(obs: DataFrame, well: str = "well_id", ts: str = "ts") -> DataFrame:
    """Samples per well -> min/max/mean, distinct wells, share of wells under 75 / 50 samples."""
    per_well = obs.groupBy(well).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"))
    return per_well.agg(
        F.count(F.lit(1)).alias("n_wells"),
        F.min("n").alias("min_samples"),
        F.max("n").alias("max_samples"),
        F.avg("n").alias("mean_samples"),
        F.avg((F.col("n") < 75).cast("double")).alias("pct_lt_75"),
        F.avg((F.col("n") < 50).cast("double")).alias("pct_lt_50"),
        F.min(F.year("first_ts")).alias("earliest_year"),
    )


# ------------------------------------------------------------------------ G2
def detections_by_period(obs: DataFrame, analytes: list[str], period: str = "yyyy-MM", ts: str = "ts",
                         conc: str = "conc", analyte: str = "analyte") -> DataFrame:
    """Detections (conc > 0) per period and analyte as a pivot; absent -> 0."""
    det = obs.where(F.col(conc) > 0).withColumn("period", F.date_format(ts, period))
    return det.groupBy("period").pivot(analyte, analytes).count().na.fill(0, analytes)


# ------------------------------------------------------------------------ G3
def first_tested(obs: DataFrame, period: str = "yyyy-MM", ts: str = "ts", conc: str = "conc",
                 analyte: str = "analyte") -> DataFrame:
    """First period with a non-missing value per analyte."""
    return obs.where(F.col(conc).isNotNull()).groupBy(analyte).agg(
        F.date_format(F.min(ts), period).alias("first_period"))


# ------------------------------------------------------------------------ G4
def coverage_by_period(wide: DataFrame, cols: list[str], date_col: str, period: str = "yyyy-MM") -> DataFrame:
    """Per period and column, non-missing count and missing fraction (long form, one pass)."""
    long = wide.select(F.date_format(date_col, period).alias("period"), *cols).unpivot(
        ["period"], cols, "col", "x")
    return long.groupBy("period", "col").agg(
        F.count("x").alias("n_present"), F.avg(F.col("x").isNull().cast("double")).alias("missing_frac"))


# ------------------------------------------------------------------------ G6
def null_patterns(wide: DataFrame, cols: list[str]) -> DataFrame:
    """Count rows per null pattern; bit i set when cols[i] is NULL."""
    mask = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    pattern = F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    return wide.groupBy(mask.alias("null_mask"), pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def null_rates(wide: DataFrame, cols: list[str]) -> DataFrame:
    long = wide.select(*cols).unpivot([], cols, "col", "x")
    return long.groupBy("col").agg(F.avg(F.col("x").isNull().cast("double")).alias("null_rate"))


# ----------------------------------------------------------------------- G24
def geo_center(df: DataFrame, lat: str, lon: str, by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    return df.groupBy(*keys).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------- G25
def histogram(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """Equal-width bins per column (max folded into the last bin), all columns in one job."""
    long = to_long(df, cols).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = long.groupBy("col").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = long.join(F.broadcast(rng), "col")  # one row per column: bounded by the schema
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    out = j.groupBy("col", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select("col", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left"),
                      "n")


# ----------------------------------------------------------------------- G26
def boxplot_stats(df: DataFrame, cols: list[str], whisker: float = 1.5) -> DataFrame:
    """q1/median/q3 (exact, interpolated), whisker ends within 1.5 IQR, outlier count. Two passes find the quartiles
    (approximate bounds, then counts and the values between them), a third the whiskers."""
    long = to_long(df, cols).where(F.col("x").isNotNull() & ~F.isnan("x"))
    q = quantiles_wide(long, ["col"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = long.join(F.broadcast(q), "col")  # one row per column
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - whisker * iqr, F.col("q3") + whisker * iqr
    return j.groupBy("col", "q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("whisker_hi"),
        F.count_if((F.col("x") < lo_f) | (F.col("x") > hi_f)).alias("n_outliers"),
    )


# ----------------------------------------------------------- W9 / G27 variance
def column_variance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample variance and non-missing count per column: one wide aggregate, stacked to long rows."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.var_samp(F.col(c).cast("double")).alias(f"v{i}"), F.count(c).alias(f"n{i}")]
    stack = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"v{i}").alias("variance"), F.col(f"n{i}").alias("n"))
                      for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.inline(stack))


def top_variance(df: DataFrame, cols: list[str], n: int = 20) -> DataFrame:
    """The n most variable columns (ties by name); the limit is the feature."""
    v = column_variance(df, cols)
    w = Window.orderBy(F.desc("variance"), "col")
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def variance_filter(df: DataFrame, cols: list[str], min_var: float = 1e-8) -> DataFrame:
    """Keep columns whose sample variance exceeds `min_var`."""
    v = column_variance(df, cols)
    return v.withColumn("keep", F.coalesce(F.col("variance") > min_var, F.lit(False)))


# ------------------------------------------------------------------- T10 / T11
TILE = 256  # columns on a side of the blocks that a task adds up


def gram_sums(df: DataFrame, cols: list[str], tile: int = TILE) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) for a before b in `cols`: sums over the rows where both are present, of values less
    their column's mean (so that large means cost no digits).

    A batch of rows gives matrix products of values and presence masks, a task adds them up in a block of tile x tile column
    pairs, and Spark adds the tasks' blocks. Columns beyond one tile are read tile by tile, two at a time."""
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    tiles = [list(range(at, min(at + tile, len(cols)))) for at in range(0, len(cols), tile)]
    parts = []
    for i, left in enumerate(tiles):
        for right in tiles[i:]:
            parts.append(_tile_sums(df, cols, centre, left, right))
    names = F.array(*[F.lit(c) for c in cols])
    total = functools.reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    return total.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
                        F.col("n").cast("long").alias("n"), "sa", "sb", "saa", "sbb", "sab")


def _tile_sums(df: DataFrame, cols: list[str], centre: np.ndarray, left: list[int], right: list[int]) -> DataFrame:
    used = left if left == right else left + right
    rows = df.select(*[F.col(cols[k]).cast("double").alias(f"c{k}") for k in used])
    i, j = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
    keep = i < j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(left), len(right)))
        for batch in batches:
            x = np.column_stack([batch.column(f"c{k}").to_numpy(zero_copy_only=False) for k in used]).astype(float) - centre[used]
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            a, ma = x[:, :len(left)], m[:, :len(left)]
            b, mb = x[:, len(used) - len(right):], m[:, len(used) - len(right):]
            sums += [ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b]
        flat = sums.reshape(6, -1)[:, keep]
        yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *map(pa.array, flat)],
                                         ["i", "j", "n", "sa", "sb", "saa", "sbb", "sab"])

    return rows.mapInArrow(run, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")


def _correlation(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson from sums; NULL where a side does not vary."""
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    return F.when((n > 0) & (va > 0) & (vb > 0), (sab - sa * sb / n) / F.sqrt(va * vb))


def pearson_pairs(df: DataFrame, cols: list[str], tile: int = TILE) -> DataFrame:
    """Pairwise-complete Pearson for every column pair, from blocks of sums; the plan does not grow with the pairs."""
    s = gram_sums(df, cols, tile)
    return s.select("a", "b", _correlation(*[F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]).alias("r"))


def _pairs(cols: list[str]):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _ranked(joint: DataFrame, ranks: DataFrame, keys: list[str], bound: int | None) -> DataFrame:
    """The joint values with their rank; ranks of values with more than `bound` cells are sent to the tasks."""
    if bound is None:
        return joint.join(ranks.drop("cells"), keys)
    common = F.col("cells") > bound
    few = F.broadcast(ranks.where(common).drop("cells"))
    rest = joint.join(few.select(*keys), keys, "left_anti").join(ranks.where(~common).drop("cells"), keys)
    return joint.join(few, keys).unionByName(rest)


def spearman_pairs(df: DataFrame, cols: list[str], hot: int = 100_000) -> DataFrame:
    """Pairwise-complete Spearman. The rows of a pair collapse to counts of its joint values (xa, xb); the counts of either
    side give the mid-ranks inside the pair, and the correlation of ranks is weighted by the joint counts. Rows are never
    ranked or joined. A value that meets more than `hot` (and a thousandth of all) joint values gets its rank by broadcast
    (such values are at most a thousand a side, over all pairs), so no task holds one value's counts."""
    stack = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("xa"),
                               F.col(b).cast("double").alias("xb")) for a, b in _pairs(cols)])
    there = F.col("xa").isNotNull() & F.col("xb").isNotNull() & ~F.isnan("xa") & ~F.isnan("xb")
    joint = write_down(df.select(F.inline(stack)).where(there).groupBy("a", "b", "xa", "xb").agg(F.count(F.lit(1)).alias("n")))
    sides = joint.select("a", "b", "n", F.inline(F.array(
        F.struct(F.lit("a").alias("side"), F.col("xa").alias("x")), F.struct(F.lit("b").alias("side"), F.col("xb").alias("x")))))
    marginal = write_down(sides.groupBy("a", "b", "side", "x").agg(F.sum("n").alias("_c"), F.count(F.lit(1)).alias("cells")))
    ranks = global_prefix(marginal, ["a", "b", "side"], "x", "_c", "_below").select(
        "a", "b", "side", "x", "cells", (F.col("_below") + (F.col("_c") + 1) / 2.0).alias("rk"))
    ranks = write_down(ranks)
    size = ranks.agg(F.sum("cells"), F.max("cells")).first()
    bound = max(hot, (size[0] or 0) // 2000)  # every joint value is counted on both sides
    out = joint
    for side in ("a", "b"):
        own = ranks.where(F.col("side") == side).select("a", "b", F.col("x").alias(f"x{side}"), F.col("rk").alias(f"r{side}"), "cells")
        out = _ranked(out, own, ["a", "b", f"x{side}"], bound if (size[1] or 0) > bound else None)
    n, ra, rb = F.col("n"), F.col("ra"), F.col("rb")
    sums = out.groupBy("a", "b").agg(F.sum(n).alias("n"), F.sum(n * ra).alias("sa"), F.sum(n * rb).alias("sb"),
                                     F.sum(n * ra * ra).alias("saa"), F.sum(n * rb * rb).alias("sbb"), F.sum(n * ra * rb).alias("sab"))
    return sums.select("a", "b", _correlation(*[F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]).alias("r"))


# ----------------------------------------------------------------------- T13
def vif(df: DataFrame, cols: list[str], max_cols: int = 20, min_var: float = 0.01) -> list[tuple]:
    """Variance inflation factors with intercept on zero-filled columns: keep columns with
    variance > min_var, take the `max_cols` most variable, their correlations from
    blocks of sums, then invert the (<= max_cols)^2 correlation matrix on the driver.
    Returns rows (col, variance, vif, high) with vif = inf for a singular matrix."""
    z = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    var = z.agg(*[F.var_samp(c).alias(c) for c in cols]).first().asDict()
    keep = sorted([c for c in cols if var[c] is not None and var[c] > min_var], key=lambda c: (-var[c], c))[:max_cols]
    if len(keep) < 2:
        return [(c, var[c], 1.0, False) for c in keep]
    k = len(keep)
    corr = np.eye(k)
    for r in pearson_pairs(z, keep).collect():  # at most max_cols squared
        i, j = keep.index(r["a"]), keep.index(r["b"])
        corr[i, j] = corr[j, i] = r["r"]
    try:
        if np.linalg.cond(corr) > 1e12:
            raise np.linalg.LinAlgError
        v = np.diag(np.linalg.inv(corr))
    except np.linalg.LinAlgError:
        v = np.full(k, np.inf)
    return [(c, float(var[c]), float(v[i]), bool(v[i] > 10)) for i, c in enumerate(keep)]
